"""Sharding by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_buckets, running, save


def interleave(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Put every row into one of `shards` shards so that each shard matches the mixture of sources.

    Rows are shuffled by a seeded hash within their source; row r of a source of n has the fractional rank
    (r - 1/2) / n. All rows in the order of that rank, cut into equal runs, give the shards: their row counts are at
    most one apart (law `rows`), and each holds every source in proportion.

    Ranks come from bucket counts, so a source with a third of all rows is ordered by many tasks.

    Edge cases: a null text has 16 bytes and CRC 0; a null source is a source of its own; rows with equal ids or
    texts are separate rows, ordered by their hash, id, size and CRC (rows equal in all of these are
    interchangeable); an empty table gives no rows; fewer rows than shards leave some shards empty; other columns of
    the input are not read.

    Returns the id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't `key`), source, position.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"),
    )
    base = save(base.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "shard-rows")
    n = base.count()
    bits = n_buckets(n)
    one = F.lit(1).cast("long")
    ties = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = running(base.withColumn("_bucket", F.pmod(F.col("_key"), F.lit(bits))), ["source"], "_bucket", ties, one, "_rank", "_n")
    share = (F.col("_rank") + 0.5) / F.col("_n")
    ranked = ranked.withColumn("_share", share).withColumn("_bucket", F.floor(F.col("_share") * bits).cast("long"))
    placed = running(ranked.withColumn("_all", F.lit(0)), ["_all"], "_bucket", [F.col("_share"), F.xxhash64("source"), F.col("source"), *ties], one, "position", "_total")
    shard = F.expr(f"position * {shards} div _total")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("position") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", "position",
    )

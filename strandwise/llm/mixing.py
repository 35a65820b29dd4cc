"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_buckets, n_words, running, save

#: Of each source, in turn: how far its share of the demand leans to the end of training. The share at time t in [0, 1]
#: is its weight times 1 + lean * (2t - 1).
LEANS = (-0.5, 0.0, 0.5)


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, leans: Sequence[float] = LEANS) -> DataFrame:
    """How many words each source gives; `sources` has source and source_size.

    Sources by code point (null last) take the weights in turn and share `share` of all words; a target stops at
    `most` times its source's size and what is above goes to the others by weight. In the order of most * size / weight
    those that reach their limit come first, so one pass over the sorted sources finds the level of all the others.
    One row a source passes through these windows, never documents.
    """
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), (i % len(xs) + 1).cast("int"))
    s = sources.select("source", "source_size", pick(weights).alias("_w"), pick(leans).alias("lean"))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # The first source whose own ratio isn't below the level sets the level of itself and of all that follow.
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(Window.partitionBy())["_level"]
    s = s.withColumn("_at", level)
    target = F.when(F.col("_at").isNull() | (F.col("_ratio") < F.col("_at")), F.col("_cap")).otherwise(F.col("_w") * F.col("_at"))
    return s.select("source", F.col("source_size"), F.least(target, F.col("_cap")).alias("target"), "lean")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, leans: Sequence[float] = LEANS, seed: str = "mix:", keep: Sequence[str] = (), ordered: bool = True, passes: bool = False) -> DataFrame:
    """Which words of which document the mix takes, and when in training.

    A source's documents in seeded order are a stream of words, which is read again from its start when it ends. The
    stream is read up to the source's target, rounded to whole words. `taken` is how many words of a document are read, in all
    passes; the last document of a source may be read in part, so a source's taken words add up to its rounded target.
    `copies` is the number of passes that begin within the target. The source's demand up to time t is
    target * (t + lean * (t*t - t)), the integral of its share; `position` inverts it at the document's first word and
    is null where nothing is taken. Rows come sorted by position over a range partitioning.

    Running sums are taken in buckets of the seeded hash, so a hot source is spread over many tasks.

    Edge cases: a null text has no words; null sources are one source, last in order; a document without words has
    copies by its place in the stream and takes 0; a source without words has target 0; rows repeated
    in all columns are separate rows, in one place of the order; an empty table gives no rows.
    `keep` names further columns to return, as keep_<name>; rows are sorted only if `ordered`; `passes` adds `positions`, that of
    each pass that begins within the target.
    """
    # The text's digest takes part, so rows without an id, or with one id, are in as many buckets as others.
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    named = docs.select(
        F.col("doc_id"), F.col("source"), key.alias("_key"), n_words(F.col("text")).alias("size"), *(F.col(c).alias(f"keep_{c}") for c in keep),
    )
    base = save(named, "mix-rows")
    n = n_buckets(base.count())
    base = base.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * n / 65536).cast("long"))
    goals = save(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, leans), "mix-targets")
    placed = running(base, ["source"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size")], F.col("size"), "_start", "_whole")
    g = goals.select(F.col("source").alias("_source"), "source_size", "target", "lean", F.round("target").cast("long").alias("_goal"))
    d = placed.join(g, F.col("source").eqNullSafe(F.col("_source")))
    rounds = F.sequence(F.lit(0), F.lit(int(most)))
    offset = lambda k: k.cast("long") * F.col("source_size") + F.col("_start")
    taken = F.aggregate(rounds, F.lit(0).cast("long"), lambda a, k: a + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_goal") - offset(k))))
    copies = F.aggregate(rounds, F.lit(0), lambda a, k: a + F.when(offset(k) < F.col("_goal"), 1).otherwise(0))
    d = d.withColumn("taken", taken).withColumn("copies", copies)
    lean = F.col("lean")

    def at(read):
        """When in training the demand reaches this number of words."""
        v = read / F.col("target")
        return 2.0 * v / ((1.0 - lean) + F.sqrt((1.0 - lean) * (1.0 - lean) + 4.0 * lean * v))

    begun = F.filter(rounds, lambda k: offset(k) < F.col("_goal"))
    d = d.withColumn("position", F.when(F.col("copies") > 0, at(F.col("_start")))).withColumn("positions", F.transform(begun, lambda k: at(offset(k))))
    out = d.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "source", *(F.col(f"keep_{c}") for c in keep), *(["positions"] if passes else []))
    return out if not ordered else out.orderBy(F.col("position").asc_nulls_last(), "doc_id")

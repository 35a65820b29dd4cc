"""The relations of this library as views over generic tables, for queries that run on those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of calls.
ORDER = ("ord1", "ord2", "ord3", "ord4", "ord5")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each line item."""
    t = table(spark, sf_dir, "lineitem")
    p1 = F.round(F.col("l_discount") * 10, 6).cast("decimal(7,6)")
    letters = F.translate(F.md5(F.col("l_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    minus = F.col("l_linenumber") % 2 == 0
    return t.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"), F.col("l_partkey").alias("pos"), F.when(minus, "-").otherwise("+").alias("strand"),
        F.when(minus, 99999 - F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("pos_in_strand"), F.concat(F.lit("read"), F.col("l_orderkey").cast("string")).alias("readname"), F.lit("t").alias("read_strand"),
        (F.lit(1).cast("decimal(7,6)") - p1).cast("decimal(7,6)").alias("prob_0"), p1.alias("prob_1"), (F.col("l_discount") * 10 > 0.5).cast("int").alias("called_label"),
        F.concat(F.substring(letters, 1, 2), F.lit("C"), F.substring(letters, 4, 2)).alias("k_mer"),
        F.col("l_orderkey").alias("ord1"), F.col("l_linenumber").alias("ord2"), F.col("l_extendedprice").alias("ord3"), F.col("l_partkey").alias("ord4"), F.col("l_suppkey").alias("ord5"), (F.col("l_returnflag") == "R").alias("truth"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training sample for each call; idx is unique."""
    idx = F.concat_ws("/", *ORDER[:2], F.col("ord3").cast("decimal(18,2)"), *ORDER[3:])
    return calls(spark, sf_dir).withColumnRenamed("called_label", "methy_label").withColumn("idx", idx)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each document, from all letters of its text."""
    t = table(spark, sf_dir, "documents")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return t.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq")).withColumn("len", F.length("seq").cast("long"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each vector: its components are samples, four a base."""
    t = table(spark, sf_dir, "embeddings")
    letters = F.translate(F.md5(F.col("vec_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    events = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((i * 4).cast("long").alias("start"), F.lit(4).alias("length"), F.substring(letters, i + 1, F.lit(1)).alias("base")))
    return t.select(
        F.concat(F.lit("read"), F.col("vec_id").cast("string")).alias("read_id"), F.col("embedding").cast("array<double>").alias("raw"), events.alias("events"), F.when(F.col("vec_id") % 2 == 0, "+").otherwise("-").alias("align_strand"),
        F.concat(F.lit("chr"), (F.col("vec_id") % 5 + 1).cast("string")).alias("chrom"), (F.col("vec_id") * 10).alias("chrom_start"), F.lit("t").alias("read_strand"), F.lit(100.0).alias("digitisation"), F.lit(18.0).alias("range"), F.lit(12.0).alias("offset"),
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript for each order and an exon for each of its line items, with attributes as text."""
    t = table(spark, sf_dir, "lineitem")
    minus = F.col("l_orderkey") % 2 == 0
    base = dict(chrom=F.concat(F.lit("chr"), (F.col("l_orderkey") % 5 + 1).cast("string")), source=F.lit("made"), score=F.lit("."), strand=F.when(minus, "-").otherwise("+"), phase=F.lit("."))
    exon = t.select(
        F.lit("exon").alias("feature"), (F.col("l_partkey") * 100 + 1).alias("start"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("end"), *(v.alias(k) for k, v in base.items()),
        F.format_string("Parent=transcript:%s;Name=e%s;rank=%s;flag=%s=x;Name=last%s;", "l_orderkey", "l_linenumber", "l_linenumber", "l_returnflag", "l_linestatus").alias("attributes"),
    )
    tx = t.select("l_orderkey").distinct().select(F.lit("mRNA").alias("feature"), F.lit(1).cast("long").alias("start"), F.lit(10).cast("long").alias("end"), *(v.alias(k) for k, v in base.items()), F.format_string("ID=transcript:%s;Parent=gene:%s", "l_orderkey", "l_orderkey").alias("attributes"))
    return exon.unionByName(tx)

"""Methylation frequency of sites from calls, and what is made of frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

MEASURES = ("prob_0_sum", "prob_1_sum", "met", "unmet", "coverage")
FREQ = ("chrom", "pos", "strand", "pos_in_strand", *MEASURES, "rmet", "k_mer")
ATTRIBUTES = ("strand", "pos_in_strand", "k_mer")


def callable_(calls: DataFrame, prob_cf: float = 0.5) -> DataFrame:
    """Calls whose two probabilities are prob_cf apart at least."""
    return calls.filter(F.abs(F.col("prob_0") - F.col("prob_1")) >= F.lit(str(prob_cf)).cast("decimal(7,6)"))


def on_contigs(calls: DataFrame, contigs: DataFrame | Sequence[str] | None) -> DataFrame:
    """Calls on the contigs named, by a list or by a relation of name."""
    if contigs is None:
        return calls
    if isinstance(contigs, DataFrame):
        return calls.join(contigs.select(F.col("name").alias("chrom")).distinct(), "chrom", "left_semi")
    return calls.filter(F.col("chrom").isin(list(contigs)))


def site_frequency(calls: DataFrame, order: Sequence[str], prob_cf: float = 0.5, contigs: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Frequencies of sites (chrom, pos); strand, pos_in_strand and k_mer are those of the first callable call by `order`.

    Probabilities are summed as decimals, so sums don't depend on the order of rows.
    """
    used = callable_(on_contigs(calls, contigs), prob_cf)
    sums = used.groupBy("chrom", "pos").agg(
        F.sum("prob_0").cast("double").alias("prob_0_sum"), F.sum("prob_1").cast("double").alias("prob_1_sum"),
        F.count_if(F.col("called_label") == 1).alias("met"), F.count_if(F.coalesce(F.col("called_label") != 1, F.lit(True))).alias("unmet"),
        F.count(F.lit(1)).alias("coverage"), F.min_by(F.struct(*ATTRIBUTES), F.struct(*order)).alias("first"),
    )
    return with_rmet(sums.select("chrom", "pos", *MEASURES, "first.*"))


def with_rmet(sums: DataFrame) -> DataFrame:
    return sums.filter("coverage > 0").withColumn("rmet", F.col("met").cast("double") / F.col("coverage")).select(*FREQ)


def used_ratio(calls: DataFrame, prob_cf: float = 0.5) -> DataFrame:
    """How many calls there are, how many are callable, and their share (null without calls)."""
    near = F.abs(F.col("prob_0") - F.col("prob_1")) >= F.lit(str(prob_cf)).cast("decimal(7,6)")
    return calls.agg(F.count(F.lit(1)).alias("total"), F.count_if(near).alias("used")).withColumn("ratio", F.try_divide(F.col("used").cast("double"), F.col("total").cast("double")))


def to_bed(freq: DataFrame, percent: Column | None = None) -> DataFrame:
    """The bedMethyl rows of frequencies."""
    percent = N.percent(F.col("rmet")) if percent is None else percent
    pos, cov = F.col("pos"), F.col("coverage")
    return freq.select(
        "chrom", pos.alias("start"), (pos + 1).alias("end"), F.lit(".").alias("name"), cov.alias("score"), "strand",
        pos.alias("thick_start"), (pos + 1).alias("thick_end"), F.lit("0,0,0").alias("rgb"), cov.alias("coverage"), percent.alias("percent"),
    )


def rename_chroms(freq: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Give contigs other names; one that has none is an error."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return freq.withColumn("chrom", F.coalesce(F.try_element_at(known, F.col("chrom")), F.raise_error(F.concat(F.lit("no name for contig "), F.col("chrom"))).cast("string")))


def frequency_file_to_bed(freq: DataFrame, order: Sequence[str], min_coverage: int = 1, names: Mapping[str, str] | None = None) -> DataFrame:
    """bedMethyl of a frequency table: rows with too little coverage go, of equal sites (chrom, pos, strand) the last stays."""
    kept = freq.filter(F.col("coverage") >= min_coverage)
    kept = kept if names is None else rename_chroms(kept, names)
    last = kept.groupBy("chrom", "pos", "strand").agg(F.max_by(F.struct("rmet", "coverage"), F.struct(*order)).alias("r"))
    return to_bed(last.select("chrom", "pos", "strand", "r.*"))


def combine(parts: Sequence[DataFrame], order: Sequence[str] = ("pos_in_strand",)) -> DataFrame:
    """Sum frequency tables by (chrom, pos, strand); within a table the last of equal sites by `order` counts, and of attributes the last table's.

    Each table is dealt by site before the tables meet, so a task that makes a table's rows doesn't hold another's, and one sort by site and
    table serves both groupings. The number of tasks is given, so that few small rows aren't gathered in tasks whose sort and sums take much memory.
    """
    tasks = int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sites = ("chrom", "pos", "strand")
    columns = dict.fromkeys((*sites, "pos_in_strand", "k_mer", *MEASURES, *order))
    rows = reduce(DataFrame.unionByName, (p.select(*columns, F.lit(i).alias("part")).repartition(tasks, *sites) for i, p in enumerate(parts)))
    once = rows.groupBy(*sites, "part").agg(F.max_by(F.struct("pos_in_strand", "k_mer", *MEASURES), F.struct(*order)).alias("r"))
    sums = once.select(*sites, "part", "r.*").groupBy(*sites).agg(*(F.sum(m).alias(m) for m in MEASURES), F.max_by(F.struct("pos_in_strand", "k_mer"), "part").alias("last"))
    return with_rmet(sums.select(*sites, *MEASURES, "last.*"))


def fold(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Give a site of the minus strand the position of its plus-strand partner."""
    return rows.withColumn(pos, F.when(F.col("strand") == "-", F.col(pos) - 1).otherwise(F.col(pos)))


def combine_strands(freq: DataFrame, sites: DataFrame) -> DataFrame:
    """Sum both strands of each reference CG site (chrom, pos); other sites go. The k-mer is the plus strand's, or `-`."""
    folded = fold(freq).join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"])
    plus = F.max(F.when(F.col("strand") == "+", F.col("k_mer")))
    sums = folded.groupBy("chrom", "pos").agg(*(F.sum(m).alias(m) for m in MEASURES), F.coalesce(plus, F.lit("-")).alias("k_mer"))
    return with_rmet(sums.withColumn("strand", F.lit("+")).withColumn("pos_in_strand", F.col("pos")))


def off_sites(freq: DataFrame, sites: DataFrame) -> DataFrame:
    """The rows that combine_strands drops."""
    return fold(freq).join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti")


def combine_strands_bed(bed: DataFrame, sites: DataFrame) -> DataFrame:
    """The same over bedMethyl rows, whose methylated count is percent / 100 * coverage."""
    rows = fold(bed.select("chrom", F.col("start").alias("pos"), "strand", "coverage", (F.col("percent") / F.lit(100.0) * F.col("coverage")).alias("met")))
    rows = rows.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"])
    sums = rows.groupBy("chrom", "pos").agg(F.sum("coverage").alias("coverage"), F.sum("met").alias("met")).filter("coverage > 0")
    rmet = F.col("met") / F.col("coverage")
    return to_bed(sums.select("chrom", "pos", F.lit("+").alias("strand"), "coverage", rmet.alias("rmet")), N.percent_floor(F.col("rmet")))


def sorted_sites(freq: DataFrame, with_strand: bool = False) -> DataFrame:
    return freq.orderBy("chrom", "pos", *(["strand"] if with_strand else []))

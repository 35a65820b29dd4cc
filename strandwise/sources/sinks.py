"""Writers. Every writer takes a folder or, with one_file, gathers rows into one part file (for small results)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extract import to_text
from ..operators.frequency import to_bed


def tsv(df: DataFrame, path: str, gzip: bool = False, one_file: bool = False, header: bool = False, rows_a_file: int = 0) -> None:
    out = df.coalesce(1) if one_file else df
    writer = out.write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "")
    writer = writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer
    writer.csv(path, compression="gzip" if gzip else "none")


def fixed(column: str, digits: int) -> Column:
    """A number with so many digits after the point."""
    return F.format_string(f"%.{digits}f", F.col(column)).alias(column)


def features(df: DataFrame, path: str, gzip: bool = False, one_file: bool = False, rows_a_file: int = 0) -> None:
    tsv(to_text(df), path, gzip, one_file, rows_a_file=rows_a_file)


def calls(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Rows of a read stay together, in order."""
    tsv(df.repartition("readname").sortWithinPartitions("readname", "pos"), path, gzip)


def frequencies(df: DataFrame, path: str, bed: bool = False, sort: bool = False, gzip: bool = False, plain: bool = False) -> None:
    """Frequencies with three and four digits after the point (as they are, if plain), or bedMethyl."""
    rows = df.orderBy("chrom", "pos", "strand") if sort else df
    if bed:
        tsv(to_bed(rows), path, gzip)
    elif plain:
        tsv(rows, path, gzip)
    else:
        tsv(rows.select("chrom", "pos", "strand", "pos_in_strand", fixed("prob_0_sum", 3), fixed("prob_1_sum", 3), "met", "unmet", "coverage", fixed("rmet", 4), "k_mer"), path, gzip)


def contig_names(df: DataFrame, path: str) -> None:
    """A name a line, sorted, each once."""
    df.select("name").distinct().orderBy("name").write.text(path)


def annotation(df: DataFrame, path: str) -> None:
    """Annotation rows as GFF3 lines, starts from 1 again, attributes in the order of their keys."""
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    columns = [F.col(c) for c in ("chrom", "source", "feature")] + [F.col("start") + 1, F.col("end")] + [F.col(c) for c in ("score", "strand", "phase")] + [F.array_join(pairs, ";")]
    df.select(F.array_join(F.array(*(c.cast("string") for c in columns)), "\t", ".").alias("value")).write.text(path)


def evaluation(df: DataFrame, path: str) -> None:
    tsv(df, path, one_file=True, header=True)


def probabilities(stats: DataFrame, path: str) -> None:
    """The number of each sample and its mean probability, in the order of numbers."""
    tsv(stats.orderBy("idx").select("idx", "mean_prob"), path)

"""Rows by the motif of their cytosine: CG, CHG or CHH."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def classify(rows: DataFrame, k_mer: str = "k_mer") -> DataFrame:
    """Add the motif by the middle of a k-mer; null where it has none."""
    return rows.withColumn("motif", S.kmer_class(F.col(k_mer)))


def reference_sites(contigs: DataFrame, size: int = 1 << 18) -> DataFrame:
    """chrom, pos, strand and motif (null: none) of every cytosine of either strand; on the minus strand, of those with two bases before them.

    Contigs (name, seq) are cut into tiles, in which the kernel that finds a cytosine looks at its next two bases, too.
    """
    return sites_of_tiles(S.tiles(contigs, 2, 2, size), size)


def sites_of_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """The same from tiles of `size` with two bases more on both sides, as sources.text.fasta_tiles gives."""
    return S.scan_cytosines(tiles, size).withColumnRenamed("name", "chrom")


def classify_by_reference(rows: DataFrame, sites: DataFrame, pos: str = "pos") -> DataFrame:
    """Add the motif of the reference's cytosine at a site (see reference_sites), on its strand; null where there is none.

    Rows meet sites by contig, place and strand, so neither carries any sequence.
    """
    named = sites.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), F.col("strand").alias("_strand"), "motif")
    return rows.join(named, (F.col("chrom") == F.col("_chrom")) & (F.col(pos) == F.col("_pos")) & (F.col("strand") == F.col("_strand")), "left").drop("_chrom", "_pos", "_strand")


def split(classified: DataFrame, path: str) -> None:
    """Write the rows of each motif into a folder of its own; rows without one go (see failures)."""
    classified.filter("motif is not null").write.partitionBy("motif").option("sep", "\t").csv(path)


def failures(classified: DataFrame) -> DataFrame:
    """How many rows each motif has, `failed` being those without one."""
    return classified.groupBy(F.coalesce(F.col("motif"), F.lit("failed")).alias("motif")).agg(F.count(F.lit(1)).alias("n"))

"""Features of candidate sites from reads: normalised signal by base, k-mers, genome positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import signal as G


@dataclass(frozen=True)
class Region:
    """A contig, or a stretch of it from start to end (0-based, half-open)."""

    chrom: str | None = None
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str | None) -> Region:
        """`chrom`, `chrom:start` or `chrom:start-end`."""
        if not text:
            return cls()
        chrom, _, rest = text.partition(":")
        start, _, end = rest.partition("-")
        region = cls(chrom, int(start) if start else None, int(end) if end else None)
        if region.start is not None and region.end is not None and region.start >= region.end:
            raise ValueError(f"an empty region: {text}")
        return region

    def holds(self, chrom: Column, start: Column, end: Column) -> Column:
        """Whether a stretch overlaps the region."""
        if self.chrom is None:
            return F.lit(True)
        low = F.lit(True) if self.start is None else end > self.start
        high = F.lit(True) if self.end is None else start < self.end
        return (chrom == self.chrom) & low & high


def is_usable() -> Column:
    """Whether a read's parts are all there and its events lie within its signal."""
    fits = F.forall("events", lambda e: (e["start"] >= 0) & (e["start"] + e["length"] <= F.size("raw")))
    known = F.col("chrom").isNotNull() & (F.col("chrom") != "") & F.col("chrom_start").isNotNull() & F.col("align_strand").isin("+", "-")
    return F.coalesce(known & F.col("raw").isNotNull() & (F.size("events") > 0) & fits & (F.col("digitisation") != 0), F.lit(False))


def usable(reads: DataFrame) -> DataFrame:
    """Reads that are usable; a read that fails goes whole."""
    return reads.filter(is_usable())


def _counts(reads: DataFrame) -> list[Column]:
    """Reads, those that fail, and among them files that couldn't be read, where reads tell (see sources/raw.py)."""
    lost = [F.count_if(F.col("reason").isNotNull()).alias("unreadable")] if "reason" in reads.columns else []
    return [F.count(F.lit(1)).alias("reads"), F.count_if(~is_usable()).alias("failed"), *lost]


def failed_reads(reads: DataFrame) -> DataFrame:
    return reads.agg(*_counts(reads))


def observed(reads: DataFrame, counts: Observation) -> DataFrame:
    """Reads as they are; once they have been read for some result, `counts` holds what failed_reads would tell, from the same scan."""
    return reads.observe(counts, *_counts(reads))


def motif_sites(motifs: Sequence[str], offset: int, half: int) -> Column:
    """Places of the motifs' base `offset` in a read, at least `half` bases from its ends; bases are taken from events one by one."""
    wide, n = len(motifs[0]), F.size("events")
    at = lambda i: F.concat(*(F.get(F.col("events"), i + j)["base"] for j in range(wide)))
    found = F.filter(F.sequence(F.lit(0), n - wide), lambda i: at(i).isin(list(motifs)) & (i + offset >= half) & (i + offset < n - half))
    return F.when(n >= wide, F.transform(found, lambda i: i + offset))


def features(
    reads: DataFrame, motifs: Sequence[str], contigs: DataFrame | None = None, positions: DataFrame | None = None, region: Region = Region(), offset: int = 0, k: int = 13, width: int = 16, label: int = 1, method: str = "mad", seed: int = 0,
    counts: Observation | None = None, rounded: Callable[[Column, int], Column] = F.bround,
) -> DataFrame:
    """One row for each motif site of each usable read, at least k // 2 bases from its ends, in the region, at the positions.

    The region prunes reads before their signal is touched. Positions meet sites as pairs of a read's key and a place, without
    signal or events; those of reads that keep a site are fetched by key afterwards, and normalised once a read. `contigs` (name, len) gives
    pos_in_strand, -1 where unknown. `counts` observes the reads (see observed). `rounded` makes six digits of means and deviations: by their
    shortest decimals, or as numbers.around does.
    """
    half, n = k // 2, F.size("events")
    seen = reads if counts is None else observed(reads, counts)
    here = lambda rows: usable(rows.filter(F.col("chrom") == region.chrom) if region.chrom else rows).filter(region.holds(F.col("chrom"), F.col("chrom_start"), F.col("chrom_start") + n))
    pos = N.genome_position(F.col("align_strand"), F.col("chrom_start"), n, F.col("loc")).cast("long")
    inside = (F.lit(True) if region.start is None else F.col("pos") >= region.start) & (F.lit(True) if region.end is None else F.col("pos") < region.end)
    scaled = G.rescale(F.col("raw"), F.col("range") / F.col("digitisation"), F.col("offset"))
    with_signal = lambda rows: rows.withColumn("signal", G.normalize(scaled, method))
    if positions is None:
        rows = with_signal(here(seen)).withColumn("loc", F.explode(motif_sites(motifs, offset, half))).withColumn("pos", pos)
        rows = rows.filter(inside) if region.chrom else rows
    else:
        # Reads may share an id: what tells them apart is all that they hold. Reads that are the same in all have the same sites.
        key = [F.col("read_id").alias("_id"), F.xxhash64(*reads.columns).alias("_key")]
        wanted = positions.select("chrom", "pos", F.col("strand").alias("align_strand")).distinct()
        sites = here(seen).select(*key, "chrom", "chrom_start", "align_strand", n.alias("_n"), F.explode(motif_sites(motifs, offset, half)).alias("loc"))
        sites = sites.withColumn("pos", N.genome_position(F.col("align_strand"), F.col("chrom_start"), F.col("_n"), F.col("loc")).cast("long"))
        sites = (sites.filter(inside) if region.chrom else sites).join(wanted, ["chrom", "pos", "align_strand"], "left_semi")
        locs = sites.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("loc")).alias("_locs"))
        rows = with_signal(here(reads).select("*", *key).join(locs, ["_id", "_key"])).withColumn("loc", F.explode("_locs")).withColumn("pos", pos)
    length = F.lit(None).cast("long")
    if contigs is not None:
        rows = rows.join(contigs.select(F.col("name").alias("chrom"), F.col("len").cast("long").alias("_len")), "chrom", "left")
        length = F.col("_len")
    near = F.slice("events", F.col("loc") - half + 1, F.lit(k))
    rows = rows.withColumn("parts", G.per_base(F.col("signal"), near)).withColumn("near", near)
    key = lambda i: F.concat_ws("|", "read_id", "pos", i)
    return rows.select(
        "chrom", "pos", F.col("align_strand").alias("alignstrand"), N.strand_position(F.col("align_strand"), F.col("pos"), length).alias("pos_in_strand"),
        F.col("read_id").alias("readname"), "read_strand", F.array_join(F.transform("near", lambda e: e["base"]), "").alias("k_mer"),
        F.transform("parts", lambda p: rounded(G.mean(p), 6)).alias("signal_means"), F.transform("parts", lambda p: rounded(G.std(p), 6)).alias("signal_stds"),
        F.transform("near", lambda e: e["length"]).alias("signal_lens"), F.transform("parts", lambda p, i: G.rectangle(p, width, key(i), seed)).alias("raw_signals"), F.lit(label).alias("methy_label"),
    )


def to_text(rows: DataFrame) -> DataFrame:
    """Features as text columns: lists by commas, lists of lists by semicolons."""
    csv = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("chrom", "pos", "alignstrand", "pos_in_strand", "readname", "read_strand", "k_mer", *(csv(F.col(c)).alias(c) for c in ("signal_means", "signal_stds", "signal_lens")), F.array_join(F.transform("raw_signals", csv), ";").alias("raw_signals"), "methy_label")


def from_text(rows: DataFrame) -> DataFrame:
    """The reverse of to_text."""
    nums = lambda c, t: F.transform(F.split(c, ","), lambda x: x.cast(t))
    return rows.withColumns({"signal_means": nums(F.col("signal_means"), "double"), "signal_stds": nums(F.col("signal_stds"), "double"), "signal_lens": nums(F.col("signal_lens"), "int"), "raw_signals": F.transform(F.split("raw_signals", ";"), lambda p: nums(p, "double"))})

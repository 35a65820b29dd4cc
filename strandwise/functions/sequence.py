"""Column functions over nucleotide sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The complement of each IUPAC letter, of DNA and of RNA.
DNA, DNA_COMPLEMENT = "ACGTNWSMKRYBVDHZ", "TGCANWSKMYRVBHDZ"
RNA, RNA_COMPLEMENT = "ACGUNWSMKRYBVDHZ", "UGCANWSKMYRVBHDZ"
# The bases that each IUPAC letter stands for.
IUPAC = {"A": "A", "T": "T", "C": "C", "G": "G", "R": "AG", "M": "AC", "S": "CG", "Y": "CT", "K": "GT", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# The code of each base, by its place.
DNA_CODES, RNA_CODES = DNA, RNA


def reverse_complement(seq: Column, rna: bool = False, strict: bool = False) -> Column:
    """The reverse complement; an unknown letter becomes N, or makes the result empty if strict."""
    letters, complement = (RNA, RNA_COMPLEMENT) if rna else (DNA, DNA_COMPLEMENT)
    back = F.translate(F.reverse(seq), letters, complement)
    if strict:
        return F.when(seq.rlike(f"[^{letters}]"), F.lit("")).otherwise(back)
    return F.translate(F.reverse(F.regexp_replace(seq, f"[^{letters}]", "N")), letters, complement)


def expand_iupac(motif: str, rna: bool = False) -> list[str]:
    """Every sequence of bases that a motif stands for."""
    found = ["".join(p) for p in product(*(IUPAC[x] for x in motif.strip().upper().replace("U", "T")))]
    return [x.replace("T", "U") for x in found] if rna else found


def parse_motifs(motifs: str, rna: bool = False) -> list[str]:
    """The sequences of a comma-separated list of motifs, which must be of one length."""
    found = list(dict.fromkeys(x for m in motifs.split(",") for x in expand_iupac(m, rna)))
    if len({len(x) for x in found}) != 1:
        raise ValueError("motifs must be of one length")
    return found


def encode(seq: Column, codes: str = DNA_CODES) -> Column:
    """The code of each base; a base without one is null."""
    return F.transform(F.split(seq, ""), lambda b: F.when(F.instr(F.lit(codes), b) > 0, F.instr(F.lit(codes), b) - 1))


def decode(codes_col: Column, codes: str = DNA_CODES) -> Column:
    """The sequence of an array of codes."""
    return F.array_join(F.transform(codes_col, lambda i: F.substring(F.lit(codes), i + 1, F.lit(1))), "")


def center(k_mer: Column, width: int = 5) -> Column:
    """The `width` bases around the middle, clamped at the ends."""
    middle = F.floor(F.length(k_mer) / 2)
    first = F.greatest(middle - width // 2, F.lit(0))
    return F.substring(k_mer, (first + 1).cast("int"), (F.least(middle + width // 2 + 1, F.length(k_mer)) - first).cast("int"))


def window(seq: Column, at: Column, k: int) -> Column:
    """The k bases around a place (from 0); k must be odd."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    return F.substring(seq, (at - k // 2 + 1).cast("int"), F.lit(k))


def motif_class(three: Column) -> Column:
    """CG, CHG or CHH by three bases from the cytosine on, or null."""
    return F.when(three.rlike("^CG[ACGTN]$"), "CG").when(three.rlike("^C[ACTH]G$"), "CHG").when(three.rlike("^C[ACT][ACT]$|^CHH$"), "CHH")


def kmer_class(k_mer: Column) -> Column:
    """The motif class by the three bases from the middle of a k-mer on."""
    return motif_class(F.substring(k_mer, (F.floor(F.length(k_mer) / 2) + 1).cast("int"), F.lit(3)))


def tiles(contigs: DataFrame, left: int = 0, right: int = 0, size: int = 512, large: int = 1 << 20) -> DataFrame:
    """name, begin, first, part, whole: pieces of contigs (name, seq), each `size` bases from `begin` on.

    `part` starts at `first` and has up to `left` bases before and `right` after; `whole` is the contig's length. A contig is
    cut twice, into large pieces first: finding a place in a string takes time in proportion to it, and no step does so over
    a whole chromosome for each small piece.
    """
    def cut(rows: DataFrame, start: Column, stop: Column, step: int) -> DataFrame:
        rows = rows.withColumn("_b", F.explode(F.when(stop > start, F.sequence(start, stop - 1, F.lit(step)))))
        first = F.greatest(F.col("_b") - left, F.lit(0))
        part = F.substring(F.col("part"), first - F.col("first") + 1, F.lit(step + right) + F.col("_b") - first)
        return rows.select("name", F.col("_b").alias("begin"), first.alias("first"), part.alias("part"), "whole", F.least(F.col("_b") + step, F.col("whole")).alias("end"))

    whole = contigs.select("name", F.lit(0).alias("first"), F.col("seq").alias("part"), F.length("seq").alias("whole"))
    pieces = cut(whole, F.lit(0), F.col("whole"), max(1, large // size) * size)
    return cut(pieces, F.col("begin"), F.col("end"), size).drop("end")


#: Bases of tiles that a kernel looks at together; what it finds in them is one Arrow batch.
SCANNED = 1 << 18


def few_bases(batches: Iterator[pa.RecordBatch], most: int = SCANNED) -> Iterator[pa.RecordBatch]:
    """Slices of batches of tiles whose parts have `most` bytes together, or that are one tile, so no result grows with Spark's batches."""
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(batch.column("part")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def scan_motifs(contigs: DataFrame, motifs: Iterable[str], offset: int = 0, size: int = 1 << 18) -> DataFrame:
    """name and pos of each motif's base `offset`, overlaps included, in contigs of name and seq (a byte a base)."""
    motifs = list(motifs)
    return scan_tiles(tiles(contigs, 0, len(motifs[0]) - 1, size), motifs, offset)


def scan_tiles(cut: DataFrame, motifs: Iterable[str], offset: int = 0) -> DataFrame:
    """The same in tiles that have no bases before and a motif's length less one after.

    Places in a tile are found by comparing its bytes with each motif's, in Arrow batches: built-in functions would take
    a substring at every base.
    """
    codes = [np.frombuffer(m.encode("latin-1"), dtype=np.uint8) for m in motifs]
    width = len(codes[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_bases(batches):
            names, found, sizes = batch.column("name"), [np.zeros(0, dtype=np.int64)], []
            for begin, part in zip(batch.column("begin").to_pylist(), batch.column("part").to_pylist()):
                x = np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8)
                hit = np.zeros(max(0, len(x) - width + 1), dtype=bool)
                for m in codes if len(hit) else ():
                    hit |= np.logical_and.reduce([x[j : len(hit) + j] == m[j] for j in range(width)])
                found.append(np.flatnonzero(hit) + (begin + offset))
                sizes.append(len(found[-1]))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate(found))], names=["name", "pos"])

    return cut.select("name", "begin", "part").mapInArrow(run, "name string, pos long")


#: The class of a cytosine by the two bases after it: of letters A, C, T, G, N, H and others, as codes 0 to 6. 0 stands for none.
LETTERS = np.full(256, 6, dtype=np.int64)
LETTERS[[ord(b) for b in "ACTGNH"]] = range(6)
CLASSES = (None, "CG", "CHG", "CHH")


def class_codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in CLASSES by codes of the two bases after a cytosine; the same classes as motif_class."""
    plain = lambda v: v < 3
    out = np.where((x == 3) & (y < 5), 1, 0)
    out = np.where((plain(x) | (x == 5)) & (y == 3), 2, out)
    return np.where((plain(x) & plain(y)) | ((x == 5) & (y == 5)), 3, out)


def scan_cytosines(cut: DataFrame, size: int) -> DataFrame:
    """name, pos, strand and motif (null: none) of each cytosine of either strand, in tiles of `size` with two bases more on both sides.

    On the minus strand a cytosine is a G with two bases before it; the bases after it are the complements of those.
    """
    lut = np.full(256, ord("?"), dtype=np.uint8)
    lut[[ord(b) for b in DNA]] = [ord(b) for b in DNA_COMPLEMENT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_bases(batches):
            columns = (batch.column(c).to_pylist() for c in ("begin", "first", "end", "part"))
            out: list[tuple] = []
            for i, (begin, first, end, part) in enumerate(zip(*columns)):
                x = np.frombuffer(b"??" + part.encode("latin-1", "replace") + b"??", dtype=np.uint8)
                at = np.arange(begin, end) - first + 2
                for minus, base, step in ((False, ord("C"), 1), (True, ord("G"), -1)):
                    here = at[x[at] == base]
                    codes = [LETTERS[lut[x[here + step * j]] if minus else x[here + step * j]] for j in (1, 2)]
                    some = here + first - 2 >= (2 if minus else 0)
                    out.append((np.full(some.sum(), i), here[some] + first - 2, np.full(some.sum(), minus), class_codes(*codes)[some]))
            row, pos, minus, kind = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 4
            strands = pa.DictionaryArray.from_arrays(pa.array(minus.astype(np.int8)), pa.array(["+", "-"])).cast(pa.string())
            motifs = pa.DictionaryArray.from_arrays(pa.array((kind - 1).astype(np.int8), mask=kind == 0), pa.array(CLASSES[1:])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(row)), pa.array(pos.astype(np.int64)), strands, motifs], names=["name", "pos", "strand", "motif"])

    rows = cut.select("name", "begin", "first", F.least(F.col("begin") + size, F.col("whole")).alias("end"), "part")
    return rows.mapInArrow(run, "name string, pos long, strand string, motif string")


def triplet(seq: Column, pos: Column, strand: Column) -> Column:
    """Three bases from a place on, on its strand; empty where the contig ends before or has an unknown letter."""
    plus, minus = F.substring(seq, (pos + 1).cast("int"), F.lit(3)), F.substring(seq, (pos - 1).cast("int"), F.lit(3))
    return F.when(strand == "-", F.when(pos >= 2, reverse_complement(minus, strict=True)).otherwise("")).otherwise(plus)

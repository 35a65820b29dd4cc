"""Repeated stretches within and across documents, by bytes (suffix sort) or by words (seed and extend).

A window is `length` consecutive units (bytes or words) of one document; it is repeated if the same units also start
anywhere else. Both operators start from the same seeds: of the grams of k units in a window, the one with the least hash is its
anchor, so equal windows have equal anchors, and about two of length - k + 2 positions are anchors. Then:

1. Grams are counted; anchors whose gram occurs once are dropped.
2. The context of an anchor is the run of windows that it is the anchor of. Contexts are compared by digests of their bytes;
   where two are equal, all their windows are repeated.
3. Of a gram with several contexts, one of each kind stays open. Its windows are taken in blocks by how far back from the
   anchor they start: if what all windows of a block share occurs once, none of them is repeated; if what they cover
   together occurs twice, all are. This leaves the few blocks that hold the end of a common stretch.
4. Windows of these blocks are compared one by one: the suffix sort sorts suffixes (bytes), or seeds are extended both
   ways to each window (words), and equal windows are counted.

Polynomial hashes only choose what is compared: anchors, grams, and what a block's windows share. Equal strings have equal ones,
and what is removed is decided on the bytes: by 128-bit BLAKE2 digests of whole contexts, covers and windows (words of
these are parted by one space), or by the suffix sort, which verifies its equal neighbours.

Only grams, hashes and blocks are shuffled, never all windows or pairs. Joins meet aggregated tables that were written before,
so Spark can split a frequent gram over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import WORD, save

#: Bytes of text that a task looks at in one go; a longer document is looked at alone.
CHUNK = 1 << 18
U = np.uint64


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row starts and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Rows i to j, with about `most` bytes at once."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


class Units:
    """The units (bytes or words) of rows i to j, and the place of each row's first unit."""

    def __init__(self, data: np.ndarray, at: np.ndarray, i: int, j: int, by_word: bool):
        if by_word:
            parts = [p for r in range(i, j) for p in (data[at[r] : at[r + 1]], np.array([32], np.uint8))]
            self.data, ends = R.single_spaces(np.concatenate(parts) if parts else data[:0], at[i : j + 1] - at[i] + np.arange(j - i + 1))
            self.start, self.end = R.words(self.data)
            self.first = np.searchsorted(self.start, ends)
        else:
            self.data = data[at[i] : at[j]]
            self.first = at[i : j + 1] - at[i]
        self.by_word = by_word
        self.n = int(self.first[-1])
        self.doc = np.repeat(np.arange(j - i), np.diff(self.first))

    @cached_property
    def codes(self) -> np.ndarray:
        return R.word_codes(self.data, self.start, self.end) if self.by_word else R.BYTE_CODES[self.data]

    def contents(self, lo: np.ndarray, hi: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the bytes of units lo to hi."""
        if self.by_word and len(lo):
            lo, hi = self.start[lo], self.end[hi - 1]
        return R.contents(self.data, lo, hi, tag)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _with_keys(docs: DataFrame) -> DataFrame:
    """did and rk name a row by its id and text (rows repeated whole share them); a null id is replaced by a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text, F.lit("no id"))).alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"))


def spans(docs: DataFrame, length: int, k: int, by_word: bool, hot: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Repeated stretches as rows of did, rk, s, e (units; they may overlap), and the texts of the documents concerned.

    Blocks of bytes whose windows share the same middle meet in one task and are resolved by suffix sort. Where over `hot` different
    ones share it, as they may around a passage that very many documents hold, their windows are counted by digests with
    partial sums before the shuffle, as all windows of words are, so that they are spread over tasks.
    """
    keyed = _with_keys(docs)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            did, rk = batch.column("did").to_numpy(), batch.column("rk").to_numpy()
            for i, j in chunks(at):
                u = Units(data, at, i, j, by_word)
                if u.n < length:
                    continue
                grams = R.Prefix(u.codes).every(k)
                a, first, last = R.anchors(grams, u.doc, length, k)
                d = u.doc[a]
                place = ((a - u.first[d]) << 16) | ((a - first) << 8) | (a - last)
                yield pa.RecordBatch.from_arrays([_signed(grams[a]), pa.array(did[i:j][d]), pa.array(rk[i:j][d]), pa.array(place)], names=["h", "did", "rk", "place"])

    found = keyed.select("did", "rk", "text").mapInArrow(seeds, "h long, did long, rk long, place long")
    again = save(found.groupBy("h").count().filter("count > 1").select("h"), "repeats-grams")
    by_doc = found.join(again, "h", "left_semi").groupBy("did", "rk").agg(F.collect_list(F.struct("place", "h")).alias("seeds"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for i, j in chunks(at):
                u = Units(data, at, i, j, by_word)
                d, sizes, place, h = _seeds_of(batch, "seeds", i, j, "place", "h")
                _, pos, most, least = _placed(u, d, place)
                c1, c2 = u.contents(pos - most, pos - least + length, R.mix((place & 0xFFFF).astype(U)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                seen = pa.StructArray.from_arrays([pa.array(place), pa.array(h), _signed(c1), _signed(c2)], names=["place", "h", "c1", "c2"])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("did", "rk", "text")] + [pa.ListArray.from_arrays(offsets, seen)], names=["did", "rk", "text", "seen"])

    texts = keyed.select("did", "rk", "text").join(by_doc, ["did", "rk"]).mapInArrow(contexts, "did long, rk long, text string, seen array<struct<place:long,h:long,c1:long,c2:long>>")
    texts = save(texts, "repeats-texts")
    seen = texts.select("did", "rk", F.explode("seen").alias("x")).select("did", "rk", "x.*")
    kinds = save(seen.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "rk", "place")).alias("one")), "repeats-kinds")
    pos, most, least = (F.expr(e).cast("int") for e in ("place >> 16", "(place >> 8) & 255", "place & 255"))
    whole = seen.join(kinds.filter("n > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi").select("did", "rk", (pos - most).alias("s"), (pos - least + length).alias("e"))

    # Grams that have several kinds of context, one of them at least with a single occurrence.
    several = save(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("h"), "repeats-several")
    open_ = kinds.join(several, "h").select("one.did", "one.rk", F.struct("one.place", "h", (F.col("n") == 1).alias("single")).alias("x"))
    texts = texts.select("did", "rk", "text")
    blocks = save(_blocks(open_, texts, length, by_word, block), "repeats-blocks")
    cores = save(blocks.groupBy("core").count().filter("count > 1").select("core", (F.col("count") > hot).alias("hot")), "repeats-cores")
    covers = blocks.filter("u1 is not null").groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "rk", "place")).alias("one"))
    covers = save(covers.filter("n > 1").select("u1", "u2", "one"), "repeats-covers")
    live = save(blocks.join(cores, "core").join(covers, ["u1", "u2"], "left").drop("u1", "u2"), "repeats-live")
    pos = F.expr("place >> 16").cast("int")
    covered = live.filter("single and one is not null").select("did", "rk", (pos - F.col("most")).alias("s"), (pos - F.col("least") + length).alias("e"))
    left = live.filter("one is null or (one.did = did and one.rk = rk and one.place = place)")
    left = left.select("did", "rk", F.struct("place", "core", "most", "least", (F.col("single") & F.col("one").isNull()).alias("single"), (F.col("hot") | F.lit(by_word)).alias("hot")).alias("x"))
    fine = save(_fine(left, texts, length, by_word), "repeats-fine")
    more = save(fine.filter("piece is null").groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "repeats-more")
    counted = fine.filter("piece is null and single").join(more, ["w1", "w2"], "left_semi").select("did", "rk", "s", (F.col("s") + length).alias("e"))
    out = whole.union(covered).union(counted)
    if not by_word:
        out = out.union(_by_sorting(fine.filter("piece is not null"), length))
    return out, texts


def _seeds_of(batch: pa.RecordBatch, name: str, i: int, j: int, *fields: str) -> tuple[np.ndarray, ...]:
    """For the structs in the lists of rows i to j: the row of each, the sizes of the lists, and the fields."""
    part = batch.column(name).slice(i, j - i)
    sizes, flat = part.value_lengths().to_numpy(), part.flatten()
    return np.repeat(np.arange(j - i), sizes), sizes, *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _placed(u: Units, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """From where a document starts and its anchor's place: the start, the anchor, and how far back its windows start."""
    own = u.first[d]
    return own, own + (place >> 16), (place >> 8) & 255, place & 255


def _opened(open_: DataFrame, texts: DataFrame) -> DataFrame:
    lists = open_.groupBy("did", "rk").agg(F.collect_list("x").alias("open"))
    return texts.join(lists, ["did", "rk"])


def _blocks(open_: DataFrame, texts: DataFrame, length: int, by_word: bool, block: int) -> DataFrame:
    """Blocks of the open anchors' windows: a hash of what all windows of a block share (core), and the digest of what they cover (u1, u2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for i, j in chunks(at):
                u = Units(data, at, i, j, by_word)
                d, _, place, h, single = _seeds_of(batch, "open", i, j, "place", "h", "single")
                _, _, most, least = _placed(u, d, place)
                many = most // block - least // block + 1
                r = np.repeat(np.arange(len(d)), many)
                q = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + (least // block)[r]
                own, pos, most, least = _placed(u, d[r], place[r])
                tag = R.mix(h[r].view(U) + q.astype(U) * U(R.BASES[1]))
                core = R.mix(R.Prefix(u.codes).raw(pos - q * block, pos - (q + 1) * block + 1 + length) + tag)
                lo, hi = pos - (q + 1) * block + 1, pos - q * block + length
                fits = (lo >= own) & (hi <= u.first[d[r] + 1])
                lo, hi = np.where(fits, lo, own), np.where(fits, hi, own + 1)
                cover = [pa.array(x.view(np.int64), mask=~fits) for x in u.contents(lo, hi, tag)]
                ids = [batch.column(c).slice(i, j - i).take(pa.array(d[r])) for c in ("did", "rk")]
                inside = [np.minimum(most, (q + 1) * block - 1), np.maximum(least, q * block)]
                yield pa.RecordBatch.from_arrays([_signed(core), *cover, *ids, pa.array(place[r]), *(pa.array(x.astype(np.int32)) for x in inside), pa.array(single[r].astype(bool))], names=["core", "u1", "u2", "did", "rk", "place", "most", "least", "single"])

    return _opened(open_, texts).mapInArrow(run, "core long, u1 long, u2 long, did long, rk long, place long, most int, least int, single boolean")


def _fine(left: DataFrame, texts: DataFrame, length: int, by_word: bool) -> DataFrame:
    """What is compared window by window: the digest of each window (w1, w2), or the piece of text that holds a block's windows.

    Equal windows also start as far back from an anchor with the same gram, so their blocks have the same core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for i, j in chunks(at):
                u = Units(data, at, i, j, by_word)
                d, _, place, core, most, least, single, hot = _seeds_of(batch, "open", i, j, "place", "core", "most", "least", "single", "hot")
                ids = [batch.column(c).slice(i, j - i) for c in ("did", "rk")]
                own, pos = u.first[d], u.first[d] + (place >> 16)

                def rows(r, w1, w2, back, pieces):
                    s = (pos[r] - own[r] - back).astype(np.int32)
                    return pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(core[r]), *(x.take(pa.array(d[r])) for x in ids), pa.array(s), pa.array(back.astype(np.int32)), pa.array(single[r].astype(bool)), pieces], names=["w1", "w2", "core", "did", "rk", "s", "back", "single", "piece"])

                r = np.flatnonzero(hot.astype(bool))
                many = (most - least + 1)[r]
                back = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                r = np.repeat(r, many)
                back = back + least[r]
                x = pos[r] - back
                w1, w2 = (w.view(np.int64) for w in u.contents(x, x + length, R.mix(core[r].view(U) + back.astype(U))))
                yield rows(r, w1, w2, back, pa.nulls(len(r), pa.binary()))
                r = np.flatnonzero(~hot.astype(bool))
                if len(r):
                    pieces = [u.data[a:b].tobytes() for a, b in zip(pos[r] - most[r], pos[r] - least[r] + length)]
                    yield rows(r, np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), most[r].astype(np.int64), pa.array(pieces, pa.binary()))

    return _opened(left, texts).mapInArrow(run, "w1 long, w2 long, core long, did long, rk long, s int, back int, single boolean, piece binary")


def _by_sorting(pieces: DataFrame, length: int) -> DataFrame:
    """Sort the suffixes of the pieces that share a core, and take neighbours that are equal over the whole length."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "core", 4000):
            core, s, back, single = (table.column(c).to_numpy(zero_copy_only=False) for c in ("core", "s", "back", "single"))
            data, at = column_bytes(table.column("piece"))
            data, at = data[at[0] : at[-1]], at - at[0]
            # A suffix for each window of a piece; its group is the core and how far back from the anchor the window starts.
            many = np.diff(at) - length + 1
            r = np.repeat(np.arange(len(core)), many)
            inner = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            _, shared = np.unique(core, return_inverse=True)
            order, same = R.suffix_sort(data.astype(U) + U(1), shared[r] * 256 + (back[r] - inner), at[r] + inner, length)
            hit = order[same | np.append(same[1:], False)]
            hit = hit[single[r[hit]].astype(bool)]
            start = (s[r[hit]] + inner[hit]).astype(np.int32)
            ids = [table.column(c).take(pa.array(r[hit])) for c in ("did", "rk")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start), pa.array(start + np.int32(length))], names=["did", "rk", "s", "e"])

    rows = pieces.select("core", "did", "rk", "s", "back", "single", "piece")
    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(resolve, "did long, rk long, s int, e int")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches of about `rows` that never cut a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            held.append(batch.slice(i, rows))
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
            keys = table.column(key).to_numpy()
            end = int(np.searchsorted(keys == keys[-1], True)) if keys[-1] != keys[0] else 0
            if end:
                yield table.slice(0, end)
            held = [table.slice(end)]
    if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield table.to_batches(max_chunksize=None)[0]


def _kept(docs: DataFrame, length: int, k: int, by_word: bool, whole: list, returned: list, hot: int, block: int) -> DataFrame:
    stretches, texts = spans(docs, length, k, by_word, hot, block)
    lists = stretches.groupBy("did", "rk").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            sizes = batch.column("cuts").value_lengths().to_numpy()
            _, _, s, e = _seeds_of(batch, "cuts", 0, batch.num_rows, "s", "e")
            stop = np.cumsum(sizes)
            removed, runs, digest = [], [], []
            for i in range(batch.num_rows):
                u = Units(data, at, i, i + 1, by_word)
                gone = R.covered(s[stop[i] - sizes[i] : stop[i]], e[stop[i] - sizes[i] : stop[i]], u.n)
                removed.append(int(gone.sum()))
                runs.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                if by_word:
                    rest = b" ".join(u.data[a:b].tobytes() for a, b in zip(u.start[~gone], u.end[~gone]))
                else:
                    rest = u.data[~gone].tobytes()
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["did", "rk", "n_removed", "n_spans", "cut_sha256"])

    cut = texts.join(lists, ["did", "rk"]).mapInArrow(remove, "did long, rk long, n_removed long, n_spans long, cut_sha256 string").dropDuplicates(["did", "rk"])
    rows = _with_keys(docs).select("doc_id", "did", "rk", *whole)
    out = rows.join(cut, ["did", "rk"], "left")
    return out.select("doc_id", *returned)


def byte_repeats(docs: DataFrame, length: int = 200, k: int = 100, hot: int = 4096, block: int = 16) -> DataFrame:
    """Suffix-array deduplication: remove each byte that a repeated string of `length` bytes covers.

    Returns per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Edge cases: a null text is empty; a text shorter than `length` keeps all bytes; matches never cross documents, and a string may
    repeat within one; rows repeated whole repeat each other; a null doc_id is kept; an empty table gives no rows; other
    columns are not read. A document is looked at whole by a task, at about 60 bytes of memory for each of its bytes.
    """
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")]
    zero = F.lit(0).cast("long")
    return _kept(docs, length, k, False, whole, [F.col("n_bytes"), F.coalesce(F.col("n_removed"), zero).alias("n_removed"), F.coalesce(F.col("n_spans"), zero).alias("n_spans"), F.coalesce("cut_sha256", "whole").alias("kept_sha256")], hot, block)


def word_repeats(docs: DataFrame, length: int = 35, k: int = 18, block: int = 6) -> DataFrame:
    """Substring deduplication by seeds: remove each word that a repeated window of `length` words covers.

    Returns per row doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), n_spans.

    Edge cases: a null text has no words, and the digest of no bytes; a text with fewer than `length` words keeps all; windows never cross
    documents, and one may repeat within a document; rows repeated whole repeat each other; an empty table gives no rows;
    other columns are not read. A document is looked at whole by a task.
    """
    flat = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    whole = [F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.sha2(flat, 256).alias("whole")]
    zero = F.lit(0).cast("long")
    return _kept(docs, length, k, True, whole, [F.col("n_words"), F.coalesce(F.col("n_removed"), zero).alias("n_removed"), F.coalesce("cut_sha256", "whole").alias("kept_sha256"), F.coalesce(F.col("n_spans"), zero).alias("n_spans")], 0, block)

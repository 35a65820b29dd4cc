"""Audit of how sources diverge in their words, from each other and from their language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Terms are runs of ASCII letters and bytes of other characters; only A-Z are lowered.
TERM, BETWEEN = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
SLICE, HELD = 1 << 20, 800_000
UNIT = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, n_docs long"
SKY = "lang string, source string, term string, n long, lang_n long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists for slices that end between terms, so a long text isn't held as one list."""
    text, at = text.lower(), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            gap = BETWEEN.search(text, end)
            end = gap.start() if gap else len(text)
        yield TERM.findall(text, at, end)
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """Counts by lang, source and term, combined within a task, and one row with the empty term for each group that a task met."""

    def emit(counts: dict, met: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            names = [b"", *found]
            n, n_docs = [0, *found.values()], [0, *(met[lang, source][t] for t in found)]
            for i in range(0, len(names), 65536):
                part = names[i : i + 65536]
                cells = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n[i : i + 65536], pa.int64()), pa.array(n_docs[i : i + 65536], pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "term", "n", "n_docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        met: dict[tuple[str, str], Counter] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                of = counts.setdefault((lang, source), Counter())
                here: set[bytes] = set()
                for found in terms(text.as_py()):
                    of.update(found)
                    here.update(found)
                met.setdefault((lang, source), Counter()).update(here)
            if sum(map(len, counts.values())) > HELD:
                yield from emit(counts, met)
                counts, met = {}, {}
        yield from emit(counts, met)

    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(count, COUNTS)


def scaled(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + 2) / total) of two columns, exact."""
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(19,0)) div cast({total} as decimal(19,0))")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same of a matrix (terms x groups); by decimal digits where the product doesn't fit."""
    if int(counts.max(initial=0)) + 2 < 2**63 // UNIT:
        return 1 + UNIT * (counts + 2) // totals
    out, rest = (counts + 2) // totals, (counts + 2) % totals
    for _ in range(9):
        rest = rest * 10
        out, rest = out * 10 + rest // totals, rest % totals
    return 1 + out


def skyband(n: np.ndarray, lang_n: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms that fewer than k others dominate: n not lower, lang_n not higher, and earlier in UTF-8.

    In the order of falling n, rising lang_n and name, dominators come first, and who is dominated by k others is dominated by k
    that stay, so each term is compared with those that stayed.
    """
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((rank, lang_n, -n))
    low, place = lang_n[order], rank[order]
    stay = np.zeros(0, dtype=np.int64)
    for at in range(0, len(order), 512):
        block = slice(at, at + 512)
        over = ((low[stay] <= low[block, None]) & (place[stay] < place[block, None])).sum(axis=1)
        some = at + np.flatnonzero(over < k)
        # A block's terms count all of each other: k that dominate one that goes dominate whatever that one does.
        own = (low[some] <= low[some, None]) & (place[some] < place[some, None]) & (some < some[:, None])
        stay = np.concatenate([stay, some[over[some - at] + own.sum(axis=1) < k]])
    return order[stay]


def _narrowed(held: dict, k: int) -> dict:
    return {group: [x[stay] for x in columns] for group, columns in held.items() for stay in [skyband(*columns, k)]}


def _table(held: dict) -> pa.Table:
    sizes = [len(columns[0]) for columns in held.values()]
    langs, sources = ([g[i] for g, m in zip(held, sizes) for _ in range(m)] for i in (0, 1))
    n, lang_n, names = (np.concatenate([columns[i] for columns in held.values()]) if held else [] for i in range(3))
    return pa.table({"lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "term": pa.array(names, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64()), "lang_n": pa.array(lang_n, pa.int64())})


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    known = column.dictionary_encode()
    return known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary.to_pylist()


def local_skybands(kept: DataFrame, k: int) -> DataFrame:
    """The skyband of each group's terms within each partition of `kept` (lang, term, lang_n, sources)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("sources")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            n = lists.flatten().field("n").to_numpy(zero_copy_only=False)
            (lang, langs), (source, sources) = _codes(batch.column("lang")), _codes(lists.flatten().field("source"))
            names = np.array(batch.column("term").cast(pa.binary()).to_pylist(), dtype=object)
            lang_n = batch.column("lang_n").to_numpy(zero_copy_only=False)
            group = lang[row] * max(1, len(sources)) + source
            order = np.argsort(group, kind="stable")
            order = order[n[order] > 0]
            for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                at = row[some]
                columns = [n[some], lang_n[at], names[at]]
                key = (langs[group[some[0]] // len(sources)], sources[group[some[0]] % len(sources)])
                columns = [np.concatenate(x) for x in zip(held[key], columns)] if key in held else columns
                stay = skyband(*columns, k)
                held[key] = [x[stay] for x in columns]
            if sum(len(x[0]) for x in held.values()) > HELD:
                yield from _table(held).to_batches()
                held = {}
        yield from _table(held).to_batches()

    return kept.mapInArrow(run, SKY)


def merged_skybands(bands: DataFrame, k: int) -> DataFrame:
    """One skyband for each lang, source and slot."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column("n").to_numpy(), table.column("lang_n").to_numpy(), np.array(table.column("term").cast(pa.binary()).to_pylist(), dtype=object)]
        return _table(_narrowed({(table.column("lang")[0].as_py(), table.column("source")[0].as_py()): columns}, k))

    return bands.groupBy("lang", "source", "slot").applyInArrow(run, SKY)


def pair_sums(kept: DataFrame, groups: DataFrame, width: int = 256, chunk: int = 4096) -> DataFrame:
    """lang, source, item, value: the divergence of each two sources of a lang, summed over all kept terms.

    Sources are numbered within their lang and cut into blocks of `width`, terms into chunks of about `chunk`; a task holds the counts of a
    chunk's terms in two blocks as a matrix, and sends one sum for each two sources.
    """
    numbered = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("block", F.expr(f"i div {width}"))
    deal = numbered.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.max("n_terms") / chunk)).cast("long").alias("chunks"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sides = numbered.join(deal, "lang").select("lang", "source", "total", "block", numbers("blocks").alias("other"), "chunks").select("*", numbers("chunks").alias("chunk"))
    sides = sides.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "chunk", "source", "total", "block")
    rows = kept.select("lang", "term", "sources").join(deal, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).withColumn("a", numbers("blocks")).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)))
    key = ["lang", "a", "b", "chunk"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        sources, totals, block = right.column("source").to_pylist(), right.column("total").to_numpy(), right.column("block").to_numpy()
        place = {s: i for i, s in enumerate(sources)}
        sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
        if left.num_rows:
            lists = left.column("sources").combine_chunks()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            at = np.array([place.get(s, -1) for s in flat.field("source").to_pylist()], dtype=np.int64)
            counts = np.zeros((len(lists), len(sources)), dtype=np.int64)
            counts[row[at >= 0], at[at >= 0]] = flat.field("n").to_numpy(zero_copy_only=False)[at >= 0]
            p = shares(counts, totals)
            for i in range(len(sources) - 1):
                d, s = p[:, i + 1 :] - p[:, [i]], p[:, i + 1 :] + p[:, [i]]
                sums[i, i + 1 :] = (d * d // s).sum(axis=0)
        i, j = np.triu_indices(len(sources), 1)
        if right.num_rows and right.column("a")[0].as_py() != right.column("b")[0].as_py():
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]  # pairs within a block have a task of their own
        names = np.array(sources, dtype=object)
        lang = right.column("lang")[0].as_py() if right.num_rows else ""
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array(names[i].tolist(), pa.string()), "item": pa.array(names[j].tolist(), pa.string()), "value": pa.array(sums[i, j], pa.int64())})

    parts = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(run, "lang string, source string, item string, value long")
    whole = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return whole.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a lang differs from its other sources (`pair`) and in which terms from the lang (`term`).

    A lang keeps the terms that at least `least_docs` of its documents have. Of a group (lang and source) or a whole lang, a term has
    p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N being the counts' sum and V the number of kept terms; two groups differ
    in a term by floor((p - q)^2 / (p + q)). Part `pair` has every other source of the lang with the sum over all kept terms, part `term` the k terms that
    the group has, with p over the lang's, of largest difference. Arithmetic is exact.

    For `term`, the difference grows with the count in the group and falls with that in the lang, so a term that k others dominate in both and in
    the order of names can't be among the first k: partitions keep skybands, these are merged in slots, and what is left is ranked exactly.

    Edge cases: null text, lang and source count as empty, and the empty string is a lang or source as any other; a group without kept terms has
    pairs but no terms; a lang with one source has no pairs; without kept terms sums are 0; repeated rows count each; an empty table gives no rows;
    other columns are not read.
    """
    whole = F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(*whole)
    found = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    table = save(found.filter((F.col("n_docs") >= least_docs) | (F.col("term") == "")), "audit-terms")
    kept = table.filter("term <> ''")
    langs = table.groupBy("lang").agg(F.sum("lang_n").alias("lang_sum"), F.count_if(F.col("term") != "").alias("n_terms"))
    sums = table.select("lang", F.explode("sources").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("group_sum"))
    groups = sums.join(langs, "lang").select("lang", "source", (F.col("group_sum") + 2 * F.col("n_terms")).alias("total"), (F.col("lang_sum") + 2 * F.col("n_terms")).alias("lang_total"), "n_terms")
    groups = save(groups, "audit-groups")

    bands = local_skybands(kept, k).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(32)))
    p, q = scaled("n", "total"), scaled("lang_n", "lang_total")
    rated = merged_skybands(bands, k).join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).filter("p > q")
    rated = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rated = rated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    pairs = pair_sums(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(rated)

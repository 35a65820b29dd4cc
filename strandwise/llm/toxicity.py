"""A linear classifier of toxicity over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import save
from .repeats import chunks

U = np.uint64
#: Sizes of n-grams in characters (code points).
SIZES = (2, 3, 4, 5, 6)
FACTORS = R.mix(np.arange(1, 7, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
#: Bits of the filter through which n-grams pass before they are looked up.
FILTER_BITS = 22


@dataclass
class Model:
    """The weight of each n-gram by its 64-bit hash, in order of the hashes, and the intercept."""

    grams: np.ndarray
    weight: np.ndarray
    intercept: float

    @cached_property
    def likely(self) -> np.ndarray:
        hit = np.zeros(1 << FILTER_BITS, dtype=bool)
        hit[(self.grams >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        return hit

    def places(self, hashed: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places of the n-grams that are here, and what stands beside them in `others`."""
        some = np.flatnonzero(self.likely[(hashed >> U(64 - FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.grams, hashed[some])
        here = self.grams[np.minimum(at, len(self.grams) - 1)] == hashed[some] if len(self.grams) else np.zeros(0, dtype=bool)
        return at[here], *(x[some[here]] for x in others)


def characters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of lower-cased texts, any white space as one kind, and the row of each."""
    lower = [t.lower() for t in texts]
    x = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (x <= 32) | (x == 0xA0) | (x == 0x3000) | ((x >= 0x2000) & (x <= 0x200B))
    return np.where(space, np.uint32(32), x).astype(U), np.repeat(np.arange(len(lower)), [len(t) for t in lower])


def grams(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashed n-grams of the texts' characters, and their rows."""
    x, row = characters(texts)
    total = x * FACTORS[0]
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            return
        total = total[:-1] + x[n - 1 :] * FACTORS[n - 1]
        if n in SIZES:
            own = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
            yield R.mix(total[own] + U(n)), row[own]


def values(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log(1 + occurrences in each 1000 characters), so that a long text gains nothing by its length."""
    return np.log1p(1000.0 * counts / lengths)


def known_values(texts: Sequence[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's n-grams in each text: their places, rows and values."""
    n, keys = max(1, len(model.grams)), [np.zeros(0, dtype=np.int64)]
    for hashed, row in grams(texts):
        at, row = model.places(hashed, row)
        keys.append(row * n + at)
    keys, count = np.unique(np.concatenate(keys), return_counts=True)
    row = keys // n
    return keys % n, row, values(count, np.array([len(t.lower()) for t in texts])[row])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Rows i to j and their texts, about a chunk of bytes at once."""
    texts = batch.column("text").to_pylist()
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for i, j in chunks(at):
        yield i, j, texts[i:j]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, error: float = 3.0, passes: int = 200, penalty: float = 1e-4) -> Model:
    """Learn from labelled rows that are not held out.

    At most `per_class` rows of each class are taken, by a hash of their id and text, so repeated ids don't make them more; their whole texts count. For each n-gram
    Spark sums its values over the rows of either class; those whose log-count ratio is `error` times its standard error or more
    are features, however many there are. A logistic regression then weighs them, each scaled by its ratio. The driver gets the
    features and their values in the sampled rows: with the defaults, 8000 rows at most.
    N-grams stand as 64-bit hashes. Labels that are null, disagree (the larger counts) or name no document do no harm; without rows of
    both classes all scores are the share of toxic labels (0 without labels).
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = save(known, "toxic-labels")
    prior = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = lambda rows, y, *order: rows.filter(F.col("toxic") == y).orderBy(*order).limit(per_class)
    both = lambda rows, *order: take(rows, 1, *order).union(take(rows, 0, *order))
    # Ids first, so that no other text is looked at; an id may have any number of rows, so these are counted next, by hashes alone; then texts.
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    hashed = whole.join(F.broadcast(both(known, F.xxhash64("doc_id"), "doc_id")), "doc_id").select("doc_id", "toxic", "h")
    picked = save(both(hashed, F.xxhash64("doc_id"), "doc_id", "h").groupBy("doc_id", "toxic", "h").agg(F.count(F.lit(1)).cast("int").alias("times")), "toxic-picked")
    texts = whole.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic", "times").agg(F.first("text").alias("text"))
    texts = texts.select("doc_id", "text", "toxic", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    texts = save(texts.repartition(docs.sparkSession.sparkContext.defaultParallelism).select("doc_id", "text", "toxic"), "toxic-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("toxic").to_numpy()
            for i, _, part in _pieces(batch):
                lengths, own = np.array([len(t.lower()) for t in part]), y[i : i + len(part)] == 1
                for hashed, row in grams(part):
                    order = np.lexsort((row, hashed))
                    hashed, row = hashed[order], row[order]
                    new = np.flatnonzero(np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])])) if len(row) else order
                    value = values(np.diff(np.append(new, len(row))), lengths[row[new]])
                    toxic, hashed = own[row[new]], hashed[new]
                    first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]])) if len(new) else new
                    sums = [np.add.reduceat(np.where(toxic == c, value, 0.0), first) if len(first) else value for c in (False, True)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashed[first].view(np.int64)), *map(pa.array, sums)], names=["gram", "clean", "toxic"])

    n = {r.toxic: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = prior.get(1, 0) / max(1, sum(prior.values()))
        return Model(np.zeros(0, U), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ratio = F.log((F.col("toxic") + 1.0) / (n[1] + 2.0)) - F.log((F.col("clean") + 1.0) / (n[0] + 2.0))
    off_by = F.sqrt(1.0 / (F.col("toxic") + 1.0) + 1.0 / (F.col("clean") + 1.0))
    sums = texts.select("text", "toxic").mapInArrow(counted, "gram long, clean double, toxic double").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = sums.select("gram", ratio.alias("ratio"), (F.abs(ratio) / off_by).alias("z")).filter(F.col("z") >= error).select("gram", "ratio").toArrow()
    hashed, ratios = best.column("gram").to_numpy().view(U), best.column("ratio").to_numpy()
    order = np.argsort(hashed)
    features, scale = Model(hashed[order], np.zeros(len(order)), 0.0), ratios[order]
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in _pieces(batch):
                at, row, value = known_values(part, shared.value)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(a)) for a in (at.astype(np.int32), value.astype(np.float32)))], names=["toxic", "x", "value"])

    rows = texts.select("text", "toxic").mapInArrow(held, "toxic int, x array<int>, value array<float>").toArrow().combine_chunks()
    y = rows.column("toxic").to_numpy().astype(float)
    x, value = (rows.column(c).combine_chunks() for c in ("x", "value"))
    row, col = np.repeat(np.arange(len(y), dtype=np.int32), x.value_lengths().to_numpy()), x.flatten().to_numpy()
    value = value.flatten().to_numpy() * scale[col]
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, passes + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, value * w[col], minlength=len(y)), -30, 30)))
        off = (p - y) / len(y)
        g = np.append(np.bincount(col, value * off[row], minlength=len(scale)) + penalty * w, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    b += np.log(prior[1] / prior[0]) - np.log(n[1] / n[0])  # the classes' shares among all labels, not in the sample
    return Model(features.grams, scale * w, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row, over its whole text; and the columns that `keep` names.

    Edge cases: a null or empty text is scored by the intercept alone; a null doc_id isn't held out; repeated rows get
    the same score; an empty table gives no rows; other columns are not read. The broadcast model is as large as the
    features of the bounded sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, part in _pieces(batch):
                at, row, value = known_values(part, m)
                total = m.intercept + np.bincount(row, m.weight[at] * value, minlength=j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], names=[*names, "score"])

    extra = [c for c in keep if c != "doc_id"]
    names = ["doc_id", "held_out", *(f"keep_{c}" for c in extra)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), *(F.col(c).alias(f"keep_{c}") for c in extra), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    types = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    scored = rows.mapInArrow(run, f"doc_id long, held_out boolean{types}, score double").withColumnsRenamed({f"keep_{c}": c for c in extra})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

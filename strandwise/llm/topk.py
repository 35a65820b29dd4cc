"""Exact top-k by inner product over an impact-ordered index of integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, save

INDEX = "block int, dim int, ids array<long>, vectors array<long>, docs array<int>, dims array<int>, highs array<long>, lows array<long>, starts array<int>"
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as a double, of the rows that take part: not empty, all components finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.floor(x.cast("double") * scale), F.lit(LEAST)))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(rows: DataFrame, blocks: int, levels: int = 32) -> DataFrame:
    """One row per block of vectors (`rows`: block, vec_id, v, of one dimension): posting lists by dimension, in segments of falling impact.

    A vector has a posting in each dimension. A block's postings of a dimension are quantised to `levels` steps between their largest
    and smallest value; a segment is the postings of one step, with its largest and smallest value as bounds.
    """

    def build(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        n, d = v.shape
        high, low = v.max(axis=0).astype(object), v.min(axis=0).astype(object)
        step = ((high - low) // levels + 1).astype(np.float64)
        level = np.minimum((v.max(axis=0).astype(np.float64) - v.astype(np.float64)) // step, levels).astype(np.int64)
        docs = np.argsort(level, axis=0, kind="stable").T.ravel()
        of = np.repeat(np.arange(d), n)
        key = of * (levels + 1) + level[docs, of]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        values = v[docs, of]
        cells = {
            "block": table.column("block")[0].as_py(), "dim": d, "ids": table.column("vec_id").combine_chunks(), "vectors": v.ravel(), "docs": docs.astype(np.int32), "dims": of[starts].astype(np.int32),
            "highs": np.maximum.reduceat(values, starts), "lows": np.minimum.reduceat(values, starts), "starts": np.append(starts, n * d).astype(np.int32),
        }
        return pa.table({k: pa.array([x], pa.int32()) if isinstance(x, int) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for k, x in cells.items()})

    return rows.groupBy("block").applyInArrow(build, INDEX)


class Block:
    """The index of a block, as arrays."""

    def __init__(self, row: pa.Table):
        flat = lambda c: row.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = row.column("ids").combine_chunks().flatten()
        self.lacks = np.asarray(ids.is_null())
        self.ids = ids.fill_null(MOST).to_numpy(zero_copy_only=False)
        self.vectors = flat("vectors").reshape(len(self.ids), -1)
        self.docs, self.dims, self.highs, self.lows, self.starts = (flat(c) for c in ("docs", "dims", "highs", "lows", "starts"))
        self.largest = max(abs(int(self.vectors.max())), abs(int(self.vectors.min())))

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ query

    def best(self, query: np.ndarray, k: int, threshold: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and exact scores of the block's best k rows for a query, those under `threshold` (a k-th best score known elsewhere) left out."""
        mine = (self.ids == own) & ~self.lacks
        if self.largest * max(abs(int(query.max())), abs(int(query.min()))) * len(query) >= 2**53:
            exact = self.vectors.astype(object) @ query.astype(object)  # beyond what doubles hold: every row, in whole numbers of any size
            at, scores = np.flatnonzero(~mine), np.array([min(max(int(x), LEAST), MOST) for x in exact], dtype=np.int64)[~mine]
        else:
            at = self.possible(query, k, threshold, mine)
            scores = self.scores(at, query)
        if threshold is not None:
            at, scores = at[scores >= threshold], scores[scores >= threshold]
        order = np.lexsort((self.ids[at], self.lacks[at], -scores))[:k]
        return at[order], scores[order]

    def possible(self, query: np.ndarray, k: int, threshold: int | None, mine: np.ndarray) -> np.ndarray:
        """Ordinals of all rows that may be among the best k.

        Segments are read by falling quantised impact. What hasn't been read of a dimension adds at most `rest`, the largest impact
        of a segment that is left, or the dimension's largest impact, if less. So a row that n of the read segments hold has the bound
        (their impacts) + sum of min(rest, largest impact) over dimensions - n * rest. Reading ends only when rows whose bound reaches
        the k-th best exact score known cost no more to rescore than the next segments cost to read.
        """
        q = query[self.dims]
        impact = np.where(q > 0, q * self.highs, q * self.lows)
        live = np.flatnonzero(q)
        if not len(live):
            return np.flatnonzero(~mine)
        heads = np.flatnonzero(np.concatenate([[True], self.dims[live][1:] != self.dims[live][:-1]]))
        largest = np.maximum.reduceat(impact[live], heads)
        live = live[np.argsort(-impact[live], kind="stable")]
        unit = (int(impact[live[0]]) - int(impact[live[-1]])) // 32 + 1
        level = impact[live] // unit
        cuts = [*np.flatnonzero(level[1:] != level[:-1]) + 1, len(live)]
        size = self.starts[live + 1] - self.starts[live]
        bound, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        known, low = np.full(len(self.ids), False), threshold
        exact: list[int] = []
        begin = 0
        for j, end in enumerate(cuts):
            segments = live[begin:end]
            docs = np.concatenate([self.docs[self.starts[s] : self.starts[s + 1]] for s in segments])
            bound += np.bincount(docs, np.repeat(impact[segments], size[begin:end]), len(bound))
            seen += np.bincount(docs, minlength=len(seen))
            begin = end
            rest = float(impact[live[end]]) if end < len(live) else 0.0
            upper = bound + (np.minimum(rest, largest).sum() - seen * rest if end < len(live) else 0.0)
            upper[mine] = -np.inf
            likely = np.argpartition(-upper, min(2 * k, len(upper) - 1))[: 2 * k]
            likely = likely[~known[likely] & ~mine[likely]]
            known[likely] = True
            exact = sorted([*exact, *self.scores(likely, query).tolist()], reverse=True)[:k]
            if len(exact) == k:
                low = exact[-1] if low is None else max(low, exact[-1])
            if low is not None:
                left = np.flatnonzero(upper >= low)
                ahead = int(size[end : cuts[j + 1]].sum()) if end < len(live) else 0
                if end == len(live) or len(left) * len(query) <= ahead:
                    return left
        return np.flatnonzero(~mine)


def _asked(index: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each block for the queries that are dealt to it (both have the columns `key`)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            block = Block(left)
            for own, query, threshold in zip(right.column("query_id").to_pylist(), _matrix(right.column("v")), right.column("threshold").to_pylist()):
                at, scores = block.best(query, k, threshold, own)
                out[0] += [own] * len(at)
                out[1] += [None if block.lacks[i] else int(block.ids[i]) for i in at]
                out[2] += scores.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out)})

    return index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")


def search(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 4096, levels: int = 32, together: int = 4096
) -> DataFrame:
    """The k candidates of highest score for each query: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Components become floor(scale * x); the score is their integer inner product, and the result is exact. `queries` are rows of the same
    columns; without it, those whose id is divisible by `every`. A candidate is every row whose id isn't the query's.

    Vectors are dealt into blocks of about `block` rows, each indexed on its own (build_index), and queries to all blocks, at most about `together`
    of them at a time. A first pass asks one block for each query, whose k-th best score is a threshold for all the others.

    Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; zero vectors do, with scores of 0; of several dimensions
    the most frequent (the smaller of ties) takes part; a row without an id is a candidate, after all others at ties, and no query; of queries that share an id the
    least vector is asked, and rows that share an id are candidates each; components and scores beyond a long are the nearest long;
    fewer than k candidates are all returned; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = save(integers(vectors, id_col, vector_col, scale), "topk-vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.filter(F.size("v") == dims.d)
    blocks = -(-dims["count"] // block)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    index = save(build_index(row_keys(rows, "_key").select(deal("_key", blocks).alias("block"), "vec_id", "v"), blocks, levels), "topk-index")
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else integers(queries, id_col, vector_col, scale).filter(F.col("vec_id").isNotNull() & (F.size("v") == dims.d))
    asked = save(asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "topk-queries")
    unknown = asked.withColumn("threshold", F.lit(None).cast("long"))
    if blocks > 1:
        first = _asked(index, unknown.withColumn("block", deal("query_id", blocks)), ["block"], k)
        reached = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("threshold"))
        unknown = save(asked.join(reached, "query_id", "left"), "topk-thresholds")
    chunks = max(1, -(-asked.count() // together))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = _asked(index.withColumn("chunk", every_of(chunks)), unknown.withColumn("chunk", deal("query_id", chunks)).withColumn("block", every_of(blocks)), ["block", "chunk"], k)
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

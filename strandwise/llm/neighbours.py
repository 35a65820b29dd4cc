"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save


FOUND = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))


@dataclass
class Router:
    """A linear softmax classifier from a vector to partitions, and how many partitions a query looks at."""

    weight: np.ndarray
    intercept: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """The partitions of each row, the most probable first (ties: the smaller number)."""
        return np.argsort(-(x @ self.weight + self.intercept), axis=1, kind="stable")


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None) -> DataFrame:
    """vec_id and v of the rows that take part: finite, not zero, without nulls, of one dimension."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return rows if dim is None else rows.filter(F.size("v") == dim)


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out, in blocks."""
    out = np.zeros((len(x), k), dtype=np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Partition the neighbour graph into parts of almost equal size that cut few edges.

    It starts from the order along random splits (halves of halves by a projection), then moves vertices, those that gain most
    first, to the part that most of their neighbours are in, as long as that part isn't over its size.
    """
    rng, n = np.random.default_rng(seed), len(x)
    part = np.zeros(n, dtype=np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        halves = []
        for g in groups:
            a, b = rng.integers(len(g), size=2)
            order = np.argsort(x[g] @ (x[g[a]] - x[g[b]] + 1e-9 * rng.standard_normal(x.shape[1])), kind="stable")
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = halves
    for p, g in enumerate(groups):
        part[g] = p
    limit = int(np.ceil(1.05 * n / len(groups)))
    rows = np.repeat(np.arange(n), near.shape[1])
    a, b = np.concatenate([rows, near.ravel()]), np.concatenate([near.ravel(), rows])  # both ways
    for _ in range(rounds):
        votes = np.bincount(a * len(groups) + part[b], minlength=n * len(groups)).reshape(n, -1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=len(groups)), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < limit:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def fit(sample: np.ndarray, parts: int, k: int = 20, steps: int = 150, seed: int = 3) -> Router:
    """Partition the neighbour graph of the sample and learn to route; `probes` is all partitions until it is measured.

    The classifier's target for a vector is how its neighbours spread over the partitions.
    """
    n, d = sample.shape
    near = neighbour_lists(sample, min(k, n - 1))
    part = balanced_parts(sample, near, parts, seed=seed)
    parts = int(part.max()) + 1
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0 / (near.shape[1] + 1))
    goal[np.arange(n), part] += 1.0 / (near.shape[1] + 1)
    scale = 1.0 / max(1e-12, float(np.sqrt((sample**2).mean())))
    x = sample * scale
    w, b = np.zeros((d, parts)), np.zeros(parts)
    m, v = np.zeros((d + 1, parts)), np.zeros((d + 1, parts))
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - goal) / n
        g = np.vstack([x.T @ off, off.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return Router(w * scale, b, parts)


def measured_probes(index: DataFrame, asked: DataFrame, router: Router, k: int, recall: float, held: int = 256) -> int:
    """The least number of partitions in which `held` of the queries find `recall` of their true neighbours.

    True neighbours are those among all indexed vectors (vec_id, v, part), by brute force: each task keeps the k best of each of the few
    queries, which are merged. So what the router misses is seen, whatever the norms of vectors are; and nothing is left to what a sample shows.
    """
    picked = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(held).toPandas()
    if not len(picked):
        return len(router.intercept)
    queries = np.array(picked["v"].tolist(), dtype=np.float64)
    own = picked["vec_id"].to_numpy()
    place = np.argsort(router.order(queries), axis=1)  # where a partition stands in a query's order
    shared = index.sparkSession.sparkContext.broadcast((queries, own, place))

    def run(batches):
        q, ids, order = shared.value
        best, at = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype=np.int64)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = q @ v.T
            s[ids[:, None] == batch.column("vec_id").to_numpy()[None, :]] = -np.inf
            best, at = np.hstack([best, s]), np.hstack([at, order[:, batch.column("part").to_numpy()]])
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, at = np.take_along_axis(best, top, axis=1), np.take_along_axis(at, top, axis=1)
        row, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(best[row, col]), pa.array(at[row, col].astype(np.int32))], names=["query", "score", "place"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "place"))
    true = index.select("vec_id", "v", "part").mapInArrow(run, "query int, score double, place int").withColumn("rank", rank).filter(F.col("rank") <= k)
    counts = {r.place: r["count"] for r in true.groupBy("place").count().collect()}  # a row a partition
    sums = np.cumsum([counts.get(p, 0) for p in range(len(router.intercept))])
    return int(np.searchsorted(sums, recall * sums[-1]) + 1) if len(counts) else len(router.intercept)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 16384, block: int = 4096, recall: float = 0.96) -> DataFrame:
    """The k nearest found for each query: query_id, rank (from 1), vec_id, score, largest inner product first.

    `queries` are rows of the same columns, whose own id is no candidate; without it, those whose id is divisible by 20. The router is
    fitted on at most `sample` vectors, taken by a hash of their id: 256 for each of about sqrt(n) / 4 partitions, a power of two
    from 2 on, or 64 where `sample` allows no more; so beyond some millions of vectors `sample` has to grow, too. Every vector is
    indexed, in its most probable partition, and each query is routed to its `probes` most probable partitions: as many as some of the queries need for
    `recall` of their true neighbours in the whole table (see measured_probes). There, vectors and queries meet in blocks of
    at most about `block` rows, so a partition of any size, and one vector repeated any number of times, is spread over tasks.
    Scores that a block's matrix product puts among the k best, all ties included, are computed again row by row in
    double precision, then ordered by score and id.

    Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id;
    of several dimensions the most frequent (the smaller of ties) takes part; rows that share an id are candidates
    each; fewer than four vectors are one partition (of queries that share an id, the least vector is asked); fewer than k candidates are all returned; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, None)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == dims.d)
    asked = rows.filter(F.pmod("vec_id", F.lit(20)) == 0) if queries is None else usable(queries, id_col, vector_col, dims.d)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = 2
    while parts * 2 <= min(dims["count"] ** 0.5 / 4, sample / 64):
        parts *= 2
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, max(2048, 256 * parts))).select("v").toPandas()["v"]
    x = np.array(picked.tolist(), dtype=np.float64)
    router = fit(x, parts, k) if len(x) >= 4 else Router(np.zeros((dims.d, 1)), np.zeros(1), 1)
    shared = spark.sparkContext.broadcast(router)

    def route(probes: int):
        def run(batches):
            for batch in batches:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                order = shared.value.order(flat)[:, :probes]
                again = np.repeat(np.arange(batch.num_rows), order.shape[1])
                taken = [batch.column(c).take(pa.array(again)) for c in ("vec_id", "v")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(order.ravel().astype(np.int32))], names=["vec_id", "v", "part"])

        return run

    routed = "vec_id long, v array<double>, part int"
    base = save(rows.mapInArrow(route(1), routed), "ann-index")
    # However uneven the partitions are, those that a query looks at hold k candidates, or all there are.
    filled = sorted(r["count"] for r in base.groupBy("part").count().collect())  # a row a partition
    enough = len(router.intercept) - len(filled) + int(np.searchsorted(np.cumsum(filled), k + 1)) + 1
    router.probes = measured_probes(base, asked, router, k, recall)
    asked = save(asked.mapInArrow(route(max(router.probes, enough)), routed), "ann-queries")
    count = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = F.broadcast(count(base, "blocks").join(count(asked, "asking"), "part"))  # a row a partition
    deal = lambda mine, other: (F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int").alias(mine[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))
    left = base.join(blocks, "part").select("part", "vec_id", "v", *deal("blocks", "asking"))
    right = asked.join(blocks, "part").select("part", "vec_id", "v", *deal("asking", "blocks"))

    def best(vectors_: pa.Table, queries_: pa.Table) -> pa.Table:
        """The k best of a block, an array for each query."""
        asking_, found_ = [], []
        if vectors_.num_rows and queries_.num_rows:
            v, ids = _matrix(vectors_, "v"), vectors_.column("vec_id").to_numpy()
            q, asking = _matrix(queries_, "v"), queries_.column("vec_id").to_numpy()
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ v.T
                s[asking[i : i + 256][:, None] == ids[None, :]] = -np.inf
                edge = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
                row, col = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
                exact = (q[i + row] * v[col]).sum(axis=1)
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col, exact = row[top], col[top], exact[top]
                pairs = pa.StructArray.from_arrays([pa.array(-exact), pa.array(ids[col])], names=["minus", "vec_id"])
                offsets = pa.array(np.searchsorted(row, np.arange(len(s) + 1)).astype(np.int32))
                asking_.append(pa.array(asking[i : i + 256]))
                found_.append(pa.ListArray.from_arrays(offsets, pairs))
        return pa.table({"query_id": pa.chunked_array(asking_, pa.int64()), "found": pa.chunked_array(found_, FOUND)})

    meet = ["part", "b", "a"]
    found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(best, "query_id long, found array<struct<minus:double,vec_id:long>>")
    # Blocks' results are merged twice, so the list of a query stays short however many blocks it meets.
    first = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(16))
    merged = found.groupBy("query_id", spread.alias("s")).agg(first.alias("found")).groupBy("query_id").agg(first.alias("found"))
    return merged.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))

"""Divergence audit, prefix trie and exact top-k against plain versions, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandwise.llm import divergence, topk, trie


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Divergence audit


def plain_audit(rows, least_docs=10, k=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode().lower())
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        mine = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s in mine:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if mine[s][t] > 0 and p[s][t] > q[t])[:k]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, r) for r, (value, item) in enumerate(found, 1)]
    return sorted(out, key=str)


def audited():
    rng = random.Random(4)
    words = [rng.choice("aZbéßx中") * rng.randint(1, 3) + rng.choice(["", "q", "Ö"]) for _ in range(60)]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words[: 10 + 5 * (i % 7)]) for _ in range(rng.choice([0, 2, 30, 90])))
        rows.append((rng.choice(["en", "de", "", None]), rng.choice(["s0", "s1", "s2", "ü", None, "alone" if i == 3 else "s0"]), rng.choice([text, text, text + "\x00@[`{\x7f1" + text, None if i % 9 == 0 else text])))
    rows += [("en", "s0", "the THE the")] * 40 + [("fr", "only", "x"), ("it", "a", None), ("it", "b", ""), ("pt", "b", "word " * 5)]
    return rows + [("en", "long", "abc DEF " * 200_000), ("en", "long", "y" * 2_500_000)]


@pytest.mark.parametrize("settings", [{}, {"HELD": 20, "SLICE": 64}])
def test_divergence(spark, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(divergence, name, value)
    rows = [(*r, 1, 2, "x", 3) for r in audited()]
    docs = spark.createDataFrame(rows, "lang string, source string, text string, n long, value long, item string, rank int").repartition(5)
    for least, k in ((10, 10), (1, 3)):
        assert got(divergence.audit(docs, least, k)) == plain_audit([r[:3] for r in rows], least, k)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_blocks_of_sources(spark):
    """Sources in several blocks and terms in several chunks give the sums of one."""
    kept = spark.createDataFrame([("en", f"t{i}", [(f"s{j}", (i * j) % 7) for j in range(11) if (i + j) % 3]) for i in range(40)], "lang string, term string, sources array<struct<source:string,n:long>>")
    groups = spark.createDataFrame([("en", f"s{j}", 100 + j, 40) for j in range(11)] + [("it", "a", 0, 0), ("it", "b", 0, 0)], "lang string, source string, total long, n_terms long")
    assert got(divergence.pair_sums(kept, groups, 3, 8)) == got(divergence.pair_sums(kept, groups))


def test_skybands_hold_the_best():
    rng = random.Random(5)
    for spread in (3, 50):
        n, low = [rng.randint(1, spread) for _ in range(1500)], [rng.randint(1, spread) + spread for _ in range(1500)]
        names = [str(i).encode() for i in rng.sample(range(9999), 1500)]
        over = lambda i, j: n[j] >= n[i] and low[j] <= low[i] and names[j] < names[i]
        want = [i for i in range(1500) if sum(over(i, j) for j in range(1500)) < 4]
        assert sorted(divergence.skyband(np.array(n), np.array(low), np.array(names, dtype=object), 4).tolist()) == want and len(want) < 1500


def test_shares_of_large_counts():
    counts, totals = np.array([[0, 10**14, 3], [2**53, 9 * 10**15, 1]]), np.array([2**54, 10**16, 2**55])
    want = [[1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(row, totals)] for row in counts]
    assert divergence.shares(counts, totals).tolist() == want


# Prefix trie


def plain_trie(rows, period=100, most=6):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), len(text)))
    own = {c: [(t, n) for _, _, t, n in sorted(x)] for c, x in by.items()}
    nodes = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - int(math.fmod(c, period)), [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            nodes[tuple(whole[c][:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p in nodes:
        under = [x for x in nodes if x[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(whole[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), kids[p], sum(not kids[x] for x in under), sum((len(nodes[x]) - 1) * x[-1][1] for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks():
    rng = random.Random(6)
    say = lambda n=5: rng.choice(["", "hi", "yes", "é中", "no"][:n])
    rows = []
    for c in [*range(0, 45), *range(195, 230), -5, -105, -100, 2**62, 301, 302]:
        rows += [(c, t if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None]), say() if t else say(2)) for t in range(rng.choice([1, 2, 3, 5, 7, 8]))]
    for c in range(400, 440):  # one conversation, many times, then long ones that part late
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    for c in range(440, 446):
        rows += [(c, t, "user", f"same {t}" if t < 20 + c % 3 else f"other {c // 2}") for t in range(20 + c % 4 * 5)]
    rows += [(446, 3, "user", "tie"), (446, 3, "user", "tie"), (446, 3, None, "tie"), (None, 0, "user", "lost"), (447, None, None, None)]
    return rows


@pytest.mark.parametrize("limit, length", [(64, 256), (3, 4), (1, 1), (1000, 2), (2, 5)])
def test_trie(spark, limit, length):
    rows = [(*r, "x", 1, 2) for r in talks()]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string, depth int, at int").repartition(3)
    assert got(trie.rebuilt_trie(table, limit=limit, length=length)) == plain_trie(talks())


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.rebuilt_trie(table).count() == 0
    lost = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    only = got(trie.rebuilt_trie(spark.createDataFrame([(lost, 0, "user", "text")], table.schema)))
    assert only == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


# Exact top-k


def plain_topk(rows, k, every):
    fine = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dims = Counter(len(v) for _, v in fine)
    dim = min(dims, key=lambda d: (-dims[d], d))
    fine = [(i, v) for i, v in fine if len(v) == dim]
    asked = {}
    for i, v in fine:
        if i is not None and i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for i, q in asked.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in fine if j != i)[:k]
        out += [(i, r, None if lacks else j, -s) for r, (s, lacks, j) in enumerate(found, 1)]
    return sorted(out, key=str)


def vectors(spread):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 0.1, (700, 12)) * np.exp(spread * rng.normal(0, 1, (700, 1)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, [0.5] * 12) for i in range(60)] + [(2000, [0.0] * 12), (2100, [0.25] + [0.0] * 11), (2100, [0.125] + [0.0] * 11), (2001, [-0.5] * 12), (None, [0.5] * 12)]
    return rows + [(2200, None), (2300, []), (2400, [0.5, None] + [0.0] * 10), (2500, [float("nan")] * 12), (2600, [float("inf")] * 12), (2700, [1.0, 2.0])]


@pytest.mark.parametrize("spread, block", [(0.0, 4096), (0.0, 40), (1.5, 100), (0.5, 1)])
def test_topk(spark, spread, block):
    rows = vectors(spread) if block > 1 else vectors(spread)[:30]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, v int").repartition(3)
    assert got(topk.search(table, k=10, block=block)) == plain_topk(rows, 10, 100)
    assert got(topk.search(table, k=3, every=50, block=block, levels=4, together=5)) == plain_topk(rows, 3, 50)


def test_topk_edges(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 0.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert got(topk.search(few)) == [(0, 1, 1, 1024**2), (0, 2, 2, 1024**2)]
    large = [(0, [2e12, 1.0]), (1, [2e12, -3.0]), (2, [-2e12, 1e300]), (3, [1e-9, -1e-9])]
    most = 2**63 - 1
    assert [r[2] for r in got(topk.search(spark.createDataFrame(large, few.schema)))] == [1, 3, 2] and got(topk.search(spark.createDataFrame(large, few.schema)))[0][3] == most


def test_topk_stops_on_proof():
    """Where vectors are uneven, most rows are never rescored, and none of the best is missed."""
    rng = np.random.default_rng(8)
    v = np.floor(1024 * rng.normal(0, 0.1, (3000, 32)) * np.exp(rng.normal(0, 1, (1, 32)))).astype(np.int64)
    import pyarrow as pa

    rows = pa.table({"block": pa.array([0] * 3000, pa.int32()), "vec_id": pa.array(range(3000), pa.int64()), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    built = []

    class Rows:
        def groupBy(self, _):
            return self

        def applyInArrow(self, f, _):
            built.append(f(rows))

    topk.build_index(Rows(), 32)
    block = topk.Block(built[0])
    for q in v[:20]:
        left = block.possible(q, 10, None, np.zeros(3000, dtype=bool))
        scores = v @ q
        assert set(np.argsort(-scores, kind="stable")[:10]) <= set(left.tolist()) and len(left) < 1500


# Sharding


@pytest.mark.parametrize("shards", [40, 7])
def test_sharding_against_plain_ranks(spark, shards):
    """Positions, shards and slots by plain sorts; only the seeded hashes come from Spark."""
    from pyspark.sql import functions as F

    from strandwise.llm import common, sharding

    rng = random.Random(9)
    rows = [(i if i % 50 else None, rng.choice(["x", "y" * rng.randint(0, 9), None, ""]), rng.choice(["a", "a", "a", "b", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keyed = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("crc")).withColumn("key", F.xxhash64(F.lit(7), "doc_id", "crc", "size")).withColumn("s", F.xxhash64("source")).collect()
    bits = common.n_buckets(len(rows))
    low = lambda x: (x is not None, x if x is not None else 0)
    by = defaultdict(list)
    for r in keyed:
        by[r.source].append(r)
    placed = []
    for source, some in by.items():
        some.sort(key=lambda r: (r.key % bits, r.key, low(r.doc_id), r.size, r.crc))
        placed += [((rank + 0.5) / len(some), r) for rank, r in enumerate(some)]
    placed.sort(key=lambda p: (p[0], p[1].s, (p[1].source is not None, p[1].source or ""), p[1].key, low(p[1].doc_id), p[1].size, p[1].crc))
    n = len(rows)
    want = [(r.doc_id, r.size, r.crc, at * shards // n, at - -(-(at * shards // n) * n // shards)) for at, (_, r) in enumerate(placed)]
    found = sharding.interleave(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot")
    assert got(found) == sorted(want, key=str)

"""Each operator against a plain version, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import sys
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from strandwise.llm import bpe, exact_dedup, jaccard, licences, mixing, neighbours, queries, repeats, rolling, sharding, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int, h long"


def corpus():
    """Copies, near copies, shared passages, nulls, empty, odd and long texts; ids repeat, and columns clash with inner names."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 3, 20, 60, 200]))) for _ in range(60)]
    passage, base = " ".join(word() for _ in range(70)), " ".join(word() for _ in range(120))
    texts += [f"{word()} {word()}\n{passage} {word()}" for _ in range(6)] + [texts[5]] * 3 + [passage + "\t" + passage]
    for edits in (0, 1, 1, 2, 3, 6):
        w = base.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [None, "", "", " \n\t", "x", "a" * 700, "ab" * 400, " ".join(word() for _ in range(4000)), "Same Words Here Now", "same words here now"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 1, "d", 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (7, "another text with an id that repeats", "en", "s0", 1, "d", 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows=None):
    return [(r[0], r[1]) for r in (rows or corpus())]


def got(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [4096, 1])
def test_byte_repeats(docs, hot):
    assert got(repeats.byte_repeats(docs, hot=hot), 5) == sorted(brute.byte_repeats(pairs()), key=str)


def test_word_repeats(docs):
    assert got(repeats.word_repeats(docs), 4) == sorted(brute.word_repeats(pairs()), key=str)


def test_null_ids_and_empty_tables_of_repeats(spark, empty):
    long = "z y x w v u t s r q " * 60
    rows = spark.createDataFrame([(None, long), (None, "b" + long), (1, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.word_repeats(rows).collect()) == sorted(r[2] for r in brute.word_repeats([(0, long), (1, "b" + long), (2, None)]))
    assert repeats.byte_repeats(empty).count() == repeats.word_repeats(empty).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 3000).astype(np.uint64)
    start = rng.choice(2900, 700, replace=False)
    group = rng.integers(0, 5, 700)
    order, same = rolling.suffix_sort(data + np.uint64(1), group, start, 12)
    keys = [(int(group[i]), tuple(data[start[i] : start[i] + 12])) for i in order]
    assert keys == sorted(keys)
    assert same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_jaccard(docs, empty):
    rows = [r for r in corpus() if r[1] != "another text with an id that repeats"]
    once = list({r[0]: r for r in rows}.values())
    for n, share in ((4, (85, 100)), (5, (80, 100)), (2, (50, 100))):
        found = jaccard.jaccard_components(docs.filter("text is null or text not like 'another%'"), n, share)
        assert sorted(set(got(found)), key=str) == sorted(brute.jaccard_components(pairs(once), n, share), key=str)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (None, "q")], "doc_id long, text string")
    assert got(jaccard.jaccard_components(rows)) == sorted([(None, 2, 5), (None, 2, 5), (5, 2, 5), (None, 1, None)], key=str)


def test_jaccard_of_large_ids(spark):
    """Every long may be an id: none is taken for a null."""
    ids = [2**62 - 1, 2**62, 2**63 - 1, -(2**63), -1]
    rows = [(i, "a b c d e") for i in ids[:3]] + [(i, "k l m n o") for i in ids[2:]] + [(2**62 + 5, "f g h i j"), (None, "f g h i j"), (2**63 - 2, "q"), (None, None)]
    found = got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    want = [(i, 2, ids[0]) for i in ids[:3]] + [(i, 2, ids[3]) for i in ids[2:]] + [(2**62 + 5, 2, 2**62 + 5), (None, 2, 2**62 + 5), (2**63 - 2, 1, 2**63 - 2), (None, 0, None)]
    assert found == sorted(want, key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(docs, empty, digest):
    """The second digest has 16 values: all that keeps texts apart then is the comparison of whole texts."""
    rows, groups = corpus(), {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    found = exact_dedup.exact_dedup(docs, digest).collect()
    assert len(found) == len(rows)
    want = Counter((r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups) and all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("digest", [None, lambda c: F.lit("same")])
def test_state_over_calls(spark, tmp_path, digest):
    """A second call with the same state knows the rows of the first, also where one digest stands for all texts of a length."""
    path = f"file://{tmp_path}/state"
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first, second = [(1, "a"), (5, "b"), (2, "a"), (None, None), (3, "cc")], [(9, "a"), (4, "b"), (7, "d"), (8, ""), (8, "")]
    view = lambda df: sorted((tuple(r)[:4] for r in df.collect()), key=str)
    assert view(exact_dedup.exact_dedup(table(first), digest, path)) == sorted([(1, 2, 2, False), (5, 5, 1, True), (2, 2, 2, True), (None, None, 1, True), (3, 3, 1, True)], key=str)
    assert view(exact_dedup.exact_dedup(table(second), digest, path)) == sorted([(9, 9, 3, True), (4, 5, 2, False), (7, 7, 1, True), (8, 8, 3, True), (8, 8, 3, False)], key=str)


def test_state_is_met_across_batches(spark, tmp_path):
    """Copies that come in different micro-batches of one call."""
    table = spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)], "doc_id long, text string").repartition(8)
    found = exact_dedup.exact_dedup(table, state_dir=f"file://{tmp_path}/state", batches=4).collect()
    assert all((r.keep_id, r.group_size, r.kept) == (36 + r.doc_id % 4, 10, r.doc_id >= 36) for r in found) and len(found) == 40
    batches = spark.read.parquet(f"file://{tmp_path}/state/states").groupBy("batch").count().collect()
    assert len(batches) == 4


def test_sharding(docs, empty):
    rows = corpus()
    found = sharding.interleave(docs, shards=7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = Counter(r.shard for r in found)
    assert set(shards) == set(range(7)) and max(shards.values()) - min(shards.values()) <= 1
    for s in shards:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(shards[s]))
    for source, n in Counter(r.source for r in found).items():
        for s in shards:
            assert abs(sum(r.source == source for r in found if r.shard == s) - n / 7) <= 1.5
    assert got(sharding.interleave(docs, shards=7)) == sorted((tuple(r) for r in found), key=str)
    assert sharding.interleave(empty).count() == 0


def test_mixing(docs, empty):
    found = mixing.mix(docs).collect()
    total = sum(r["size"] for r in found)
    by = {s: [r for r in found if r.source == s] for s in {r.source for r in found}}
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6 * total
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0].source_size and rows[0].target <= 2 * rows[0].source_size
        assert sum(r.taken for r in rows) == round(rows[0].target)
        assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    at = [r.position for r in found if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert mixing.mix(empty).count() == 0


def test_targets_stop_and_reshare(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert t == {"a": 20.0, "b": 1.5 * 1110 - 20 - 200, "c": 200.0, None: 0.0}


def test_bpe(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    outputs = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    found = bpe.encode(docs, path, P.PATTERN, outputs, keep=("doc_id", "text"))
    for r in found.collect():
        want = reference.encode_ordinary(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(found, path, keep=("doc_id", "text")).collect())
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_bpe_of_odd_texts():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode, rng = bpe.Codec(ranks, P.PATTERN).encoder(), random.Random(3)
    bits = ["a", "b", "Z", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "1", "٣", "½", "'s", "'LL", "!", "漢", "😀", "́", "\x00", "th", "ing", "<|endoftext|>"]
    for text in ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["x" * 20000 + "qzj" * 9000]:
        assert encode(text) == reference.encode_ordinary(text)


def test_perfect_hash():
    keys = [str(i * i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.at.tolist()) == list(range(3000)) and all(h.index(k) == i for i, k in enumerate(keys))


def test_toxicity_on_held_out_rows(spark, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    tp, fp, fn = (sum((r.predicted, r.toxic) == x for r in scored) for x in ((1, 1), (1, 0), (0, 1)))
    assert tp >= 2 * (fp + fn), (tp, fp, fn)


def test_toxicity_of_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 0, 1), (999, 0, 1), (3, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        found = toxicity.score(docs, toxicity.fit(docs, rows)).collect()
        assert len(found) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def exact_neighbours(rows, k):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows]
    return {q: sorted((-float((x * v).sum()), i) for i, v in rows if i != q)[:k] for q, x in rows if q % 20 == 0}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(3000)] + [(5000 + i, [0.5] * 8) for i in range(300)]
    odd = [(20000, None), (20020, [0.0] * 8), (20040, [float("nan")] * 8), (20060, [1.0, None] + [1.0] * 6), (20080, []), (20100, [1.0, 2.0]), (None, [1.0] * 8), (20120, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    want = exact_neighbours(rows, 20)
    for settings in ({}, {"recall": 1.0, "block": 500}):
        found = {}
        for r in neighbours.search(df, k=20, **settings).collect():
            found.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
        assert set(found) == set(want) and all(sorted(x) == list(range(1, 21)) for x in found.values())
        hits = sum(len({i for _, i in found[q].values()} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.9 * 20 * len(want)
        assert all([found[q][k] for k in range(1, 21)] == sorted(found[q].values()) for q in want)
    few = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 1.0)]
    assert neighbours.search(df.limit(0)).count() == 0


def vectors(kind, n, d=32):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, d))
    if kind.startswith("clustered"):
        x = x + 6 * rng.standard_normal((25, d))[rng.integers(0, 25, n)]
    return x * np.exp(rng.standard_normal((n, 1))) if kind.endswith("uneven") else x


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1", "clustered", "random", "uneven", "clustered uneven"])
def test_recall_of_routed_search(spark, monkeypatch, name):
    """Recall against brute force, through at least two learned partitions."""
    if name.startswith("sf"):
        df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    else:
        rows = list(enumerate(vectors(name, 4000).tolist()))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    routers, plain = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: routers.append(plain(*a)) or routers[-1])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    found = {}
    for r in neighbours.search(df, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -(x @ x[q]))) if j != q][:20]
        hits, total = hits + len({int(ids[j]) for j in order} & found[int(ids[q])]), total + len(order)
    print(name, len(ids), len(routers[0].intercept), routers[0].probes, hits / total)
    assert len(routers[0].intercept) >= 2 and hits >= 0.9 * total
    assert name != "clustered" or routers[0].probes < len(routers[0].intercept)


def test_licences(spark, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x", "words only"), (3, "a/b/c/LICENSE", "All rights reserved."), (4, "a/b/c/d/y", None), (5, "z/q", "nothing\nLicensed under the Apache License, Version 2.0.\nmore words of no licence " * 3),
        (6, "z/r", ""), (7, None, "the"), (8, "top", "this is the version of the work"), (2, "a/b/x", "words only"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir", F.lit("clash"))
    found = {r.doc_id: (r.licence, r.basis, r.from_dir) for r in licences.scan(df, F.col("path")).collect()}
    assert found == {
        1: ("MIT", "statement", None), 2: ("MIT", "inherited", "a"), 3: ("proprietary", "statement", None), 4: ("proprietary", "inherited", "a/b/c"),
        5: ("Apache-2.0", "statement", None), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None),
    }
    assert licences.scan(df, F.col("path")).count() == len(rows)
    assert licences.scan(empty, F.col("source")).count() == 0


def test_licence_query_takes_prose_for_no_licence_file(spark, tmp_path):
    prose = "river stone cloud paper window " * 6 + "\nReleased under the MIT License.\n" + "garden letter bridge lamp " * 6
    rows = [(i, prose if i == 5 else "All rights reserved." if i == 205 else "plain words", "s") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op9_licences(spark, str(tmp_path)).collect()}
    assert [i for i, r in found.items() if r.licence_file] == [205]
    assert (found[5].licence, found[5].basis) == ("MIT", "statement") and "MIT" not in {r.licence for i, r in found.items() if i != 5}


def test_licence_query_inherits_from_upper_directories(spark, tmp_path):
    rows = [(i, "All rights reserved." if i % 97 == 5 else "plain words", "s") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_licences(spark, str(tmp_path)).collect()
    own = lambda r: r.path.rsplit("/", 1)[0]
    assert {own(r).count("/") for r in found} == {0, 1, 2}
    assert any(r.basis == "inherited" and len(r.from_dir) < len(own(r)) for r in found)


def plain_units(texts, templates):
    """For each text, its units (the whole, paragraphs, lines) with their best template: kind, score, name, whether it is long; by a plain cosine."""
    templates = sorted(templates, key=lambda t: t[0])
    texts = [re.sub(licences.NOTICE, r"\1", t or "") for t in texts]
    vocabulary = {t for _, x, *_ in templates for t in licences.terms(x)}
    df = Counter(t for x in texts for t in set(licences.terms(x)) & vocabulary)
    idf = {t: np.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocabulary}
    other, out = sum(idf.values()) / len(idf), []
    vectors = licences.weights(idf, [x for _, x, *_ in templates])
    for text in texts:
        found = []
        paragraphs = [x for x in re.split(r"\r?\n[^A-Za-z0-9\r\n]*\r?\n", text) if "\n" in x]
        for kind, unit in [(0, text), *((1, x) for x in paragraphs), *((2, x) for x in re.split("[\r\n]+", text))]:
            words = Counter(licences.terms(unit))
            own = {t: n * idf[t] for t, n in words.items() if t in vocabulary}
            norm = np.sqrt(sum(x * x for x in own.values()) + other**2 * sum(n * n for t, n in words.items() if t not in vocabulary))
            best = (kind, 0.0, None, False)
            for (name, template, *needs), v in zip(templates, vectors):
                if own and all(t in own for t in " ".join(needs).split()) and (s := sum(x * v.get(t, 0.0) for t, x in own.items()) / norm) > best[1] + 1e-12:
                    best = (kind, s, name, len(licences.terms(template)) >= licences.LONG)
            found.append(best)
        out.append(found)
    return out


def best_of(units, limit):
    """The best of units at the limit or above: of a long template first, then by score."""
    some = [u for u in units if u[1] >= limit]
    return max(some, key=lambda u: (u[3], round(u[1], 12))) if some else None


def plain_scan(rows):
    """doc_id to licence and basis, with licence files and inheritance, by plain loops; `rows` have doc_id, path, text."""
    units, declared, out = plain_units([t for _, _, t in rows], licences.TEMPLATES), {}, {}
    names = {n.lower(): n for n, *_ in licences.TEMPLATES}
    order = sorted(names.values())
    for (_, path, _), found in zip(rows, units):
        if not path or "/" not in path:
            continue
        if re.search(licences.LICENCE_NAME, path):
            best = best_of([u for u in found if u[0] < 2], 0.6)
        else:
            best = best_of([u for u in found if u[0] == 0], 0.75) if re.search(licences.PLAIN_NAME, path) else None
        if best:
            declared.setdefault(path.rsplit("/", 1)[0], []).append((best[3], round(best[1], 9), -order.index(best[2]), best[2]))
    for (i, path, text), found in zip(rows, units):
        tag = re.search(licences.SPDX, text or "")
        tag = tag and names.get(re.sub(licences.SPDX_TAIL, "", tag[1]).lower())
        best = best_of(found, 0.75)
        if tag or best:
            out[i] = (tag or best[2], "statement")
            continue
        parts = path.split("/")[:-1] if path else []
        above = next((d for n in range(len(parts), 0, -1) if (d := "/".join(parts[:n])) in declared), None)
        out[i] = (max(declared[above])[-1], "inherited") if above else (None, "none")
    return out


def scanned(spark, rows):
    return {r.doc_id: (r.licence, r.basis) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}


def test_licence_scores_against_plain_cosine(spark):
    """Scores equal those of a plain version, and pruning by telling terms loses none above the threshold."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in d.collect()]
    best = {i: best_of(units, 0.75) for (i, _), units in zip(texts, plain_units([x for _, x in texts], licences.TEMPLATES))}
    want = {i: (b[2], round(b[1], 9)) for i, b in best.items() if b}
    found = {r.doc_id: (r.licence, round(r.score, 9)) for r in licences.scan(d, F.lit("a/b.c")).filter("basis = 'statement'").collect()}
    assert found == want and want


BSD = """Copyright (c) 2019, {0}.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{1}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.
"""
THIRD = "3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"


def headers():
    """Headers and files as they stand in the world, and what they are."""
    text = lambda name, k=-1: textwrap.fill([x for n, x, *_ in licences.TEMPLATES if n == name][k], 70)
    commented = lambda x, mark="// ": "\n".join(mark + y for y in x.split("\n"))
    return {
        "BSD-3-Clause": [BSD.format("The Regents", THIRD), commented(BSD.format("A. Writer", THIRD), " * ") + "\n\nint main() { return 0; }\n" * 9],
        "BSD-2-Clause": [BSD.format("A. Writer", ""), "/*\n" + commented(BSD.format("A. Writer", ""), " * ") + "\n */\n" + "x = y;\n" * 40],
        "ISC": ["Copyright (c) 2004 A. Writer. All rights reserved.\n\n" + text("ISC")],
        "LGPL-2.1": [commented(text("LGPL-2.1")) + "\n\ncode;\n" * 20], "LGPL-2.0": [text("LGPL-2.0")], "LGPL-3.0": [text("LGPL-3.0", 1)],
        "GPL-1.0": [text("GPL-1.0")], "GPL-2.0": [commented(text("GPL-2.0"), "# "), "x\n// SPDX-License-Identifier: GPL-2.0-or-later\ny"], "GPL-3.0": ["SPDX-License-Identifier: GPL-3.0-only", text("GPL-3.0")],
        "Apache-2.0": ["# SPDX-License-Identifier: Apache-2.0\nimport os\n" * 3, "Copyright 2020 The Authors. All rights reserved.\n\n" + text("Apache-2.0")], "MIT": ["/* SPDX-License-Identifier: (MIT OR Apache-2.0) */"],
        "GFDL-1.2": [text("GFDL-1.2")], "GFDL-1.3": [text("GFDL-1.3")], "MPL-1.1": [text("MPL-1.1")], "MPL-2.0": [text("MPL-2.0")], "proprietary": ["All rights reserved.", "code\n// All rights reserved.\nmore code"],
        None: ["Copyright 2020 A. Writer.\nAll rights reserved.\nmodule x", "// SPDX-License-Identifier: Zlib", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "the license, version 9, of this software"],
    }


def test_licences_of_real_headers(spark):
    """Each header is its own licence or none, never another one; the plain version says the same of files and directories."""
    rows, want = [], {}
    for name, texts in headers().items():
        for t in texts:
            i = len(rows)
            rows.append((i, f"{i}/x.c", t))
            want[i] = (name, "statement" if name else "none")
    assert scanned(spark, rows) == want == plain_scan(rows)
    tree = [(i, f"t/{i % 7}/{'LICENSE' if i % 3 else 'notes'}", t) for i, _, t in rows] + [(100 + i, f"t/{i % 9}/deep/er/f.c", "words") for i in range(18)] + [(200, "t/COPYING", BSD.format("x", THIRD)), (201, "top", "w"), (202, None, "w")]
    found = scanned(spark, tree)
    assert found == plain_scan(tree) and {b for _, b in found.values()} == {"statement", "inherited", "none"}


def test_licences_of_common_files(spark):
    """Whole files of licences: each declares itself for its tree."""
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence files here")
    own = {"BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0"}
    names = [p.name for p in sorted(folder.iterdir()) if not p.is_symlink()]
    rows = [(i, f"{n}/LICENSE", (folder / n).read_text(errors="replace")) for i, n in enumerate(names)] + [(100 + i, f"{n}/src/a.py", "pass") for i, n in enumerate(names)]
    found = scanned(spark, rows)
    assert {n: found[100 + i][0] for i, n in enumerate(names)} == {n: own.get(n, n) for n in names}
    assert all(found[i][0] in (None, own.get(n, n)) for i, n in enumerate(names))


def test_licences_as_they_stand_in_files(spark):
    """Full texts and wrapped headers, with marks of comments, are found; prose and headers of code declare nothing for others."""
    texts = {k: v for k, v, *_ in reversed(licences.TEMPLATES) if len(v) > 150}
    wrap = lambda text, mark, width: "\n".join(mark + text[i : i + width] for i in range(0, len(text), width)) if width else text
    gpl = textwrap.fill(texts["GPL-3.0"], 60)
    rows = [
        (1, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Writer\n\n" + textwrap.fill(texts["MIT"], 70) + "\n\nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND."), (2, "m/src/x.py", "print(1)"),
        (3, "g/a.c", "\n".join("// " + x for x in gpl.split("\n")) + "\n//\n\nint main() { return 0; }\n" + "x = y + 1;\n" * 40), (4, "g/b.c", "int f();"),
        (5, "n/chapter", "All rights reserved by the hotel, he said, and went up the stairs to the room that looked over the bay."), (6, "n/other", "more of the story"),
        (7, "b/COPYING.txt", textwrap.fill(texts["BSD-3-Clause"], 75)), (8, "b/c/d/e.py", ""), (9, "z/q.c", "/* " + wrap(texts["Apache-2.0"], "", 0) + " */"), (10, "z/r.c", "w"),
    ]
    found = {r.doc_id: (r.licence, r.basis) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert found == {
        1: ("MIT", "statement"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "statement"), 4: (None, "none"), 5: (None, "none"), 6: (None, "none"), 7: ("BSD-3-Clause", "statement"),
        8: ("BSD-3-Clause", "inherited"), 9: ("Apache-2.0", "statement"), 10: (None, "none"),
    }


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s[:n]


def test_structured_texts(spark):
    """Words and passages on which polynomial hashes modulo 2**64 collide."""
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    common = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*common[:17], one, *common[17:]])), (2, " ".join([*common[:17], other, *common[17:]])), (3, f"p {one}"), (4, f"p {other}")]
    rows += [(5, "x" * 150 + one + "y" * 150), (6, "x" * 150 + other + "y" * 150), (7, thue_morse(4096)), (8, thue_morse(4096, "b", "a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.word_repeats(df), 4) == sorted(brute.word_repeats(rows), key=str)
    for hot in (4096, 1):
        assert got(repeats.byte_repeats(df, hot=hot), 5) == sorted(brute.byte_repeats(rows), key=str)
    assert got(jaccard.jaccard_components(df)) == sorted(brute.jaccard_components(rows), key=str)


@pytest.mark.parametrize(("rows", "queries", "step"), [(2048, 4096, 32), (5, 3, 8)])
def test_families_in_blocks(spark, monkeypatch, rows, queries, step):
    """Families around several originals, near and under the limit, in one block or many."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows)
    monkeypatch.setattr(jaccard, "BLOCK_QUERIES", queries)
    monkeypatch.setattr(jaccard, "STEP", step)
    rng = random.Random(4)
    data, i = [], 0
    for size in (12, 60, 200):
        base = [f"v{rng.randrange(5000)}" for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12] * 2:
            w = list(base)
            for _ in range(edits * size // 100 + edits % 2):
                w[rng.randrange(size)] = f"u{rng.randrange(50)}"
            data.append((i, " ".join(w[rng.randrange(2) :])))
            i += 1
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for n, share in ((4, (85, 100)), (5, (80, 100))):
        assert got(jaccard.jaccard_components(df, n, share)) == sorted(brute.jaccard_components(data, n, share), key=str)


def test_perfect_hash_of_any_size():
    for n in [*range(40), 100, 256, 500]:
        keys = [bytes([i % 256, i // 256]) for i in range(n)]
        h = bpe.PerfectHash(keys)
        assert sorted(h.at.tolist()) == list(range(n)) and all(h.index(k) == i for i, k in enumerate(keys))
    assert bpe.PerfectHash([b"a", b"b", b"c", b"d", b"e"], tries=2).seed > 0


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    """Repeated ids and repeated rows don't make the sample larger than twice `per_class`."""
    rows = [(i, f"word{i % 9} bad text {'awful' if i % 2 else 'kind'} {j}") for i in range(40) for j in range(30)] + [(1, "the same row")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sizes, plain = [], toxicity.save
    monkeypatch.setattr(toxicity, "save", lambda df, name: (lambda out: (sizes.append(out.count()) if name == "toxic-sample" else None, out)[1])(plain(df, name)))
    for limit, most in ((1, 2), (50, 100), (4000, 8000)):
        toxicity.fit(docs, labels, per_class=limit)
        assert 0 < sizes[-1] <= most
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sizes[-1] == sum(i in free for i, _ in rows)


def test_mixing_spreads_rows_without_ids(spark, monkeypatch):
    """Rows that share an id, or have none, fall into as many buckets as others."""
    seen, plain = [], mixing.running
    monkeypatch.setattr(mixing, "running", lambda df, group, bucket, *a: (seen.append(df.select(bucket).distinct().count()), plain(df, group, bucket, *a))[1])
    rows = [(None, "s", f"text {i}") for i in range(6000)] + [(5, "s", f"more text {i}") for i in range(6000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).agg(F.sum("taken"), F.first("target")).first()
    assert seen[0] > 16 and found[0] == round(found[1])

"""The pipeline on small tables, stage by stage."""

import sys
from pathlib import Path

import corpus_pipeline as C
from strandwise.llm import mixing

sys.path.insert(0, str(Path(__file__).parent))


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in C.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, d).collect(), docs.schema)
        assert after.columns == columns
        if name != "mixing":
            assert 0 < after.count() <= before.count()
            assert after.select("doc_id").distinct().count() == after.count()
        if name == "exact dedup":
            assert after.select("text").distinct().count() == after.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    out = C.STAGES[-1][1](spark, before, d).collect()
    assert len(out) == before.count() and all(r.n_tokens == len(r.ids) for r in out)


def test_edge_cases(spark):
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (1, "x y z", "en", "a", 5), (1, "x y z", "en", "a", 5), (2, "x y z", None, None, 5), (3, "p " * 3000, "en", "a", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = C.drop_copies(spark, docs, "")
    assert sorted(r.text or "" for r in once.collect()) == ["", "p " * 3000, "x y z"]
    assert C.drop_near_copies(spark, docs, "").count() == 4  # one of the three rows of x y z stays
    assert C.mix_sources(spark, docs, "").columns == docs.columns
    assert C.tokenize(spark, docs, "").count() == 6
    none = docs.limit(0)
    assert all(f(spark, none, "/root/testdata/sf0.001").count() == 0 for _, f in C.STAGES)


def test_near_copies_of_null_and_repeated_ids(spark):
    """One row of each component stays, and every clean row, whatever the ids are."""
    near = lambda name, last: " ".join(f"{name}{i}" for i in range(60)) + " " + last
    rows = [(1, near("a", "x")), (1, near("b", "x")), (0, near("b", "y")), (2, near("c", "x")), (2, near("c", "y")), (None, near("d", "x")), (None, near("d", "y")), (7, near("e", "x")), (None, near("e", "y"))]
    rows += [(2**63 - 1, near("f", "x")), (2**63 - 2, near("f", "y")), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stays = C.drop_near_copies(spark, docs, "")
    assert stays.columns == docs.columns
    found = sorted((str(r.doc_id), (r.text or "")[:1]) for r in stays.collect())
    assert found == sorted([("1", "a"), ("0", "b"), ("2", "c"), ("None", "d"), ("7", "e"), (str(2**63 - 2), "f"), ("None", ""), ("None", "")])


def test_order_of_training(spark):
    """Documents come in the order of the curriculum, as often as the mix reads them."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    mixed = mixing.mix(docs, ordered=False, passes=True).filter("copies > 0").collect()
    want = [i for _, i in sorted((at, r.doc_id) for r in mixed for at in r.positions)]
    assert [r.doc_id for r in C.mix_sources(spark, docs, d).collect()] == want
    words, targets = sum(len(r.positions) * r.size for r in mixed), {r.source: r.target for r in mixed}
    assert 0 <= words - sum(targets.values()) <= sum(max(r.size for r in mixed if r.source == s) for s in targets) + len(targets)


def test_stages_put_together_lazily(spark):
    """A stage over the plan of another reads what that one wrote; files go once nothing reads them."""
    rows = [(i, f"text number {i // 2} of the table and some more words", "en", "a", 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = C.drop_near_copies(spark, C.drop_copies(spark, docs, ""), "")
    assert sorted(r.doc_id for r in C.mix_sources(spark, near, "").distinct().collect()) == sorted(r.doc_id for r in near.collect()) == list(range(1, 20, 2))
    C.drop_copies(spark, docs, "").count()
    left = list(C._left)
    C.drop_copies(spark, docs, "").count()
    assert not set(left) & set(C._left)


def test_pipeline_against_plain_versions(spark, tmp_path):
    """What the classifier keeps goes through plain versions of the other stages; the pipeline gives the same rows."""
    import duckdb
    import pandas as pd
    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from strandwise.llm.queries import OP8_SQL

    import brute

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = C.drop_toxic(spark, docs, d).collect()
    last = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        last[r.text or ""] = r
    rows = list(last.values())
    of = {i: c for i, _, c in brute.jaccard_components([(r.doc_id, r.text) for r in rows], 5, (80, 100))}
    documents = pd.DataFrame([r.asDict() for r in rows if of[r.doc_id] == r.doc_id])  # noqa: F841
    copies = {i: n for i, n in duckdb.sql(OP8_SQL).df()[["doc_id", "copies"]].itertuples(index=False)}
    coder = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, len(coder.encode_ordinary(r.text or ""))) for r in documents.itertuples() for _ in range(int(copies[r.doc_id])))
    assert sorted((r.doc_id, r.n_tokens) for r in C.run(spark, d).select("doc_id", "n_tokens").collect()) == want and len(want) > 50

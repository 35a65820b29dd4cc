"""Exact dedup over calls: failures, retries, micro-batches on the given tables, and no reading of history without hits."""

import pytest

from strandwise.llm import exact_dedup as E
from strandwise.llm.queries import op6_exact_dedup

SCHEMA = "doc_id long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def view(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


ROWS = [(1, "a"), (5, "b"), (2, "a"), (3, None), (4, ""), (6, "c"), (7, "b"), (8, "d")]
WANT = sorted([(1, 2, 2, False), (2, 2, 2, True), (5, 7, 2, False), (7, 7, 2, True), (3, 4, 2, False), (4, 4, 2, True), (6, 6, 1, True), (8, 8, 1, True)], key=str)


@pytest.mark.parametrize("at", ["rows", "stream", "batch", "note"])
def test_a_failed_call_made_again(spark, tmp_path, monkeypatch, at):
    """Wherever a call fails, it gives the rows it would have given when it is made again; other calls before and after count as they should."""
    path = f"file://{tmp_path}/state"
    first = E.exact_dedup(table(spark, [(10, "x"), (11, "a")]), state_dir=path)
    assert view(first) == sorted([(10, 10, 1, True), (11, 11, 1, True)], key=str)
    real, seen = E.digest_state, []

    class Stop(Exception):
        pass

    def fail(*_, **__):
        raise Stop

    with monkeypatch.context() as m:
        if at == "rows":
            m.setattr(E, "_hand_over", fail)
        elif at == "stream":
            m.setattr(E, "run_state", fail)
        elif at == "note":
            m.setattr(E, "states_of", fail)
        else:  # after the first micro-batch
            from pyspark.sql.streaming.readwriter import DataStreamWriter

            put = DataStreamWriter.foreachBatch

            def once(self, f):
                def batch(df, k):
                    seen.append(k)
                    if len(seen) > 1:
                        raise Stop
                    f(df, k)

                return put(self, batch)

            m.setattr(DataStreamWriter, "foreachBatch", once)
        with pytest.raises(Exception):
            E.exact_dedup(table(spark, ROWS), state_dir=path)
    assert real is E.digest_state
    want = sorted([(d, 11, 3, False) if d in (1, 2) else (d, *rest) for d, *rest in WANT], key=str)
    assert view(E.exact_dedup(table(spark, ROWS), state_dir=path)) == want
    assert view(E.exact_dedup(table(spark, ROWS), state_dir=path)) == want  # a finished call counts nothing twice
    assert view(E.exact_dedup(table(spark, [(12, "a"), (9, "d")]), state_dir=path)) == sorted([(12, 12, 4, True), (9, 9, 2, True)], key=str)
    again = E.exact_dedup(table(spark, ROWS), state_dir=path, call="another")
    assert {r.doc_id: r.group_size for r in again.collect()}[1] == 6


def test_a_call_that_is_never_made_again_counts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state"
    with monkeypatch.context() as m:
        m.setattr(E, "run_state", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            E.exact_dedup(table(spark, ROWS), state_dir=path)
    assert view(E.exact_dedup(table(spark, [(20, "c")]), state_dir=path)) == [(20, 20, 2, True)]
    assert view(E.exact_dedup(table(spark, ROWS), state_dir=path)) == WANT  # as it was after that call


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables_come_in_micro_batches(spark, sf, monkeypatch):
    batches = {}
    states_of = E.states_of

    def watch(spark_, path, call):
        rows = spark_.read.parquet(f"{path}/states/{call}")
        batches.update({r.batch: r["count"] for r in rows.groupBy("batch").count().collect()})
        return states_of(spark_, path, call)

    monkeypatch.setattr(E, "states_of", watch)
    rows = op6_exact_dedup(spark, f"/root/testdata/{sf}")
    assert rows.count() == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count()
    assert len(batches) >= 4 and min(batches.values()) > 10


def test_history_is_read_where_hits_are(spark, tmp_path, monkeypatch):
    path, read = f"file://{tmp_path}/state", []
    rows = E._rows
    monkeypatch.setattr(E, "_rows", lambda s, d, calls, schema, slots=None: (read.append((list(calls), slots)), rows(s, d, calls, schema, slots))[1])
    E.exact_dedup(table(spark, [(i, f"t{i}") for i in range(40)]), state_dir=path, call="one").count()
    read.clear()
    E.exact_dedup(table(spark, [(100, "new"), (101, "newer")]), state_dir=path, call="two").count()
    assert read == [(["two"], None)]
    read.clear()
    assert E.exact_dedup(table(spark, [(7, "t30"), (103, "t5")]), state_dir=path, call="three").filter("keep_id in (30, 103)").count() == 2
    assert read[0] == (["three"], None) and [r[0] for r in read[1:]] == [["one"]] and len(read[1][1]) == 1


def test_differences_of_earlier_calls_are_known(spark, tmp_path):
    """One digest for all texts of a length: what a call found to differ is remembered in later calls, also where these hit equal texts only."""
    from pyspark.sql import functions as F

    path, same = f"file://{tmp_path}/state", lambda c: F.lit("same")
    E.exact_dedup(table(spark, [(1, "a"), (2, "b"), (9, "c")]), same, path)
    assert view(E.exact_dedup(table(spark, [(3, "c"), (4, "c")]), same, path)) == sorted([(3, 9, 3, False), (4, 9, 3, False)], key=str)

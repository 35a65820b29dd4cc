"""Training of the network, and denoising that goes on after a stop."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise import cli
from strandwise.operators import denoise, network, score
from strandwise.plans import queries as Q
from strandwise.sources import sinks, text

D = "/root/testdata/sf0.001"


def inputs(n=3, steps=5, width=6):
    rng = np.random.default_rng(2)
    return (rng.integers(0, 4, (n, steps)), *(rng.normal(size=(n, steps)) for _ in range(3)), rng.normal(size=(n, steps, width))), np.array([0, 1, 1, 0, 1])[:n]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('rows')}/rows"
    Q._labelled(spark, D).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("module", ["both", "seq", "signal"])
@pytest.mark.parametrize("plain", [True, False])
def test_gradients_are_finite_differences(module, plain):
    model = score.BiLSTM.random(1, 5, 6, 4, module=module, use_base=plain, use_length=plain, joined_layers=2, branch_layers=2)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = inputs()
    loss = lambda: network.loss_and_gradients(model, w, x, y, 2.0)
    _, hits, grads = loss()
    rng = np.random.default_rng(3)
    for name in w:
        for _ in range(4):
            i = tuple(rng.integers(0, m) for m in w[name].shape)
            was = w[name][i]
            w[name][i] = was + 1e-6
            up = loss()[0]
            w[name][i] = was - 1e-6
            down = loss()[0]
            w[name][i] = was
            assert abs((up - down) / 2e-6 - grads[name][i]) < 1e-7, name
    p = replace(model, weights=w)(*x)
    assert hits == int((p.argmax(axis=1) == y).sum())
    weights = np.where(y == 1, 2.0, 1.0)
    assert np.isclose(loss()[0], -(weights * np.log(p[np.arange(3), y])).sum() / weights.sum(), atol=1e-6)


def test_dropout_keeps_gradients_right():
    model = score.BiLSTM.random(1, 5, 6, 4, joined_layers=2)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = inputs()
    loss = lambda: network.loss_and_gradients(model, w, x, y, 1.0, np.random.default_rng(5), 0.4)
    grad = loss()[2]["joined.weight_hh_l0"][1, 1]
    w["joined.weight_hh_l0"][1, 1] += 1e-6
    up = loss()[0]
    w["joined.weight_hh_l0"][1, 1] -= 2e-6
    assert abs((up - loss()[0]) / 2e-6 - grad) < 1e-7


@pytest.mark.parametrize("kind", ["adam", "rmsprop", "sgd"])
def test_optimisers_find_a_minimum(kind):
    goal = np.array([1.0, -2.0, 0.5], np.float32)
    o = network.Optimiser(kind, np.zeros(3, np.float32), np.zeros(3, np.float32), np.zeros(3, np.float32), 0)
    for t in range(600):
        o.step(o.weights - goal, 0.05 if t < 400 else 0.005, 0.5)
    assert np.allclose(o.weights, goal, atol=0.02)
    with pytest.raises(ValueError):
        network.Schedule(optimiser="ranger")


def test_clipping():
    o = network.Optimiser("sgd", np.zeros(2, np.float32), np.zeros(2, np.float32), np.zeros(2, np.float32), 0)
    o.step(np.array([30.0, 40.0]), 1.0, 0.5)
    assert np.allclose(o.weights, [-0.3, -0.4], atol=1e-6)


def test_training_learns_and_resumes(spark, labelled, tmp_path):
    model, schedule = score.BiLSTM.random(2, 5, 6, 8, joined_layers=1), replace(Q.SMALL, epochs=5, enough=None, syncs=2, least_epochs=5, dropout=0.05, workers=3)
    best, log = network.fit(labelled, model, schedule, labelled)
    assert len(log) == 5 and log[-1]["loss"] < 0.8 * log[0]["loss"] and log[-1]["best"] > 0.7
    assert [e["steps"] for e in log] == sorted(e["steps"] for e in log) and all(e["workers"] == 3 for e in log)
    path = f"file://{tmp_path}/run"
    network.fit(labelled, model, replace(schedule, epochs=2), labelled, path)
    # What a killed call leaves of its third epoch: a state without an entry of the log.
    spark.range(1).write.parquet(f"{path}/state/0002")
    again, same = network.fit(labelled, model, schedule, labelled, path)
    assert same == log and all(np.array_equal(best.weights[k], again.weights[k]) for k in best.weights)
    third, _ = network.fit(labelled, model, schedule, labelled, path)
    assert all(np.array_equal(best.weights[k], third.weights[k]) for k in best.weights)


def test_training_stops(spark, labelled):
    model = score.BiLSTM.random(2, 5, 6, 4, joined_layers=1)
    _, log = network.fit(labelled, model, replace(Q.SMALL, epochs=9, least_epochs=2, rate=0.0, enough=None), labelled)
    assert len(log) == 2 and log[-1]["stop"]
    _, log = network.fit(labelled, model, replace(Q.SMALL, epochs=9, enough=0.1))
    assert len(log) == 1
    none, log = network.fit(labelled.limit(0), model, replace(Q.SMALL, epochs=1, enough=None))
    assert log[0]["steps"] == 0 and all(np.array_equal(none.weights[k], model.weights[k]) for k in model.weights)


def test_batches_of_any_split(labelled):
    rows = labelled.select(*network.INPUTS, "methy_label").toArrow()
    for size in (1, 7, 1000):
        cut = list(network.batched(iter(rows.to_batches(max_chunksize=13)), size))
        assert sum(len(y) for _, y in cut) == rows.num_rows and all(len(y) == size for _, y in cut[:-1])
        assert np.array_equal(np.concatenate([x[4] for x, _ in cut]), score.tensors(rows)[4])


def test_partial_update():
    model = score.BiLSTM.random(0, 5, 6, 4, joined_layers=1)
    given = {"fc2.bias": np.array([1.0, 2.0], np.float32)}
    new = network.updated(model.weights, given)
    assert np.array_equal(new["fc2.bias"], given["fc2.bias"]) and np.array_equal(new["embed"], model.weights["embed"])
    for wrong in ({"other": np.zeros(2)}, {"fc2.bias": np.zeros(3)}):
        with pytest.raises(ValueError):
            network.updated(model.weights, wrong)


def test_names_of_models():
    named = lambda **k: score.BiLSTM({}, **k).name()
    assert [named(), named(module="seq", use_base=False), named(module="signal", use_length=False)] == ["both_bilstm_with_base_with_slen", "seq_bilstm_no_base_with_slen", "signal_bilstm"]


class Killed(Exception):
    pass


class Dies:
    """A scorer of fixed scores that fails after so many fits."""

    def __init__(self, at):
        self.left = at

    def fit(self, rows, weight=None):
        self.left -= 1
        if self.left < 0:
            raise Killed
        return self

    def transform(self, rows):
        return rows.withColumn("prob_1", F.conv(F.substring(F.md5("idx"), 1, 4), 16, 10).cast("double") / 65536)


def test_denoising_goes_on(spark, labelled, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    settings = dict(iterations=3, n=1, score_cf=0.3, ratio=1.1)
    whole = denoise.denoise(labelled, Dies(6), **settings, report=(log := []), path=one)
    with pytest.raises(Killed):
        denoise.denoise(labelled, Dies(3), **settings, path=two)  # in the second iteration
    rest = denoise.denoise(labelled, Dies(4), **settings, report=(again := []), path=two)
    assert len(log) == 3 and again == log and sorted(r.idx for r in rest.collect()) == sorted(r.idx for r in whole.collect())
    sinks.probabilities(denoise.probabilities(spark, two), f"{two}/table")
    table = [r.value.split("\t") for r in text.lines(spark, f"{two}/table").orderBy("line").collect()]
    assert [t[0] for t in table] == sorted(r.idx for r in labelled.collect()) and all(0 <= float(t[1]) <= 1 for t in table)


def test_denoising_drops_wrong_labels(spark, labelled):
    kept = denoise.denoise(labelled, network.Network(score.BiLSTM.random(1, 5, 6, 8, joined_layers=1), Q.SMALL), 1, 2)
    wrong = F.md5("idx") < "2"
    share = lambda rows: rows.filter("methy_label = 1").agg(F.avg(wrong.cast("double"))).first()[0]
    assert share(kept) < 0.6 * share(labelled) and kept.count() > 300


def test_train_command(spark, labelled, tmp_path):
    at = f"file://{tmp_path}"
    sinks.features(labelled, f"{at}/features")
    shape = ["--k", "5", "--width", "6", "--hidden", "4", "--joined_layers", "1"]
    run = lambda *a: (lambda x: x.run(spark, x))(cli.parser().parse_args([*a]))
    learn = ["--features", f"{at}/features", "--valid", f"{at}/features", *shape, "--batch", "64", "--rate", "0.02", "--workers", "2", "--dropout", "0"]
    run("train", *learn, "--epochs", "2", "--out", f"{at}/model")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{at}/model/report").count() == 2
    run("train", *learn, "--epochs", "1", "--init_model", f"{at}/model/best", "--out", f"{at}/more")
    run("call", "--features", f"{at}/features", "--model", f"{at}/more/best", "--hidden", "4", "--joined_layers", "1", "--out", f"{at}/calls")
    assert text.calls(spark, f"{at}/calls").count() == labelled.count()
    run("clean", "--features", f"{at}/features", *shape, "--iterations", "1", "--rounds", "1", "--epochs", "1", "--workers", "2", "--probabilities", f"{at}/probs", "--report", f"{at}/log", "--out", f"{at}/clean")
    assert spark.read.text(f"{at}/probs").count() == labelled.count() and 0 < spark.read.text(f"{at}/clean").count()


def test_rows_are_made_once(spark):
    """Epochs read rows that were written, not what the rows were made of."""
    schema = "idx string, k_mer string, signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>, methy_label int"
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    data = [(str(i), "ACGTA", [i % 2 - 0.5] * 5, [0.1] * 5, [4] * 5, [[0.1 * j for j in range(6)]] * 5, i % 2) for i in range(24)]
    rows = spark.createDataFrame(data, schema).mapInArrow(run, schema)
    from strandwise.operators import network, score

    _, log = network.fit(rows, score.BiLSTM.random(1, 5, 6, 4, joined_layers=1), network.Schedule(epochs=3, least_epochs=3, batch=8, workers=2), rows)
    assert len(log) == 3 and made.value == 48

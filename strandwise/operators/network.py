"""Training of the network on executors: gradients through time over Arrow batches, weights averaged by a shuffle.

The driver holds the weights (of a fixed size) between two syncs and a log of epochs; rows, gradients and averages stay on executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import score
from .samples import chance
from .tables import exists, new_folder, remove, removed, written
from .train import quality

SHARD = 8192
KINDS = ("weights", "first", "second")
SENT = "part int, kind string, shard int, n long, steps long, loss double, hits long, values array<float>"
LOG = "epoch int, steps long, workers int, loss double, trained double, accuracy double, best double, saved boolean, stop boolean"
INPUTS = ("k_mer", "signal_means", "signal_stds", "signal_lens", "raw_signals")


@dataclass(frozen=True)
class Schedule:
    """How a network is trained. `enough` ends training when the accuracy on training rows reaches it; `workers` is the number of tasks (None: the cluster's cores)."""

    epochs: int = 10
    least_epochs: int = 5
    batch: int = 512
    rate: float = 0.001
    decay: float = 0.1
    decay_every: int = 2
    clip: float = 0.5
    pos_weight: float = 1.0
    optimiser: str = "adam"
    dropout: float = 0.5
    tolerance: float = 0.0002
    enough: float | None = None
    workers: int | None = None
    syncs: int = 1
    seed: int = 0

    def __post_init__(self):
        if self.optimiser not in ("adam", "rmsprop", "sgd"):
            raise ValueError(f"unknown optimiser: {self.optimiser}")


# Forward and backward passes


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One direction of one layer: the states of all steps (batch, steps, hidden), and what the way back needs."""
    n, steps, _ = x.shape
    hidden = u.shape[1]
    into, h, c = x @ w.T + b, np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
    out, gates, cells = (np.empty((n, steps, m), x.dtype) for m in (hidden, 4 * hidden, hidden))
    for t in range(steps):
        z = into[:, t] + h @ u.T
        bent = np.tanh(z[:, 2 * hidden : 3 * hidden])
        z = score.sigmoid(z)
        z[:, 2 * hidden : 3 * hidden] = bent
        i, f, g, o = z[:, :hidden], z[:, hidden : 2 * hidden], bent, z[:, 3 * hidden :]
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t], gates[:, t], cells[:, t] = h, z, c
    return out, (x, out, gates, cells)


def lstm_back(d: np.ndarray, kept: tuple, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of a loss with gradient d by the states: by the input, w, u and b."""
    x, out, gates, cells = kept
    n, steps, hidden = out.shape
    dz = np.empty((n, steps, 4 * hidden), x.dtype)
    dh, dc = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, g, o = (gates[:, t, j * hidden : (j + 1) * hidden] for j in range(4))
        before = cells[:, t - 1] if t else np.zeros_like(dc)
        bent = np.tanh(cells[:, t])
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - bent**2)
        for j, part in enumerate((dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g**2), dh * bent * o * (1 - o))):
            dz[:, t, j * hidden : (j + 1) * hidden] = part
        dh, dc = dz[:, t] @ u, dc * f
    flat = dz.reshape(-1, 4 * hidden)
    earlier = np.concatenate([np.zeros((n, 1, hidden), x.dtype), out[:, :-1]], axis=1)
    return dz @ w, flat.T @ x.reshape(-1, x.shape[2]), flat.T @ earlier.reshape(-1, hidden), flat.sum(axis=0)


class Pass:
    """One pass through a network: what each part kept, so that gradients find their way back."""

    def __init__(self, model: score.BiLSTM, weights: Mapping[str, np.ndarray], rng: np.random.Generator | None, dropout: float):
        self.model, self.w, self.rng, self.dropout = model, weights, rng, dropout
        self.back: list = []
        self.grads = {k: np.zeros_like(v) for k, v in weights.items()}

    def layers(self, x: np.ndarray, name: str, count: int) -> np.ndarray:
        for layer in range(count):
            if layer:
                x = self.drop(x)
            keys = [[f"{name}.{k}_l{layer}{way}" for k in ("weight_ih", "weight_hh", "bias")] for way in ("", "_reverse")]
            (ahead, kept), (behind, kept_back) = (lstm(y, *(self.w[k] for k in ks)) for y, ks in zip((x, x[:, ::-1]), keys))

            def back(d, keys=keys, kept=kept, kept_back=kept_back):
                half = d.shape[2] // 2
                total = None
                for part, kept_, ks, turn in ((d[:, :, :half], kept, keys[0], False), (d[:, ::-1, half:], kept_back, keys[1], True)):
                    dx, *found = lstm_back(part, kept_, self.w[ks[0]], self.w[ks[1]])
                    for k, g in zip(ks, found):
                        self.grads[k] += g
                    dx = dx[:, ::-1] if turn else dx
                    total = dx if total is None else total + dx
                return total

            self.back.append(back)
            x = np.concatenate([ahead, behind[:, ::-1]], axis=2)
        return x

    def linear(self, x: np.ndarray, name: str, bent: bool) -> np.ndarray:
        y = x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]
        live = y > 0

        def back(d):
            d = d * live if bent else d
            self.grads[f"{name}.weight"] += d.reshape(-1, d.shape[-1]).T @ x.reshape(-1, x.shape[-1])
            self.grads[f"{name}.bias"] += d.reshape(-1, d.shape[-1]).sum(axis=0)
            return d @ self.w[f"{name}.weight"]

        self.back.append(back)
        return np.maximum(y, 0) if bent else y

    def drop(self, x: np.ndarray) -> np.ndarray:
        if self.rng is None or not self.dropout:
            return x
        keep = ((self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout)).astype(x.dtype)
        self.back.append(lambda d: d * keep)
        return x * keep

    def unwind(self, d: np.ndarray, upto: int = 0) -> np.ndarray:
        while len(self.back) > upto:
            d = self.back.pop()(d)
        return d


def loss_and_gradients(model: score.BiLSTM, weights: Mapping[str, np.ndarray], inputs: tuple, labels: np.ndarray, pos_weight: float = 1.0, rng: np.random.Generator | None = None, dropout: float = 0.0) -> tuple[float, int, dict[str, np.ndarray]]:
    """The weighted cross-entropy (over the sum of weights), how many labels are hit, and the gradient of every weight."""
    bases, means, stds, lens, signals = inputs
    kind = weights["fc2.weight"].dtype
    p = Pass(model, weights, rng, dropout)
    parts, ways = [], []
    if model.module in ("both", "seq"):
        columns = [weights["embed"][bases]] if model.use_base else []
        columns += [means[:, :, None], stds[:, :, None]] + ([lens[:, :, None]] if model.use_length else [])
        x = np.concatenate(columns, axis=2).astype(kind)
        parts.append(p.linear(p.layers(x, "seq", model.branch_layers), "seq_fc", True))
        ways.append(("seq", p.back))
        p.back = []
    if model.module in ("both", "signal"):
        parts.append(p.linear(p.layers(signals.astype(kind), "signal", model.branch_layers), "signal_fc", True))
        ways.append(("signal", p.back))
        p.back = []
    x = p.layers(np.concatenate(parts, axis=2), "joined", model.joined_layers)
    n, steps, both = x.shape
    half = both // 2
    ends = np.concatenate([x[:, -1, :half], x[:, 0, half:]], axis=1)
    below = len(p.back)
    z = p.linear(p.drop(p.linear(p.drop(ends), "fc1", True)), "fc2", False)
    z = z - z.max(axis=1, keepdims=True)
    log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    w = np.where(labels == 1, pos_weight, 1.0).astype(kind)
    at = np.arange(n), labels
    loss = float(-(w * log[at]).sum() / w.sum())
    d = np.exp(log)
    d[at] -= 1
    d = p.unwind(d * (w / w.sum())[:, None], below)
    whole = np.zeros_like(x)
    whole[:, -1, :half], whole[:, 0, half:] = d[:, :half], d[:, half:]
    d = p.unwind(whole)
    for (name, back), part in zip(ways, np.split(d, np.cumsum([x.shape[2] for x in parts])[:-1], axis=2)):
        p.back = back
        got = p.unwind(part)
        if name == "seq" and model.use_base:
            np.add.at(p.grads["embed"], bases, got[:, :, : weights["embed"].shape[1]])
    return loss, int((z.argmax(axis=1) == labels).sum()), p.grads


class Optimiser:
    """Steps of Adam, RMSprop or SGD with momentum over one flat vector of weights; gradients are clipped by their whole norm."""

    def __init__(self, kind: str, weights: np.ndarray, first: np.ndarray, second: np.ndarray, steps: int):
        self.kind, self.weights, self.first, self.second, self.steps = kind, weights, first, second, steps

    def step(self, grad: np.ndarray, rate: float, clip: float) -> None:
        norm = float(np.sqrt((grad.astype(np.float64) ** 2).sum()))
        grad = grad * min(1.0, clip / (norm + 1e-6)) if clip else grad
        self.steps += 1
        if self.kind == "adam":
            self.first = 0.9 * self.first + 0.1 * grad
            self.second = 0.999 * self.second + 0.001 * grad**2
            move = (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)
        elif self.kind == "rmsprop":
            self.second = 0.99 * self.second + 0.01 * grad**2
            move = grad / (np.sqrt(self.second) + 1e-8)
        else:
            self.first = 0.8 * self.first + grad
            move = self.first
        self.weights = (self.weights - rate * move).astype(np.float32)


# Flat weights


def flat(weights: Mapping[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype(np.float32)


def shaped(vector: np.ndarray, like: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def updated(weights: Mapping[str, np.ndarray], given: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights with those that are given in their place; a name or shape that the network lacks is an error."""
    for k, v in given.items():
        if k not in weights or weights[k].shape != v.shape:
            raise ValueError(f"the network has no weights {k} of shape {v.shape}")
    return {k: np.asarray(given.get(k, v), dtype=np.float32) for k, v in weights.items()}


# Epochs


@dataclass
class State:
    """Weights and the optimiser's moments, as flat vectors."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def table(self) -> pa.Table:
        """kind, shard, steps, values: pieces of SHARD numbers."""
        cells = [(kind, i // SHARD, self.steps, getattr(self, kind)[i : i + SHARD]) for kind in KINDS for i in range(0, len(self.weights), SHARD)]
        return pa.table(dict(zip(("kind", "shard", "steps", "values"), (pa.array(x, t) for x, t in zip(zip(*cells), (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float32())))))))

    @classmethod
    def of(cls, table: pa.Table, steps: int) -> State:
        table = table.sort_by("shard")
        kinds = np.array(table.column("kind").to_pylist())
        values = table.column("values").combine_chunks()
        return cls(*(values.filter(pa.array(kinds == kind)).flatten().to_numpy(zero_copy_only=False).astype(np.float32) for kind in KINDS), steps)


def one_sync(rows: DataFrame, model: score.BiLSTM, state: State, schedule: Schedule, epoch: int, sync: int, workers: int) -> tuple[State, float, float]:
    """One pass over a share of the epoch's rows: each task steps through its own, then weights and moments are averaged by rows.

    Rows go to tasks by a seeded hash and are taken in its order, so a task that is run again gives the same; averages are summed in the
    order of tasks.
    """
    rate = schedule.rate * schedule.decay ** (epoch // schedule.decay_every)
    shared = rows.sparkSession.sparkContext.broadcast((model, state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, begin = shared.value
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([schedule.seed, epoch, sync, part])
        best = Optimiser(schedule.optimiser, begin.weights.copy(), begin.first.copy(), begin.second.copy(), begin.steps)
        n, losses, hits = 0, 0.0, 0
        for inputs, labels in batched(batches, schedule.batch):
            loss, right, grads = loss_and_gradients(net, shaped(best.weights, net.weights), inputs, labels, schedule.pos_weight, rng, schedule.dropout)
            best.step(flat(grads), rate, schedule.clip)
            n, losses, hits = n + len(labels), losses + loss * len(labels), hits + right
        if n:
            for kind, vector in (("weights", best.weights), ("first", best.first), ("second", best.second)):
                pieces = [vector[i : i + SHARD] for i in range(0, len(vector), SHARD)]
                m = len(pieces)
                cells = [pa.array([part] * m, pa.int32()), pa.array([kind] * m), pa.array(range(m), pa.int32()), pa.array([n] * m, pa.int64()), pa.array([best.steps] * m, pa.int64()), pa.array([losses] * m), pa.array([hits] * m, pa.int64()), pa.array([p.astype(np.float32) for p in pieces], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in SENT.split(", ")])

    def average(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n = table.column("n").to_numpy().astype(np.float64)
        values = table.column("values").combine_chunks()
        mean = (values.flatten().to_numpy().reshape(len(values), -1).astype(np.float64) * (n / n.sum())[:, None]).sum(axis=0)
        return pa.table({"kind": table.column("kind")[:1], "shard": table.column("shard")[:1], "values": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})

    at = F.col("_at")
    share = F.conv(F.substring(at, 1, 6), 16, 10).cast("long") * schedule.syncs
    mine = rows.withColumn("_at", chance(schedule.seed + 1000 * (epoch + 1), "idx")).filter(F.floor(share / 16**6) == sync)
    mine = mine.repartition(workers, "_at").sortWithinPartitions("_at", "idx").select(*INPUTS, "methy_label")
    sent = written(mine.mapInArrow(run, SENT), "gradients")
    told = sent.filter("kind = 'weights' and shard = 0").agg(F.sum("n").alias("n"), F.max("steps").alias("steps"), F.sum("loss").alias("loss"), F.sum("hits").alias("hits")).first()
    if told.n is None:
        return state, 0.0, 0.0
    means = sent.groupBy("kind", "shard").applyInArrow(average, "kind string, shard int, values array<float>").toArrow()  # the size of the model, three times
    removed(sent)
    return State.of(means, told.steps), told.loss / told.n, told.hits / told.n


def batched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Inputs and labels of `size` rows at a time, whatever the Arrow batches are."""
    held: list[pa.RecordBatch] = []
    count = 0

    def send(table: pa.Table):
        return score.tensors(table), table.column("methy_label").to_numpy().astype(np.int64)

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= size:
            table = pa.Table.from_batches(held)
            yield send(table.slice(0, size))
            held, count = table.slice(size).to_batches(), count - size
    if count:
        yield send(pa.Table.from_batches(held))


def _save(spark, state: State, path: str) -> None:
    spark.createDataFrame(state.table()).write.mode("overwrite").parquet(path)


def _load(spark, path: str) -> State:
    table = spark.read.parquet(path).toArrow()
    return State.of(table, table.column("steps")[0].as_py())


def fit(rows: DataFrame, model: score.BiLSTM, schedule: Schedule = Schedule(), valid: DataFrame | None = None, path: str | None = None) -> tuple[score.BiLSTM, list[dict]]:
    """Train on features with methy_label and a unique idx; returns the best network and a log with a dictionary for each epoch.

    After each epoch, accuracy is measured on `valid` (or is that on the training rows as they came). The network is kept if that is above
    the best so far less `tolerance`; from `least_epochs` on, training ends with the first epoch that isn't above the best. Under `path` stay
    the last state, that of the kept network, and the log: a call with the same path goes on after the last epoch there. An epoch counts
    once its log is written; what a killed call left of a later one is written over.
    """
    spark = rows.sparkSession
    owned = path is None
    path = path or new_folder(spark, "network")
    log: list[dict] = []
    while exists(spark, f"{path}/log/{len(log):04d}/_SUCCESS"):
        log.append(spark.read.schema(LOG).parquet(f"{path}/log/{len(log):04d}").first().asDict())
    workers = log[0]["workers"] if log else schedule.workers or spark.sparkContext.defaultParallelism
    size = sum(w.size for w in model.weights.values())
    state = _load(spark, f"{path}/state/{len(log) - 1:04d}") if log else State(flat(model.weights), np.zeros(size, np.float32), np.zeros(size, np.float32))
    # Each epoch reads the rows anew, so what they are made of is computed once.
    inputs = [] if len(log) >= schedule.epochs or (log and log[-1]["stop"]) else [written(rows.select("idx", *INPUTS, "methy_label"), "training")]
    rows = inputs[0] if inputs else rows
    if inputs and valid is not None:
        valid = written(valid.select(*INPUTS, "methy_label"), "validation")
        inputs.append(valid)
    for epoch in range(len(log), schedule.epochs):
        if log and log[-1]["stop"]:
            break
        told = []
        for sync in range(schedule.syncs):
            state, *figures = one_sync(rows, model, state, schedule, epoch, sync, workers)
            told.append(figures)
        loss, trained = (float(np.mean(x)) for x in zip(*told))
        now = replace(model, weights=shaped(state.weights, model.weights))
        accuracy = float(quality(with_probability(valid, now)).first().accuracy) if valid is not None else trained
        best = log[-1]["best"] if log else 0.0
        entry = {
            "epoch": epoch, "steps": int(state.steps), "workers": workers, "loss": loss, "trained": trained, "accuracy": accuracy, "best": max(best, accuracy), "saved": accuracy > best - schedule.tolerance or not log,
            "stop": (accuracy <= best and epoch >= schedule.least_epochs - 1) or (schedule.enough is not None and trained >= schedule.enough),
        }
        _save(spark, state, f"{path}/state/{epoch:04d}")
        spark.createDataFrame([entry], LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{epoch:04d}")
        log.append(entry)
        kept = max(e["epoch"] for e in log if e["saved"])
        remove(spark, [f"{path}/state/{e:04d}" for e in range(epoch) if e != kept])
    kept = max((e["epoch"] for e in log if e["saved"]), default=None)
    best = model if kept is None else replace(model, weights=shaped(_load(spark, f"{path}/state/{kept:04d}").weights, model.weights))
    removed(*inputs)
    if owned:
        remove(spark, [path])
    return best, log


def with_probability(rows: DataFrame, model: score.BiLSTM, batch: int = 512) -> DataFrame:
    """Add prob_1; all columns stay."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                p = shared.value(*score.tensors(pa.Table.from_batches([part]))).astype(float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p[:, 1])], names=[*part.schema.names, "prob_1"])

    return rows.mapInArrow(run, rows.withColumn("prob_1", F.lit(0.0)).schema)


@dataclass
class Network:
    """A scorer with fit and transform, as denoising asks for: a network that starts from `model` and learns by `schedule`."""

    model: score.BiLSTM
    schedule: Schedule = Schedule(epochs=3, enough=0.95)

    def fit(self, rows: DataFrame, weight: str | None = None) -> Network:
        return Network(fit(rows, self.model, self.schedule)[0], self.schedule)

    def transform(self, rows: DataFrame) -> DataFrame:
        return with_probability(rows, self.model)

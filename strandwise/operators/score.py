"""Scoring of features: a bidirectional LSTM in NumPy over Arrow batches, and a linear scorer that Spark fits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import sequence as S

#: The code of a base by its byte; letters without one count as N.
CODES = np.full(256, S.DNA_CODES.index("N"))
CODES[[ord(b) for b in S.DNA_CODES]] = np.arange(len(S.DNA_CODES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.minimum(np.maximum(x, -60), 60)))


@dataclass
class BiLSTM:
    """Weights by name, and the shape of a model.

    A sequence branch (embedded base, mean, deviation, length) and a signal branch (samples of a base) each go through
    a bidirectional LSTM and a linear layer; joined, through another LSTM. The last forward and first backward states give two
    classes by two linear layers. States start at zero, so scores are the same in each run.
    """

    weights: Mapping[str, np.ndarray]
    branch_layers: int = 1
    joined_layers: int = 3
    hidden: int = 256
    module: str = "both"
    use_base: bool = True
    use_length: bool = True

    def lstm(self, x: np.ndarray, name: str, layers: int) -> np.ndarray:
        """x: batch, steps, inputs; returns batch, steps, both directions."""
        for layer in range(layers):
            both = []
            for way in ("", "_reverse"):
                w, u, b = (self.weights[f"{name}.{k}_l{layer}{way}"] for k in ("weight_ih", "weight_hh", "bias"))
                steps = x[:, ::-1] if way else x
                hidden = b.shape[0] // 4
                gates, h, c, out = steps @ w.T + b, np.zeros((len(x), hidden), x.dtype), np.zeros((len(x), hidden), x.dtype), []
                for t in range(x.shape[1]):
                    i, f, g, o = np.split(gates[:, t] + h @ u.T, 4, axis=1)
                    c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                    h = sigmoid(o) * np.tanh(c)
                    out.append(h)
                out = np.stack(out, axis=1)
                both.append(out[:, ::-1] if way else out)
            x = np.concatenate(both, axis=2)
        return x

    def linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.weight"].T + self.weights[f"{name}.bias"]

    def __call__(self, bases: np.ndarray, means: np.ndarray, stds: np.ndarray, lens: np.ndarray, signals: np.ndarray) -> np.ndarray:
        """The probabilities of both classes, one row a site."""
        parts = []
        if self.module in ("both", "seq"):
            columns = [self.weights["embed"][bases]] if self.use_base else []
            columns += [means[:, :, None], stds[:, :, None]] + ([lens[:, :, None]] if self.use_length else [])
            x = np.concatenate(columns, axis=2).astype(np.float32)
            parts.append(np.maximum(self.linear(self.lstm(x, "seq", self.branch_layers), "seq_fc"), 0))
        if self.module in ("both", "signal"):
            parts.append(np.maximum(self.linear(self.lstm(signals.astype(np.float32), "signal", self.branch_layers), "signal_fc"), 0))
        x = self.lstm(np.concatenate(parts, axis=2), "joined", self.joined_layers)
        half = x.shape[2] // 2
        x = np.concatenate([x[:, -1, :half], x[:, 0, half:]], axis=1)
        x = self.linear(np.maximum(self.linear(x, "fc1"), 0), "fc2")
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def name(self) -> str:
        """What tells a kind of model apart in names: its branches and, where bases have a branch, which inputs that has."""
        kind = f"{self.module}_bilstm"
        return kind if self.module == "signal" else f"{kind}_{'with' if self.use_base else 'no'}_base_{'with' if self.use_length else 'no'}_slen"

    def parameters(self) -> int:
        return int(sum(w.size for w in self.weights.values()))

    @classmethod
    def random(cls, seed: int = 0, seq_len: int = 13, signal_len: int = 16, hidden: int = 8, vocabulary: int = 16, embedded: int = 4, **shape) -> BiLSTM:
        """A model with small random weights."""
        rng, w = np.random.default_rng(seed), {}
        model = cls(w, hidden=hidden, **shape)
        new = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)

        def lstm(name: str, inputs: int, size: int, layers: int) -> None:
            for layer in range(layers):
                for way in ("", "_reverse"):
                    n = inputs if layer == 0 else 2 * size
                    w[f"{name}.weight_ih_l{layer}{way}"], w[f"{name}.weight_hh_l{layer}{way}"], w[f"{name}.bias_l{layer}{way}"] = new(4 * size, n), new(4 * size, size), new(4 * size)

        half = hidden // 2 if model.module == "both" else hidden
        w["embed"] = new(vocabulary, embedded)
        lstm("seq", (embedded if model.use_base else 0) + 2 + model.use_length, half, model.branch_layers)
        lstm("signal", signal_len, half, model.branch_layers)
        for name in ("seq_fc", "signal_fc"):
            w[f"{name}.weight"], w[f"{name}.bias"] = new(half, 2 * half), new(half)
        lstm("joined", 2 * half if model.module == "both" else half, hidden, model.joined_layers)
        w["fc1.weight"], w["fc1.bias"], w["fc2.weight"], w["fc2.bias"] = new(hidden, 2 * hidden), new(hidden), new(2, hidden), new(2)
        return model


def save_weights(spark, weights: Mapping[str, np.ndarray], path: str) -> None:
    cells = {"name": pa.array(list(weights)), "shape": pa.array([list(v.shape) for v in weights.values()], pa.list_(pa.int32())), "values": pa.array([v.ravel().astype(np.float32) for v in weights.values()], pa.list_(pa.float32()))}
    spark.createDataFrame(pa.table(cells)).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> dict[str, np.ndarray]:
    """Weights by name; a model has a fixed size."""
    table = spark.read.parquet(path).toArrow()
    cells = zip(table.column("name").to_pylist(), table.column("shape").to_pylist(), table.column("values"))
    return {name: values.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(shape) for name, shape, values in cells}


def load_checkpoint(path: str, names: Mapping[str, str]) -> dict[str, np.ndarray]:
    """Weights of a torch checkpoint, under the names that BiLSTM uses (`names`: theirs to ours; two biases of a gate add up)."""
    try:
        import torch
    except ImportError as e:
        raise ImportError("reading a torch checkpoint needs torch, which isn't installed") from e
    out: dict[str, np.ndarray] = {}
    for key, value in torch.load(path, map_location="cpu").items():
        if key in names:
            out[names[key]] = out.get(names[key], 0) + value.numpy()
    return out


def _values(column: pa.ChunkedArray | pa.Array, kind: type = np.float32) -> np.ndarray:
    """The numbers of a column of lists, or of lists of lists, as one flat array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    while pa.types.is_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(kind)


def tensors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bases, means, deviations, lengths and signals of features (all k-mers of one length), from Arrow's buffers."""
    n = table.num_rows
    letters = np.frombuffer("".join(table.column("k_mer").to_pylist()).upper().encode("latin-1", "replace"), dtype=np.uint8)
    flat = [_values(table.column(c)).reshape(n, -1) for c in ("signal_means", "signal_stds", "signal_lens")]
    steps = flat[0].shape[1]
    return CODES[letters].reshape(n, steps), *flat, _values(table.column("raw_signals")).reshape(n, steps, -1)


def neural(rows: DataFrame, model: BiLSTM, batch: int = 512) -> DataFrame:
    """Calls of features. The model has a fixed size and is broadcast; each Arrow batch is scored in steps of `batch` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["chrom", "pos", "alignstrand", "pos_in_strand", "readname", "read_strand", "k_mer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                p = shared.value(*tensors(pa.Table.from_batches([part]))).astype(float)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*kept, "p0", "p1"])

    schema = "chrom string, pos long, alignstrand string, pos_in_strand long, readname string, read_strand string, k_mer string, p0 double, p1 double"
    scored = rows.select(*kept, "signal_means", "signal_stds", "signal_lens", "raw_signals").mapInArrow(run, schema)
    return as_calls(scored)


def as_calls(scored: DataFrame) -> DataFrame:
    """Calls of rows with p0 and p1: rounded probabilities, the likelier label (ties: 0), the five bases in the middle."""
    p0, p1 = N.normalized_probs(F.col("p0"), F.col("p1"))
    return scored.select("chrom", "pos", F.col("alignstrand").alias("strand"), "pos_in_strand", "readname", "read_strand", p0.alias("prob_0"), p1.alias("prob_1"), (F.col("p1") > F.col("p0")).cast("int").alias("called_label"), S.center(F.col("k_mer")).alias("k_mer"))


@dataclass
class Linear:
    """A scorer with fit and transform: logistic regression by Spark over numeric columns."""

    columns: tuple[str, ...]
    label: str = "methy_label"
    settings: dict = field(default_factory=lambda: {"maxIter": 20, "regParam": 0.01})
    model: object = None

    def fit(self, rows: DataFrame, weight: str | None = None) -> Linear:
        regression = LogisticRegression(featuresCol="_x", labelCol=self.label, **self.settings)
        regression = regression.setWeightCol(weight) if weight else regression
        return Linear(self.columns, self.label, self.settings, regression.fit(self._with_vector(rows)))

    def _with_vector(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.columns), outputCol="_x", handleInvalid="keep").transform(rows)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add prob_1."""
        scored = self.model.transform(self._with_vector(rows))
        return scored.withColumn("prob_1", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


@dataclass
class Fixed:
    """A scorer that learns nothing: prob_1 is an expression of the row."""

    expression: str

    def fit(self, rows: DataFrame, weight: str | None = None) -> Fixed:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prob_1", F.expr(self.expression).cast("double"))

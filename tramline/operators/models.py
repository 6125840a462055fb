"""A versioned store of model weights, a distributed trainer, and a sequence model.

Weights are a few named arrays. The store is a table with one row for each array of each
version; what a model takes as input is read from the shapes. The trainer takes steps of mini-batches: each task adds
up the gradient of its rows, the sums are added up in two levels, and the driver, which holds the weights only, moves them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
_STORED = "model string, version long, name string, shape array<int>, values array<double>, config string"


# --- store
def save(spark: SparkSession, path: str, model: str, weights: Weights, config: dict | None = None) -> int:
    """Adds a version of the model and returns its number; older ones stay."""
    version = (latest(spark, path, model) or 0) + 1
    text = json.dumps(config or {}, sort_keys=True)
    rows = [(model, version, name, list(a.shape), np.asarray(a, float).ravel().tolist(), text) for name, a in sorted(weights.items())]
    # One file: a version is there as a whole or not at all.
    spark.createDataFrame(rows, _STORED).coalesce(1).write.mode("append").partitionBy("model").parquet(path)
    return version


def _stored(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_STORED).parquet(path).where(F.col("model") == model)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def latest(spark: SparkSession, path: str, model: str) -> int | None:
    rows = _stored(spark, path, model)
    return None if rows is None else rows.agg(F.max("version")).first()[0]


def load(spark: SparkSession, path: str, model: str, version: int | None = None) -> tuple[Weights, dict]:
    """Weights and configuration of a version, of the latest if not given."""
    version = latest(spark, path, model) if version is None else version
    rows = _stored(spark, path, model)
    found = [] if rows is None or version is None else rows.where(F.col("version") == version).collect()
    if not found:
        raise LookupError(f"no model {model!r} of version {version} in {path}")
    return {r.name: np.array(r["values"]).reshape(r["shape"]) for r in found}, json.loads(found[0].config)


def widths(weights: Weights) -> dict[str, int]:
    """Numbers of inputs, from the shapes: ``features`` of a linear model; ``series0``, ``series1``, ... and ``statistics`` of a sequence model."""
    if "local0.forward.input" not in weights:
        return {"features": weights["linear"].shape[0] - 1}
    series = {f"series{k}": weights[f"local{k}.forward.input"].shape[1] for k in range(sum(n.startswith("local") and n.endswith(".forward.input") for n in weights))}
    return series | {"statistics": weights["hidden"].shape[0] - 1 - 2 * weights["global0.forward.back"].shape[1]}


def check_widths(weights: Weights, **given: int) -> None:
    """Raises where the inputs at hand are not as wide as the model's."""
    wanted = widths(weights)
    wrong = {k: (n, wanted.get(k)) for k, n in given.items() if wanted.get(k) != n}
    if wrong:
        raise ValueError("; ".join(f"{k}: {n} given, the model takes {w}" for k, (n, w) in wrong.items()))


# --- linear softmax model: loss and gradient of some rows
@dataclass(frozen=True)
class Settings:
    """loss: cross_entropy (weighted by class) or focal (with smoothed labels). The norm of a step's gradient is at most ``clip``."""

    epochs: int = 60
    batches: int = 4
    rate: float = 0.05
    decay: float = 1e-4
    clip: float = 1.0
    patience: int = 25
    loss: str = "cross_entropy"
    gamma: float = 2.0
    smoothing: float = 0.1
    seed: int = 42


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.ones((len(x), 1))))


def sums(linear: np.ndarray, x: np.ndarray, y: np.ndarray, by_class: np.ndarray, s: Settings) -> np.ndarray:
    """Gradient, loss, what to divide by, rows and right guesses of some rows, one after the other; sums, so that those of parts add up."""
    x = with_one(x)
    p = softmax(x @ linear)
    row, n = np.arange(len(y)), p.shape[1]
    if s.loss == "focal":
        target = np.full_like(p, s.smoothing / n)
        target[row, y] += 1 - s.smoothing
        target *= by_class
        log = np.log(p + 1e-8)
        loss = -(((1 - p) ** s.gamma) * target * log).sum()
        slope = p * target * (s.gamma * (1 - p) ** (s.gamma - 1) * log - (1 - p) ** s.gamma / (p + 1e-8))
        back, share = slope - p * slope.sum(axis=1, keepdims=True), float(len(y))
    elif s.loss == "cross_entropy":
        each = by_class[y]
        loss = -(each * np.log(p[row, y] + 1e-300)).sum()
        back, share = p.copy(), each.sum()
        back[row, y] -= 1
        back *= each[:, None]
    else:
        raise ValueError(s.loss)
    return np.concatenate(((x.T @ back).ravel(), (loss, share, len(y), (p.argmax(axis=1) == y).sum())))


@dataclass
class State:
    """Weights, the moments of their steps, and how far training is."""

    linear: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    steps: int = 0
    epoch: int = 0
    best_loss: float = math.inf
    since: int = 0


def moved(state: State, gradient: np.ndarray, s: Settings) -> State:
    """One step of Adam with decoupled decay, of a gradient whose norm is cut."""
    norm = np.sqrt((gradient**2).sum())
    gradient = gradient * min(1.0, s.clip / (norm + 1e-12))
    first, second, t = 0.9 * state.first + 0.1 * gradient, 0.999 * state.second + 0.001 * gradient**2, state.steps + 1
    step = (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return replace(state, linear=state.linear * (1 - s.rate * s.decay) - s.rate * step, first=first, second=second, steps=t)


def start(width: int, classes: int) -> State:
    zero = np.zeros((width + 1, classes))
    return State(zero, zero, zero, zero)


def epoch_order(s: Settings, epoch: int) -> list[int]:
    return np.random.default_rng((s.seed, epoch)).permutation(s.batches).tolist()


def judged(state: State, loss: float) -> State:
    """After an epoch: the best weights so far by the loss of the rows that were left out."""
    better = loss < state.best_loss
    return replace(state, epoch=state.epoch + 1, best=state.linear if better else state.best, best_loss=min(loss, state.best_loss), since=0 if better else state.since + 1)


# --- the same over a table
def _added(rows: DataFrame, linear: np.ndarray, by_class: np.ndarray, s: Settings) -> np.ndarray:
    """``sums`` over a table (features, y): of each task, then of some tasks each, then of these."""
    size = linear.size + 4
    shared = rows.sparkSession.sparkContext.broadcast((linear, by_class))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, (weights, classes) = np.zeros(size), shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                total += sums(weights, x, batch.column(1).to_numpy(), classes, s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["values"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["values"])

    parts = rows.select("features", "y").mapInArrow(own, "values array<double>")
    n = rows.rdd.getNumPartitions()
    if n > 16:
        parts = parts.repartition(math.isqrt(n)).mapInArrow(together, "values array<double>")
    out = np.sum([r["values"] for r in parts.collect()], axis=0) if n else np.zeros(size)
    shared.unpersist()
    return out


@dataclass
class Classifier:
    labels: list[str]
    weights: Weights
    history: list[dict]

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, pred_label, confidence, probabilities) of rows with ``features``; missing ones count as 0."""
        weights, labels = self.weights, self.labels
        width = widths(weights)["features"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.nan_to_num(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
                if x.shape[1] != width:
                    raise ValueError(f"features: {x.shape[1]} given, the model takes {width}")
                p = softmax(with_one((x - weights["mean"]) / weights["divisor"]) @ weights["linear"])
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([labels[k] for k in best]), pa.array(p[np.arange(len(p)), best]), pa.array(list(p), pa.list_(pa.float64()))],
                    [key, "pred_label", "confidence", "probabilities"])

        kind = rows.schema[key].dataType.simpleString()
        filled = F.transform("features", lambda v: F.coalesce(v, F.lit(0.0)))
        return rows.select(key, filled.alias("features")).mapInArrow(run, f"{key} {kind}, pred_label string, confidence double, probabilities array<double>")


def restore(spark: SparkSession, path: str, model: str, version: int | None = None) -> Classifier:
    weights, config = load(spark, path, model, version)
    return Classifier(config["labels"], weights, config["history"])


def fit(train: DataFrame, valid: DataFrame, key: str, path: str, model: str, settings: Settings = Settings(), label: str = "label", class_weights: dict[str, float] | None = None, resume: bool = False) -> Classifier:
    """Trains a linear softmax model on ``features`` (array<double>, standardised by the training rows) and stores it.

    Rows are dealt to mini-batches by a hash of the key and written once, a folder for each
    mini-batch, so a step reads its own rows. After each epoch the state goes to the store: with ``resume`` a
    training that ended early goes on as if it hadn't. It ends after ``epochs``, or ``patience`` epochs without a better loss on ``valid``.
    Rows without a label are left out; missing features count as 0.
    """
    spark, s = train.sparkSession, settings
    labels = sorted(r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().collect())
    if not labels:
        raise ValueError("no labelled row to train on")
    filled = F.transform("features", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    number = F.create_map(*(F.lit(v) for k, name in enumerate(labels) for v in (name, k)))
    numbered = lambda df: df.select(key, filled.alias("features"), F.try_element_at(number, F.col(label)).cast("int").alias("y")).where("y is not null")
    train, valid = numbered(train), numbered(valid)
    widest = train.select(F.posexplode("features").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev")).orderBy("at").collect()
    mean, divisor = np.array([r["mean"] for r in widest]), np.array([r.dev if r.dev >= 1e-6 else 1.0 for r in widest])
    array = lambda a: F.array(*(F.lit(float(v)) for v in a))
    scaled = F.zip_with(F.zip_with("features", array(mean), lambda v, m: v - m), array(divisor), lambda v, d: v / d)
    folder = f"{path.rstrip('/')}-rows/{model}-{uuid.uuid4().hex}"
    dealt = train.select(scaled.alias("features"), "y", F.pmod(F.xxhash64(F.col(key), F.lit(s.seed)), F.lit(s.batches)).cast("int").alias("batch"))
    dealt.write.partitionBy("batch").parquet(f"{folder}/train")
    valid.select(scaled.alias("features"), "y").write.parquet(f"{folder}/valid")
    train, valid = spark.read.schema("features array<double>, y int, batch int").parquet(f"{folder}/train"), spark.read.schema("features array<double>, y int").parquet(f"{folder}/valid")
    by_class = np.array([(class_weights or {}).get(name, 1.0) for name in labels])
    state, history = start(len(mean), len(labels)), []
    running = f"{model}.running"
    if resume and latest(spark, path, running) is not None:
        stored, config = load(spark, path, running)
        if config["settings"] | {"epochs": 0} != asdict(s) | {"epochs": 0} or config["labels"] != labels:
            raise ValueError("the stored training had other settings or labels")
        state, history = State(**{k: stored[k] for k in ("linear", "first", "second", "best")}, **config["state"]), config["history"]
    while state.epoch < s.epochs and state.since < s.patience:
        for batch in epoch_order(s, state.epoch):
            total = _added(train.where(F.col("batch") == batch), state.linear, by_class, s)
            if total[-2]:
                state = moved(state, total[:-4].reshape(state.linear.shape) / total[-3], s)
        total = _added(valid, state.linear, by_class, s)
        loss = total[-4] / total[-3] if total[-3] else 0.0
        state = judged(state, loss)
        history.append({"epoch": state.epoch, "loss": loss, "accuracy": total[-1] / total[-2] if total[-2] else 0.0})
        numbers = {"steps": state.steps, "epoch": state.epoch, "best_loss": state.best_loss, "since": state.since}
        save(spark, path, running, {k: getattr(state, k) for k in ("linear", "first", "second", "best")}, {"state": numbers, "settings": asdict(s), "labels": labels, "history": history})
    weights = {"linear": state.best, "mean": mean, "divisor": divisor}
    save(spark, path, model, weights, {"labels": labels, "settings": asdict(s), "history": history})
    return Classifier(labels, weights, history)


# --- sequence model
def sequence_weights(series: list[int], statistics: int, classes: int, local: int = 64, wide: int = 128, layers: int = 2, seed: int = 42) -> Weights:
    """Weights of a sequence model drawn from a seed: a local recurrent layer for each series, global ones over the parts, attention, two dense layers."""
    draw, out = np.random.default_rng(seed), {}

    def recurrent(name: str, width: int, size: int):
        for way in ("forward", "backward"):
            for part, inputs in (("input", width), ("back", size)):
                out[f"{name}.{way}.{part}"] = draw.uniform(-1, 1, (4 * size, inputs)) / math.sqrt(size)
            out[f"{name}.{way}.shift"] = np.zeros(4 * size)

    for k, width in enumerate(series):
        recurrent(f"local{k}", width, local)
    for k in range(layers):
        recurrent(f"global{k}", 2 * local * len(series) if k == 0 else 2 * wide, wide)
    out["attention"] = draw.uniform(-1, 1, (2 * wide + 1, 1)) / math.sqrt(2 * wide)
    out["hidden"] = draw.uniform(-1, 1, (2 * wide + statistics + 1, wide)) / math.sqrt(2 * wide + statistics)
    out["out"] = draw.uniform(-1, 1, (wide + 1, classes)) / math.sqrt(wide)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def recurrent(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    """(rows, time, 2 * size): a long short-term memory read in both directions, all rows at once."""
    ways = []
    for way in ("forward", "backward"):
        into, back, shift = (weights[f"{name}.{way}.{p}"] for p in ("input", "back", "shift"))
        size = back.shape[1]
        # All inputs at once; only what comes from the step before is one after the other.
        ahead = x @ into.T + shift
        h = c = np.zeros((len(x), size))
        steps = np.empty((len(x), x.shape[1], size))
        for t in range(x.shape[1]) if way == "forward" else reversed(range(x.shape[1])):
            gate = ahead[:, t] + h @ back.T
            let, keep, new, show = (gate[:, k * size : (k + 1) * size] for k in range(4))
            c = _sigmoid(keep) * c + _sigmoid(let) * np.tanh(new)
            h = _sigmoid(show) * np.tanh(c)
            steps[:, t] = h
        ways.append(steps)
    return np.concatenate(ways, axis=2)


def represented(series: list[np.ndarray], weights: Weights, parts: int = 5) -> np.ndarray:
    """(rows, 2 * wide): each series is cut into parts, the last of which has the rest; a part is its local layer's last step; the global layers read the parts, attention sums them up."""
    time = series[0].shape[1]
    size = max(1, time // parts)
    local = []
    for k, x in enumerate(series):
        cuts = [x[:, p * size : (p + 1) * size if p < parts - 1 else time] for p in range(parts)]
        local.append(np.stack([recurrent(cut, weights, f"local{k}")[:, -1] for cut in cuts], axis=1))
    whole = np.concatenate(local, axis=2)
    for k in range(sum(n.startswith("global") and n.endswith(".forward.input") for n in weights)):
        whole = recurrent(whole, weights, f"global{k}")
    score = whole @ weights["attention"][:-1] + weights["attention"][-1]
    share = np.exp(score - score.max(axis=1, keepdims=True))
    return (share / share.sum(axis=1, keepdims=True) * whole).sum(axis=1)


def logits(series: list[np.ndarray], statistics: np.ndarray | None, weights: Weights, parts: int = 5) -> np.ndarray:
    rows = represented(series, weights, parts)
    rows = rows if statistics is None else np.hstack((rows, statistics))
    return with_one(np.maximum(with_one(rows) @ weights["hidden"], 0)) @ weights["out"]


def _cube(column: pa.Array) -> np.ndarray:
    """(rows, time, features) of an array<array<double>> whose rows are equally long; nulls are 0."""
    inner = column.flatten()
    flat = np.nan_to_num(inner.flatten().to_numpy(zero_copy_only=False).astype(float))
    time = len(inner) // len(column)
    return flat.reshape(len(column), time, len(flat) // len(inner))


def apply_sequence(rows: DataFrame, key: str, series: list[str], weights: Weights, statistics: str | None = None, parts: int = 5, step: int = 512, features: bool = False) -> DataFrame:
    """(key, probabilities), or (key, features) of the layer before the dense ones with the statistics behind it.

    series: names of columns array<array<double>> (time, features), equally long in all rows; rows are
    taken ``step`` at a time, so memory doesn't grow with a task. Raises if the columns aren't as wide as the weights say.
    """
    kind, name = rows.schema[key].dataType.simpleString(), "features" if features else "probabilities"
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                cubes = [_cube(batch.column(k + 1)) for k in range(len(series))]
                still = np.nan_to_num(batch.column(len(series) + 1).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(batch.num_rows, -1) if statistics else None
                check_widths(shared.value, **{f"series{k}": c.shape[2] for k, c in enumerate(cubes)}, **({"statistics": 0 if still is None else still.shape[1]} if not features else {}))
                if features:
                    out = represented(cubes, shared.value, parts)
                    out = out if still is None else np.hstack((out, still))
                else:
                    out = softmax(logits(cubes, still, shared.value, parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], [key, name])

    return rows.select(key, *series, *([statistics] if statistics else [])).mapInArrow(run, f"{key} {kind}, {name} array<double>")

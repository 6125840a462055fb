"""Store, trainer and sequence model against plain NumPy and plain loops."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators import models

NAMES = ["Bike", "Bus", "Walk"]


def points(n, seed, width=5):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 3, n)
    x = draw.normal(0, 1, (n, width)) + 2.5 * np.eye(3, width)[y]
    x[:, -1] = 7.0  # no spread
    return x, y


def table(spark, x, y, first=0):
    rows = [(f"k{first + i}", NAMES[b], [float(v) for v in a], 3) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key string, label string, features array<double>, y int").repartition(5)


def dense(spark, x, y, vx, vy, s, by_class):
    """The same training by plain arrays, rows dealt as Spark's hash deals them."""
    keys = spark.createDataFrame([(i, f"k{i}") for i in range(len(x))], "i int, key string").select("i", F.pmod(F.xxhash64("key", F.lit(s.seed)), F.lit(s.batches)).alias("b"))
    batch = np.array([r.b for r in sorted(keys.collect())])
    mean, dev = x.mean(0), x.std(0)
    dev[dev < 1e-6] = 1
    x, vx = (x - mean) / dev, (vx - mean) / dev
    state, losses = models.start(x.shape[1], 3), []
    while state.epoch < s.epochs and state.since < s.patience:
        for b in models.epoch_order(s, state.epoch):
            of = batch == b
            total = models.sums(state.linear, x[of], y[of], by_class, s)
            state = models.moved(state, total[:-4].reshape(state.linear.shape) / total[-3], s)
        total = models.sums(state.linear, vx, vy, by_class, s)
        losses.append(total[-4] / total[-3])
        state = models.judged(state, losses[-1])
    return state.best, losses


@pytest.mark.parametrize("loss", ["cross_entropy", "focal"])
def test_training_equals_a_dense_one_and_goes_on(spark, tmp_path, loss):
    (x, y), (vx, vy), (tx, ty) = points(300, 1), points(80, 2), points(200, 3)
    s, weight = models.Settings(epochs=6, batches=3, loss=loss), {"Bike": 2.0, "Bus": 0.5, "Walk": 0.5}
    best, losses = dense(spark, x, y, vx, vy, s, np.array([2.0, 0.5, 0.5]))
    train, valid = table(spark, x, y), table(spark, vx, vy, 1000)
    model = models.fit(train, valid, "key", f"{tmp_path}/store", "modes", s, class_weights=weight)
    assert np.allclose(model.weights["linear"], best, atol=1e-9) and [h["loss"] for h in model.history] == pytest.approx(losses, abs=1e-9)
    # Ended after two epochs, taken up again.
    models.fit(train, valid, "key", f"{tmp_path}/store", "other", replace(s, epochs=2), class_weights=weight)
    again = models.fit(train, valid, "key", f"{tmp_path}/store", "other", s, class_weights=weight, resume=True)
    assert np.allclose(again.weights["linear"], best, atol=1e-9) and len(again.history) == 6
    with pytest.raises(ValueError, match="other settings"):
        models.fit(train, valid, "key", f"{tmp_path}/store", "other", replace(s, rate=0.1), resume=True)
    # Held out, and read back.
    back = models.restore(spark, f"{tmp_path}/store", "modes")
    guesses = {r.key: r for r in back.predict(table(spark, tx, ty), "key").collect()}
    right = np.mean([guesses[f"k{i}"].pred_label == NAMES[k] for i, k in enumerate(ty)])
    assert right > 0.85 and all(abs(sum(r.probabilities) - 1) < 1e-9 and r.confidence == max(r.probabilities) for r in guesses.values())
    assert models.latest(spark, f"{tmp_path}/store", "other") == 2


def test_gradients_by_differences():
    (x, y), by_class = points(20, 5), np.array([1.0, 2.0, 0.3])
    linear = np.random.default_rng(6).normal(0, 0.3, (6, 3))
    for loss in ("cross_entropy", "focal"):
        s = models.Settings(loss=loss)
        gradient = models.sums(linear, x, y, by_class, s)[:-4].reshape(linear.shape)
        for i, j in np.ndindex(linear.shape):
            step = np.zeros_like(linear)
            step[i, j] = 1e-6
            slope = (models.sums(linear + step, x, y, by_class, s)[-4] - models.sums(linear - step, x, y, by_class, s)[-4]) / 2e-6
            assert gradient[i, j] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_clipping_patience_and_odd_rows(spark, tmp_path):
    state = models.moved(models.start(2, 2), np.full((3, 2), 1e6), models.Settings(clip=1.0))
    assert np.sqrt((state.first**2).sum()) == pytest.approx(0.1)
    x, y = points(40, 7)
    train = table(spark, x, y).withColumn("features", F.when(F.col("key") == "k1", F.array(*(F.lit(None).cast("double") for _ in range(5)))).otherwise(F.col("features")))
    train = train.withColumn("label", F.when(F.col("key") != "k2", F.col("label")))
    model = models.fit(train, table(spark, x[:5], (y[:5] + 1) % 3, 90), "key", f"{tmp_path}/s", "m", models.Settings(epochs=50, patience=3))
    assert len(model.history) < 50
    empty = model.predict(train.limit(0), "key")
    assert empty.columns == ["key", "pred_label", "confidence", "probabilities"] and empty.count() == 0
    with pytest.raises(ValueError, match="no labelled row"):
        models.fit(train.limit(0), train, "key", f"{tmp_path}/s", "none")
    with pytest.raises(Exception, match="the model takes 5"):
        model.predict(train.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))), "key").collect()


def test_store_and_widths(spark, tmp_path):
    path = f"{tmp_path}/store"
    weights = models.sequence_weights([9, 12], 18, 6, 4, 5, 2)
    assert models.widths(weights) == {"series0": 9, "series1": 12, "statistics": 18}
    assert models.save(spark, path, "a", weights, {"k": [1]}) == 1 and models.save(spark, path, "a", {"linear": np.ones((4, 2))}) == 2 and models.save(spark, path, "b", weights) == 1
    back, config = models.load(spark, path, "a", 1)
    assert config == {"k": [1]} and back.keys() == weights.keys() and all(np.array_equal(back[k], weights[k]) and back[k].shape == weights[k].shape for k in weights)
    assert models.widths(models.load(spark, path, "a")[0]) == {"features": 3}
    for wrong in ({"model": "c"}, {"model": "a", "version": 9}):
        with pytest.raises(LookupError):
            models.load(spark, path, **wrong)
    with pytest.raises(LookupError):
        models.load(spark, f"{tmp_path}/nowhere", "a")
    models.check_widths(back, series0=9, series1=12, statistics=18)
    with pytest.raises(ValueError, match="series1: 10 given, the model takes 12"):
        models.check_widths(back, series0=9, series1=10)


def slow_recurrent(x, w, name):
    """One row, one step, one unit at a time."""
    out = []
    for way in ("forward", "backward"):
        into, back, shift = (w[f"{name}.{way}.{p}"] for p in ("input", "back", "shift"))
        size = back.shape[1]
        h, c, steps = [0.0] * size, [0.0] * size, [None] * len(x)
        for t in range(len(x)) if way == "forward" else range(len(x) - 1, -1, -1):
            z = [sum(into[g, d] * x[t][d] for d in range(len(x[t]))) + sum(back[g, j] * h[j] for j in range(size)) + shift[g] for g in range(4 * size)]
            logistic = lambda v: 1 / (1 + math.exp(-v))
            c = [logistic(z[size + j]) * c[j] + logistic(z[j]) * math.tanh(z[2 * size + j]) for j in range(size)]
            h = [logistic(z[3 * size + j]) * math.tanh(c[j]) for j in range(size)]
            steps[t] = h
        out.append(steps)
    return [a + b for a, b in zip(*out)]


def slow_probabilities(series, statistics, w, parts=5):
    time = len(series[0])
    size = max(1, time // parts)
    whole = []
    for p in range(parts):
        row = []
        for k, x in enumerate(series):
            row += slow_recurrent(x[p * size : (p + 1) * size if p < parts - 1 else time], w, f"local{k}")[-1]
        whole.append(row)
    for k in range(2):
        whole = slow_recurrent(whole, w, f"global{k}")
    score = [sum(a * b for a, b in zip(r, w["attention"][:-1, 0])) + w["attention"][-1, 0] for r in whole]
    e = [math.exp(v) for v in score]
    pooled = [sum(v / sum(e) * r[j] for v, r in zip(e, whole)) for j in range(len(whole[0]))] + list(statistics) + [1.0]
    hidden = [max(0.0, sum(a * b for a, b in zip(pooled, w["hidden"][:, j]))) for j in range(w["hidden"].shape[1])] + [1.0]
    z = [sum(a * b for a, b in zip(hidden, w["out"][:, j])) for j in range(w["out"].shape[1])]
    return [math.exp(v) / sum(map(math.exp, z)) for v in z]


def test_sequence_model_step_by_step(spark):
    draw = np.random.default_rng(8)
    w = models.sequence_weights([3, 2], 4, 6, 3, 4, 2)
    for k in w:
        w[k] = w[k] + draw.normal(0, 0.1, w[k].shape)
    rows = [(i, draw.normal(0, 1, (12, 3)).tolist(), draw.normal(0, 1, (12, 2)).tolist(), draw.normal(0, 1, 4).tolist()) for i in range(7)]
    frame = spark.createDataFrame(rows, "id long, a array<array<double>>, b array<array<double>>, still array<double>").repartition(2)
    got = {r.id: r.probabilities for r in models.apply_sequence(frame, "id", ["a", "b"], w, "still", step=3).collect()}
    for i, a, b, still in rows:
        assert got[i] == pytest.approx(slow_probabilities([a, b], still, w), abs=1e-12)
    with pytest.raises(Exception, match="series0: 2 given, the model takes 3"):
        models.apply_sequence(frame, "id", ["b", "a"], w, "still").collect()
    kept = models.apply_sequence(frame, "id", ["a", "b"], w, "still", features=True).collect()
    assert len(kept) == 7 and all(len(r.features) == 8 + 4 for r in kept)
    assert models.apply_sequence(frame.limit(0), "id", ["a", "b"], w, "still").count() == 0


def _calls(monkeypatch, owner, name):
    made, plain = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: made.append(a) or plain(*a, **k))
    return made


def test_statistics_model_makes_no_series(spark, sf_dir, monkeypatch):
    from tramline.operators import resample
    from tramline.plans import queries

    made = _calls(monkeypatch, resample, "resample")
    rows = queries.QUERIES["ml12_softmax_trained"](spark, sf_dir)
    assert rows.count() > 0 and not made


def test_series_go_through_the_recurrent_layers_once(spark, sf_dir, monkeypatch):
    from tramline.plans import fixtures, queries

    fitted, points = _calls(monkeypatch, models, "fit"), _calls(monkeypatch, fixtures, "segment_points")
    assert queries.QUERIES["ml8_ml14_sequence_trained"](spark, sf_dir).count() > 0
    assert len(points) == 1 and len(fitted) == 1
    assert all("MapInArrow" not in df._jdf.queryExecution().executedPlan().toString() for df in fitted[0][:2])

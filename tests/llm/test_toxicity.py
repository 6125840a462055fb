import random

import numpy as np

from tramline.llm import toxicity as tx


def corpus(n=700):
    draw = random.Random(2)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con") for b in ("em", "um", "or", "et", "ctu", "adi")]
    docs, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(draw.randint(1, 3)):
                text.insert(draw.randrange(len(text)), draw.choice(("Vile!", "nasty,", "grumm" + draw.choice("abcdefgh"))))
        docs.append((i, " ".join(text)))
        labels.append((i, 0 if toxic and i % 12 == 0 else 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, severity double")
    known = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(None, 1, 1), (10**6, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = tx.fit(frame, tx.grades_of(known))
    truth = {i: bool(t) for i, _, t in labels}
    rows = tx.score(frame, model).collect()
    held = [(truth[r.doc_id], r.rejected) for r in rows if r.doc_id % 2]
    assert sum(a == b for a, b in held) / len(held) >= 0.98
    assert all(0 <= r.p_toxic <= 1 and r.severity >= r.p_toxic - 1e-9 for r in rows)
    assert list(model.thresholds) == sorted(model.thresholds) and min(model.weights.values()) > 0


def test_edge_rows(spark):
    docs, labels = corpus(200)
    frame = spark.createDataFrame(docs + [(None, "vile"), (500, None), (501, ""), (502, "plain " * 30000), (0, docs[0][1])], "doc_id long, text string")
    model = tx.fit(frame, tx.grades_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    rows = tx.score(frame, model)
    assert rows.count() == 205
    assert not any(r.rejected for r in rows.where("doc_id >= 500").collect())


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = tx.fit(docs, none)
    assert [r.rejected for r in tx.score(docs, model).collect()] == [False]
    assert tx.score(docs.limit(0), model).count() == 0


def test_a_grade_without_labels_gets_a_threshold():
    rows = [np.array([0]), np.array([1]), np.array([0]), np.array([], int)] * 10
    weights, cuts = tx.fit_ordinal(rows, np.array([2, 0, 2, 0] * 10), 2, 4)
    assert np.isfinite(cuts).all() and (np.diff(cuts) >= 0).all() and weights[0] > weights[1] == 0


def loss_of(dense, grades, weights, cuts, penalty):
    """Mean log loss, half a text of score 0 on either side of each threshold, and the penalty."""
    ends = np.concatenate(([-np.inf], cuts, [np.inf]))
    low = 1 / (1 + np.exp(-(ends[None, :] - (dense @ weights)[:, None])))
    share = low[np.arange(len(grades)), grades + 1] - low[np.arange(len(grades)), grades]
    return -np.log(np.maximum(share, 1e-300)).mean() + penalty * weights.sum()


def test_fit_against_a_dense_optimiser():
    draw = np.random.default_rng(5)
    dense = (draw.random((400, 12)) < 0.25).astype(float)
    score = dense @ np.array([2.0, 1.5, 1.0, 0.5, *[0.0] * 8]) + draw.logistic(size=400)
    grades = (score > 1.0).astype(int) + (score > 2.5)
    rows = [np.flatnonzero(r) for r in dense]
    weights, cuts = tx.fit_ordinal(rows, grades, 12, 3, penalty=0.01, steps=2000)
    # Coordinate search from another start: no step of any size makes the loss less.
    best, x = np.inf, np.concatenate((np.full(12, 0.3), [0.0, 1.0]))
    step = 0.5
    while step > 1e-5:
        moved = False
        for k in range(14):
            for d in (step, -step):
                y = x.copy()
                y[k] = max(y[k] + d, 0) if k < 12 else y[k] + d
                if y[12] < y[13] and (value := loss_of(dense, grades, y[:12], y[12:], 0.01)) < best - 1e-12:
                    best, x, moved = value, y, True
        step = step if moved else step / 2
    assert loss_of(dense, grades, weights, cuts, 0.01) < best + 2e-3
    assert np.abs(weights - x[:12]).max() < 0.1 and np.abs(cuts - x[12:]).max() < 0.1


def test_score_is_a_plain_sum(spark):
    model = tx.OrdinalModel({"vile": 1.5, "nast~4": 0.25, "nasty": 0.5, "nasti~5": 0.125, "悪い~2": 2.0}, (0.5, 2.0), 1.2)
    texts = [None, "", "vile", "Vile VILE nasty", "nastier", "x" * 500_000 + " vile", "とても悪い言葉", "clean"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        total = sum(model.weights.get(f, 0.0) for f in tx.features(t))
        p = [1 / (1 + np.exp(c - total)) for c in model.thresholds]
        want[i] = (round(sum(p), 9), round(p[0], 9), total > 1.2)
    assert want[3][2] and want[6][2] and not want[4][2]
    assert {r.doc_id: (round(r.severity, 9), round(r.p_toxic, 9), r.rejected) for r in tx.score(frame, model).collect()} == want


def test_query_against_a_plain_version(spark, sf_dir):
    from collections import Counter

    from tramline.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in docs and r.toxic is not None]
    found = {r.doc_id: tx.features(docs[r.doc_id]) for r in labels}
    counts = Counter(f for fs in found.values() for f in fs)
    low, high = max(tx.MIN_TEXTS, tx.MIN_SHARE * len(found)), max(tx.MAX_SHARE * len(found), tx.MIN_TEXTS)
    number = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if low <= n <= high))}
    ids = sorted(found)
    grade = {r.doc_id: (0 if not r.toxic else 2 if r.quality == 0 else 1) for r in labels}
    grades = np.array([grade[i] for i in ids])
    rows = [np.array(sorted(number[f] for f in found[i] if f in number), int) for i in ids]
    weights, cuts = tx.fit_ordinal(rows, grades, len(number), max(2, grades.max() + 1))
    cutoff = tx.best_cut(np.array([weights[r].sum() for r in rows]), grades > 0)
    for r in queries.op6_toxicity(spark, sf_dir).collect():
        score = sum(weights[number[f]] for f in tx.features(docs[r.doc_id]) if f in number)
        assert abs(r.severity - sum(1 / (1 + np.exp(c - score)) for c in cuts)) < 1e-6 and r.rejected == (score > cutoff)

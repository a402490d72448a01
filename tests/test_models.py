"""Calibrated classifiers, folds, kept models, and the health of vectors, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import health, models


def _data(n=240, d=5, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, d)) * 1.2
    y = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    return centres[y] + rng.normal(size=(n, d)), y


def _frame(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(f) for f in v]) for i, (v, c) in enumerate(zip(x, y, strict=True))], "vec_id long, label int, embedding array<double>")


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = _data()
    df = _frame(spark, x, y).unionByName(spark.createDataFrame([(900, None, [0.0] * 5), (901, 1, None)], "vec_id long, label int, embedding array<double>"))
    return x, y, df, models.calibrated_svc(df, "label")


def test_machines_and_sigmoids_are_at_their_best(spark, fitted):
    """The losses of all machines and sigmoids have no slope left, by a plain count over the rows."""
    x, y, df, model = fitted
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    costs = len(y) / (3 * np.bincount(y))
    hold = np.array([1.0] * 5 + [1e-8])

    def slope(w, value, rows):
        t = np.where(y[rows] == value, 1.0, -1.0)
        short = np.maximum(1 - t * (z[rows] @ w), 0)
        return hold * w - 2 * (costs[y[rows]] * t * short) @ z[rows]

    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    for c in range(3):
        assert np.abs(slope(model.weights[c], c, slice(None))).max() < 1e-3
    fold = {r.vec_id: r.fold for r in models.folds(df.where("label is not null and embedding is not null"), "label", 3, "svc", "vec_id").collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    seen = np.empty((len(y), 3))
    for k in range(3):
        rows = fold != k
        for c in range(3):  # plain Newton on the rows of the other folds
            w = np.zeros(6)
            for _ in range(60):
                t = np.where(y[rows] == c, 1.0, -1.0)
                at = 1 - t * (z[rows] @ w) > 0
                h = np.diag(hold) + 2 * (z[rows][at].T * costs[y[rows]][at]) @ z[rows][at]
                w = w - 0.5 * np.linalg.solve(h, slope(w, c, rows))
            seen[fold == k, c] = z[fold == k] @ w
    for c in range(3):
        n = (y == c).sum()
        t = np.where(y == c, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
        r = 1 / (1 + np.exp(-(seen[:, c] * model.slopes[c] + model.offsets[c]))) - t
        assert abs((r * seen[:, c]).sum()) < 1e-2 and abs(r.sum()) < 1e-2


def test_probabilities(spark, fitted):
    _, _, df, model = fitted
    xt, yt = _data(400, seed=8)
    x, y, _, _ = fitted
    out = model.predict(df)
    row = out.where("vec_id = 901").first()
    assert row.probabilities is None and row.prediction is None
    rows = out.where("embedding is not null").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.prediction == int(np.argmax(r.probabilities)) for r in rows)
    known = out.where("label is not null and embedding is not null")
    assert models.accuracy(known, "label") > 0.7
    bins = models.calibration(known, "label", model.classes).collect()
    assert sum(b.n for b in bins) == len(y) and sum(b.n * abs(b.confidence - b.accuracy) for b in bins) / len(y) < 0.15


def test_noise_gets_no_confidence(spark):
    """Labels that vectors say nothing about get about their own share."""
    rng = np.random.default_rng(0)
    df = _frame(spark, rng.normal(size=(300, 4)), rng.integers(0, 2, 300))
    top = models.calibrated_svc(df, "label").predict(df).agg(F.avg(F.array_max("probabilities"))).first()[0]
    assert 0.5 <= top < 0.62


def test_folds_within_classes(spark):
    df = spark.createDataFrame([(i, "a" if i % 7 else None) for i in range(70)] + [(100, "one")], "id long, label string")
    out = models.folds(df, "label", 5, "s", "id")
    sizes = {(r.label, r.fold): r["count"] for r in out.groupBy("label", "fold").count().collect()}
    assert all(sizes["a", k] == 12 and sizes[None, k] == 2 for k in range(5)) and sum(k == ("one", f) for k in sizes for f in range(5)) == 1


def test_metrics_a_fold(spark):
    rows = [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "c", "a"), (1, "a", "a")]
    got = {r.fold: tuple(r)[1:] for r in models.fold_metrics(spark.createDataFrame(rows, "fold int, l string, prediction string"), "l").collect()}
    f1 = {"a": 0.5, "b": 2 / 3, "c": 0.0}
    assert got == {0: (4, 0.5, round(sum(f1.values()) / 3, 6), round((2 * f1["a"] + f1["b"]) / 4, 6)), 1: (1, 1.0, 1.0, 1.0)}


def test_a_model_is_kept_and_checked(spark, fitted, tmp_path):
    _, _, df, model = fitted
    root, known = f"file:{tmp_path}/m", df.where("label is not null and embedding is not null")
    now = models.accuracy(model.predict(known), "label")
    models.save(spark, root, model, {"accuracy": now})
    other = spark.newSession()
    again, metrics = models.load(other, root)
    assert metrics == {"accuracy": now} and all(np.array_equal(getattr(again, n), getattr(model, n)) for n in ("mean", "scale", "weights", "slopes", "offsets"))
    assert models.gate(spark, root, known, "label") == ("exact", now, now)
    models.save(spark, root, model, {"accuracy": now + 0.005})
    assert models.gate(spark, root, known, "label")[0] == "acceptable"
    models.save(spark, root, model, {"accuracy": now - 0.2})
    assert models.gate(spark, root, known, "label")[0] == "degraded" and models.load(spark, root, 1)[1]["accuracy"] == now


def test_spectrum_and_pairs(spark):
    x, y = _data(150, 6)
    df = _frame(spark, x, y).repartition(5).unionByName(spark.createDataFrame([(999, 1, None)], "vec_id long, label int, embedding array<double>"))
    n, mean, cov = health.covariance(df)
    assert n == 150 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    shares = health.spectrum(df)
    assert np.allclose(shares.sum(), 1) and shares[0] == max(shares)
    assert health.dimensions_for(np.array([0.5, 0.4, 0.06, 0.04]), 0.9) == 2 and health.dimensions_for(np.array([0.5, 0.4, 0.06, 0.04]), 0.95) == 3
    pairs = health.random_pairs(df.where("vec_id < 149 or vec_id = 999"), "s").collect()
    assert len(pairs) == 74 and len({i for p in pairs for i in (p.a, p.b)}) == 148


def test_spherical_rounds(spark):
    x, y = _data(120, 4)
    seeds = [x[0], x[1], -x[0] * 50, x[0]]  # the last never wins a tie
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.array(seeds) / np.linalg.norm(seeds, axis=1, keepdims=True)
    for _ in range(7):
        own = np.round(u @ c.T, 9).argmax(1)
        c = np.array([(m := u[own == k].sum(0)) / np.linalg.norm(m) if (own == k).any() else c[k] for k in range(4)])
    got, centres = health.spherical_kmeans(_frame(spark, x, y).repartition(4), [s.tolist() for s in seeds], 7)
    assert np.allclose(centres, c) and {r.vec_id: r.cluster for r in got.collect()} == dict(enumerate(np.round(u @ c.T, 9).argmax(1)))


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.range(100).withColumn("odd", F.col("id") % 2)
    assert health.write_counted(df, f"{tmp_path}/a", rows=F.count(F.lit(1)), odd=F.sum("odd")) == {"rows": 100, "odd": 50}
    (tmp_path / "in").mkdir()
    for a, b in ((0, 40), (40, 100)):
        spark.range(a, b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/x")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in/x")
        got = health.counted_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", rows=F.count(F.lit(1)), top=F.max("id"))
        assert {"rows": b - a, "top": b - 1} in got and sum(g["rows"] for g in got) == b - a
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100

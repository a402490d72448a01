"""Classifiers with calibrated probabilities, cross-validation, and fitted models that are kept and checked.

Linear models and sigmoids are fitted by Newton steps on sums over all rows: a
pass over the data gives every model's gradient and curvature, as partial sums a
partition, a second one the loss of each for several lengths of its step. Classes
and folds cost no passes of their own.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ml import class_weights, seeded_order
from quillon.operators.relational import numbered
from quillon.operators.store import discard, written
from quillon.sources import versions

#: Numbers of curvature that a pass sums up at once; more models go in several passes.
PASS = 1 << 24
#: Lengths of a Newton step that are tried; the best counts.
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.01, 0.0])


def folds(df: DataFrame, label: str, k: int, seed: str, id_col: str) -> DataFrame:
    """df with fold, 0 to k-1: the rows of each class are dealt out in seeded order."""
    ranked = numbered(df, [seeded_order(seed, id_col), F.col(id_col)], "__rank", [label])
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def out_of_fold(df: DataFrame, k: int, fit: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Every row of df (with fold) once, as fit(the other folds, its fold) predicts it."""
    out = None
    for i in range(k):
        part = fit(df.where(F.col("fold") != i).drop("fold"), df.where(F.col("fold") == i).drop("fold")).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def fold_metrics(predicted: DataFrame, label: str, prediction: str = "prediction", fold: str = "fold") -> DataFrame:
    """(fold, n, accuracy, f1_macro, f1_weighted), all from one cube of (fold, label, prediction) counts.

    Macro averages go over the classes that occur as a label or a prediction in
    the fold, weighted ones by how many rows have the label. A class without
    hits counts as 0.
    """
    cube = predicted.groupBy(F.col(fold).alias("fold"), F.col(label).cast("string").alias("real"), F.col(prediction).cast("string").alias("said")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("real") == F.col("said"), F.col("n")).otherwise(0)
    sides = cube.select("fold", F.explode(F.array(F.struct(F.col("real").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said_n"), hit.alias("hit")), F.struct(F.col("said").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said_n"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("fold", "s.*")
    per = sides.groupBy("fold", "c").agg(F.sum("support").alias("support"), F.sum("said_n").alias("said_n"), F.sum("hit").alias("hit"))
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("said_n"))
    total = F.sum("support")
    return per.groupBy("fold").agg(total.alias("n"), F.round(F.sum("hit") / total, 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("f1_macro"), F.round(F.sum(f1 * F.col("support")) / total, 6).alias("f1_weighted"))


@dataclass
class CalibratedSVC:
    """One-against-the-rest linear machines on standardised vectors, each with a sigmoid; small, and sent to tasks whole."""

    classes: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # a row a class, the intercept last
    slopes: np.ndarray
    offsets: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return z @ self.weights[:, :-1].T + self.weights[:, -1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = _sigmoid(self.margins(x) * self.slopes + self.offsets)
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / p.shape[1])

    def predict(self, df: DataFrame, embedding: str = "embedding") -> DataFrame:
        """df with probabilities (in the order of classes) and prediction, the likeliest class (ties: the first); null without a vector."""
        model, kind = self, "string" if isinstance(self.classes[0], str) else "long"

        @F.pandas_udf(f"struct<probabilities:array<double>,prediction:{kind}>")
        def run(v: pd.Series) -> pd.DataFrame:
            known = v.notna().to_numpy()
            out, said = [None] * len(v), [None] * len(v)
            if known.any():
                p = model.probabilities(_matrix(v[known]))
                for i, row in zip(np.flatnonzero(known), p, strict=True):
                    out[i], said[i] = row.tolist(), model.classes[int(row.argmax())]
            return pd.DataFrame({"probabilities": out, "prediction": pd.Series(said, dtype="object" if kind == "string" else "Int64")})

        return df.withColumn("__p", run(F.col(embedding))).withColumns({"probabilities": F.col("__p.probabilities"), "prediction": F.when(F.col(embedding).isNotNull(), F.col("__p.prediction"))}).drop("__p")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _summed(rows: DataFrame, names: str, per_batch: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all batches of an array that per_batch gives: partial sums a partition, those in groups, then the few of the groups."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = per_batch(pdf)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()], "shape": [list(total.shape)]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, shape = None, None
        for pdf in batches:
            for s, shape in zip(pdf["s"], pdf["shape"], strict=True):
                part = np.frombuffer(s, np.float64)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()], "shape": [list(shape)]})

    kind = "s binary, shape array<int>"
    sums = rows.select(*names.split()).mapInPandas(partial, kind).repartition(8).mapInPandas(merged, kind).collect()
    parts = sorted((bytes(r["s"]), r["shape"]) for r in sums)  # one order of adding, whatever comes first
    return sum(np.frombuffer(s, np.float64).reshape(shape) for s, shape in parts)


def _newton(rows: DataFrame, targets: list[tuple[object, int | None]], costs: dict, mean: np.ndarray, scale: np.ndarray, c: float, rounds: int) -> np.ndarray:
    """A weight row for each (class, fold left out): squared hinge loss, classes weighted by costs, the intercept not held down."""
    d = len(mean) + 1
    weights = np.zeros((len(targets), d))
    hold = np.append(np.ones(d - 1), 1e-8)
    group = max(1, PASS // (d * d))
    for a in range(0, len(targets), group):
        block, live = targets[a : a + group], list(range(len(targets[a : a + group])))
        for _ in range(rounds):
            now, chosen = weights[a : a + group][live], [block[i] for i in live]

            def step(pdf: pd.DataFrame, now: np.ndarray = now, chosen: list = chosen) -> np.ndarray:
                x = np.hstack([(_matrix(pdf["v"]) - mean) / scale, np.ones((len(pdf), 1))])
                label, fold = pdf["label"].to_numpy(), pdf["fold"].to_numpy()
                cost = np.array([costs[v] for v in label])
                out = np.empty((len(chosen), d + d * d))
                for i, (value, left) in enumerate(chosen):
                    y = np.where(label == value, 1.0, -1.0)
                    short = 1 - y * (x @ now[i])
                    at = (short > 0) & (fold != left if left is not None else True)
                    w = cost[at]
                    out[i, :d] = -2 * (w * y[at] * short[at]) @ x[at]
                    out[i, d:] = (2 * (x[at].T * w) @ x[at]).ravel()
                return out

            sums = _summed(rows, "v label fold", step)
            moves = np.stack([np.linalg.solve(np.diag(hold) + c * g[d:].reshape(d, d), hold * w + c * g[:d]) for w, g in zip(now, sums, strict=True)])
            tried = now[None] - STEPS[:, None, None] * moves[None]

            def losses(pdf: pd.DataFrame, tried: np.ndarray = tried, chosen: list = chosen) -> np.ndarray:
                x = np.hstack([(_matrix(pdf["v"]) - mean) / scale, np.ones((len(pdf), 1))])
                label, fold = pdf["label"].to_numpy(), pdf["fold"].to_numpy()
                cost = np.array([costs[v] for v in label])
                out = np.empty(tried.shape[:2])
                for i, (value, left) in enumerate(chosen):
                    at = fold != left if left is not None else np.ones(len(fold), bool)
                    y = np.where(label[at] == value, 1.0, -1.0)
                    short = np.maximum(1 - y[:, None] * (x[at] @ tried[:, i].T), 0)
                    out[:, i] = (cost[at][:, None] * short**2).sum(axis=0)
                return out

            total = 0.5 * (hold * tried**2).sum(axis=2) + c * _summed(rows, "v label fold", losses)
            best = total.argmin(axis=0)
            weights[np.array([a + j for j in live])] = tried[best, np.arange(len(live))]
            moved = STEPS[best] * np.abs(moves).max(axis=1)
            live = [j for j, m in zip(live, moved, strict=True) if m > 1e-7]
            if not live:
                break
    return weights


def _platt(margins: DataFrame, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Slope and offset of each class's sigmoid over (m: margins of all classes, hit: place of the own class), by Newton steps on sums; targets are drawn in from 0 and 1 by the class sizes."""
    hits = np.zeros(k)
    for r in margins.groupBy("hit").count().collect():
        hits[r["hit"]] = r["count"]
    n = hits.sum()
    high, low = (hits + 1) / (hits + 2), 1 / (n - hits + 2)
    slope, offset = np.zeros(k), np.log((hits + 1) / (n - hits + 1))

    def targets(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(pdf["m"]), np.where(pdf["hit"].to_numpy()[:, None] == np.arange(k)[None, :], high, low)

    for _ in range(rounds):

        def step(pdf: pd.DataFrame, slope: np.ndarray = slope, offset: np.ndarray = offset) -> np.ndarray:
            m, t = targets(pdf)
            p = _sigmoid(m * slope + offset)
            r, w = p - t, p * (1 - p)
            return np.stack([(r * m).sum(0), r.sum(0), (w * m * m).sum(0), (w * m).sum(0), w.sum(0)])

        ga, gb, haa, hab, hbb = _summed(margins, "m hit", step)
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        slopes, offsets = slope - STEPS[:, None] * da, offset - STEPS[:, None] * db

        def losses(pdf: pd.DataFrame, slopes: np.ndarray = slopes, offsets: np.ndarray = offsets) -> np.ndarray:
            m, t = targets(pdf)
            z = m[None] * slopes[:, None] + offsets[:, None]
            return (np.logaddexp(0, z) - t * z).sum(axis=1)

        best = _summed(margins, "m hit", losses).argmin(axis=0)
        slope, offset = slopes[best, np.arange(k)], offsets[best, np.arange(k)]
        if max(np.abs(STEPS[best] * da).max(), np.abs(STEPS[best] * db).max()) < 1e-7:
            break
    return slope, offset


def calibrated_svc(train: DataFrame, label: str, embedding: str = "embedding", id_col: str = "vec_id", k: int = 3, c: float = 1.0, seed: str = "svc", rounds: int = 12) -> CalibratedSVC:
    """Fit on rows with a label and a vector: balanced class weights; sigmoids from margins that models without the row's fold give."""
    known = train.where(F.col(label).isNotNull() & F.col(embedding).isNotNull())
    rows = written(folds(known, label, k, seed, id_col).select(F.col(embedding).alias("v"), F.col(label).alias("label"), "fold"))
    moments = _summed(rows, "v", lambda pdf: np.stack([np.append((x := _matrix(pdf["v"])).sum(0), len(x)), np.append((x * x).sum(0), 0)]))
    n = moments[0, -1]
    mean = moments[0, :-1] / n
    scale = np.sqrt(np.maximum(moments[1, :-1] / n - mean**2, 0))
    scale[scale < 1e-12] = 1
    costs = {r["label"]: r["weight"] for r in class_weights(rows, "label").collect()}
    classes = sorted(costs)
    targets = [(v, left) for left in (*range(k), None) for v in classes]
    weights = _newton(rows, targets, costs, mean, scale, c, rounds).reshape(k + 1, len(classes), -1)
    place = {v: i for i, v in enumerate(classes)}

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.hstack([(_matrix(pdf["v"]) - mean) / scale, np.ones((len(pdf), 1))])
                m = np.einsum("nd,nkd->nk", x, weights[pdf["fold"].to_numpy()])
                yield pd.DataFrame({"m": list(m), "hit": [place[v] for v in pdf["label"]]})

    seen = written(rows.mapInPandas(margins, "m array<double>, hit int"))
    slopes, offsets = _platt(seen, len(classes))
    discard(rows)
    discard(seen)
    return CalibratedSVC(classes, mean, scale, weights[k], slopes, offsets)


def calibration(df: DataFrame, label: str, classes: list, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of rows with probabilities and prediction: how often the predicted class is right where it is given that much; their mean gap, weighted by n, is the calibration error."""
    top = F.array_max("probabilities")
    return df.select(F.least(F.floor(top * bins), F.lit(bins - 1)).cast("int").alias("bin"), top.alias("p"), (F.col("prediction") == F.col(label)).cast("double").alias("hit")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("hit").alias("accuracy"))


def accuracy(df: DataFrame, label: str) -> float:
    return df.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0


def save(spark: SparkSession, root: str, model: CalibratedSVC, metrics: dict[str, float]) -> int:
    """A new state of the model folder: parameters with the fitted preprocessing, and what was measured, published together."""
    kind = "string" if isinstance(model.classes[0], str) else "long"
    row = (model.classes, *(x.tolist() for x in (model.mean, model.scale, model.weights, model.slopes, model.offsets)))
    table = spark.createDataFrame([row], f"classes array<{kind}>, mean array<double>, scale array<double>, weights array<array<double>>, slopes array<double>, offsets array<double>")
    return versions.publish(spark, root, {"model": table, "metrics": spark.createDataFrame(sorted(metrics.items()), "name string, value double")})


def load(spark: SparkSession, root: str, number: int | None = None) -> tuple[CalibratedSVC, dict[str, float]]:
    r = versions.load(spark, root, "model", number).first()
    metrics = {m["name"]: m["value"] for m in versions.load(spark, root, "metrics", number).collect()}
    return CalibratedSVC(list(r["classes"]), *(np.array(r[n]) for n in ("mean", "scale", "weights", "slopes", "offsets"))), metrics


def gate(spark: SparkSession, root: str, df: DataFrame, label: str, exact: float = 1e-6, near: float = 0.01) -> tuple[str, float, float]:
    """(verdict, stored accuracy, accuracy now) of the kept model on df: exact, acceptable or degraded by how far the two are apart."""
    model, metrics = load(spark, root)
    now, was = accuracy(model.predict(df), label), metrics["accuracy"]
    return "exact" if abs(now - was) < exact else "acceptable" if abs(now - was) < near else "degraded", was, now

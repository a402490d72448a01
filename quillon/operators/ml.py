"""Features, splits, centroids, metrics and models."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import tokens
from quillon.operators.relational import numbered


def one_hot(df: DataFrame, column: str, categories: list[str], prefix: str) -> DataFrame:
    """df with a 0/1 byte per category."""
    return df.select("*", *((F.coalesce(F.col(column) == c, F.lit(False))).cast("byte").alias(f"{prefix}__{c}") for c in categories))


def multi_hot(df: DataFrame, column: str, categories: list[str], prefix: str) -> DataFrame:
    """The same for an array column."""
    return df.select("*", *(F.coalesce(F.array_contains(column, c), F.lit(False)).cast("byte").alias(f"{prefix}__{c}") for c in categories))


def weighted_blocks(*blocks: tuple[Column, float]) -> Column:
    """Arrays one after the other, each times its weight."""

    def scaled(block: Column, weight: float) -> Column:
        return F.transform(block, lambda x: x.cast("double") * weight)

    return F.concat(*(scaled(c, w) for c, w in blocks))


def seeded_order(seed: str, id_col: str) -> Column:
    """A random-looking order that any engine can repeat."""
    return F.sha1(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def sample_per_class(df: DataFrame, label: str, n: int, seed: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(label).orderBy(seeded_order(seed, id_col), id_col)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def stratified_split(df: DataFrame, label: str, share: float, seed: str, id_col: str) -> DataFrame:
    """df with part: the first `share` of every class in seeded order is 'train', the rest 'test'."""
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = numbered(df, [seeded_order(seed, id_col), F.col(id_col)], "__rank", [label])
    part = F.when(F.col("__rank") <= F.ceil(F.col("__n") * share), "train").otherwise("test")
    return ranked.join(sizes, F.col(label).eqNullSafe(F.col("__label"))).select(*df.columns, part.alias("part"))


def oversample(df: DataFrame, label: str, seed: str, id_col: str) -> DataFrame:
    """Every class repeated up to the size of the largest: whole copies, then the first rows in seeded order. copy: 0 for originals."""
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n").alias("__max"))  # one row
    ranked = numbered(df, [seeded_order(seed, id_col), F.col(id_col)], "__rank", [label])
    sized = ranked.join(sizes, F.col(label).eqNullSafe(F.col("__label"))).crossJoin(F.broadcast(largest))
    copies = F.ceil((F.col("__max") - F.col("__rank") + 1) / F.col("__n")).cast("int")
    return sized.select(*df.columns, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))


def finetune_rows(df: DataFrame, label: str, text: str, plan: dict, id_col: str, seed: str, mix: str, least: int = 100, most: int = 512, share: float = 0.9) -> DataFrame:
    """df's rows to tune an encoder on, with part: of each class in plan its quota of texts of `least` characters or more, cut at `most` and trimmed; all mixed, the first share to train. Both orders are by hash."""
    rows = df.where((F.char_length(text) >= least) & F.col(label).isin(list(plan)))
    quota = F.create_map(*(F.lit(x) for pair in plan.items() for x in pair))[F.col(label)]
    chosen = numbered(rows, [seeded_order(seed, id_col), F.col(id_col)], "__n", [label]).where(F.col("__n") <= quota)
    mixed = numbered(chosen.select(*df.columns), [seeded_order(mix, id_col), F.col(id_col)], "__m")
    total = mixed.agg(F.count(F.lit(1)).alias("__total"))  # one row
    part = F.when(F.col("__m") <= F.floor(F.col("__total") * share), "train").otherwise("val")
    return mixed.crossJoin(F.broadcast(total)).withColumns({text: F.trim(F.substring(text, 1, most)), "part": part}).select(*df.columns, "part")


def class_weights(df: DataFrame, label: str, leave_out: str | None = None) -> DataFrame:
    """(label, n, weight): N / (K n)."""
    n = df.where(F.col(label).isNotNull() if leave_out is None else (F.col(label) != leave_out)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


def centroids(df: DataFrame, label: str, embedding: str = "embedding") -> DataFrame:
    """(label, centroid): mean vectors, averaged by place with partial sums."""
    by = df.select(label, F.posexplode(embedding).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return by.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def smote(df: DataFrame, label: str, id_col: str, embedding: str, rare: int, times: int = 1, k: int = 5) -> DataFrame:
    """New rows of a rare class between each row and one of its k nearest of that class; deterministic in the ids."""
    from quillon.operators.search import knn

    own = df.where(F.col(label) == rare)
    near = knn(own, own, k, id_col, embedding)
    pick = near.where(F.col("rank") <= times)
    a, b = own.select(F.col(id_col).alias("query_id"), F.col(embedding).alias("x")), own.select(F.col(id_col).alias("id"), F.col(embedding).alias("y"))
    at = F.pmod(F.xxhash64("query_id", "id"), F.lit(1000)) / 1000.0
    mixed = F.zip_with("x", "y", lambda p, q: (p + (q - p) * at).cast("float"))
    return pick.join(a, "query_id").join(b, "id").select(F.lit(rare).alias(label), mixed.alias(embedding))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    table = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = table.agg(pairs("n").alias("ij"))
    rows = table.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("i"), F.sum("n").alias("total"))
    columns = table.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("j"))
    expected = F.col("i") * F.col("j") / (F.col("total") * (F.col("total") - 1) / 2)
    return both.crossJoin(rows).crossJoin(columns).select(F.round((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected), 6).alias("ari"))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) from the confusion matrix."""
    cells = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    real = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    out = real.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    p, r = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.col("hit") / F.col("support")
    return out.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def hash_embed(df: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """df with embedding: signed token hashing, unit length; null for texts without tokens. A stand-in for an encoder."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            out = []
            for toks in pdf["__toks"]:
                v = np.zeros(dims, np.float32)
                for t in toks if toks is not None else ():
                    h = zlib.crc32(t.encode())
                    v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
                n = float(np.sqrt((v * v).sum()))
                out.append((v / n).tolist() if n else None)
            yield pdf.drop(columns="__toks").assign(embedding=out)

    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if f.name not in (text, "embedding")]
    return df.select(*(f.name for f in keep), tokens(F.col(text)).alias("__toks")).mapInPandas(encode, T.StructType([*keep, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def encode_safely(encoder, batch: list[str]) -> list[list[float] | None]:
    """A batch; where it fails, row by row; where a row fails, its first half; else None."""
    try:
        return list(encoder(batch))
    except Exception:  # noqa: BLE001  an encoder may raise anything when memory runs out
        out = []
        for text in batch:
            for part in (text, text[: len(text) // 2]):
                try:
                    out.append(list(encoder([part]))[0])
                    break
                except Exception:  # noqa: BLE001
                    continue
            else:
                out.append(None)
        return out


def encode_with(df: DataFrame, encoder, text: str = "text", batch: int = 128) -> DataFrame:
    """df with embedding from any batch encoder; texts that fail stay without one."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        return pd.Series([v for a in range(0, len(texts), batch) for v in encode_safely(encoder, texts[a : a + batch])])

    return df.withColumn("embedding", run(F.col(text)))


def as_vectors(df: DataFrame, embedding: str = "embedding", out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col(embedding).isNotNull()).withColumn(out, array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))


def pca(df: DataFrame, k: int, embedding: str = "embedding") -> tuple[DataFrame, list[float]]:
    """Rows with pca, the first k centred principal components, and the shares of variance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler

    model = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred"), PCA(k=k, inputCol="centred", outputCol="pca")]).fit(rows := as_vectors(df, embedding))
    return model.transform(rows).drop("features", "centred"), model.stages[-1].explainedVariance.toArray().tolist()


def kmeans(df: DataFrame, k: int, embedding: str = "embedding", seed: int = 42, cosine: bool = True) -> DataFrame:
    """df with cluster_id; -1 without a vector."""
    from pyspark.ml.clustering import KMeans

    rows = as_vectors(df, embedding)
    found = KMeans(k=k, seed=seed, distanceMeasure="cosine" if cosine else "euclidean", featuresCol="features", predictionCol="cluster_id").fit(rows).transform(rows).drop("features")
    return found.unionByName(df.where(F.col(embedding).isNull()).withColumn("cluster_id", F.lit(-1)))


def classify(train: DataFrame, test: DataFrame, label: str, embedding: str = "embedding", kind: str = "logistic") -> DataFrame:
    """test with prediction, from balanced class weights: logistic, svc, bayes, forest, voting or stacking."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier

    weights = class_weights(train, label).select(label, "weight")
    fit, out = as_vectors(train, embedding).join(F.broadcast(weights), label).withColumn("label", F.col(label).cast("double")), as_vectors(test, embedding)
    make = {
        "logistic": lambda: LogisticRegression(weightCol="weight", regParam=0.01),
        "svc": lambda: OneVsRest(classifier=LinearSVC(regParam=0.01)),
        "bayes": lambda: NaiveBayes(modelType="gaussian"),
        "forest": lambda: RandomForestClassifier(weightCol="weight", numTrees=40, seed=42),
    }
    if kind in make:
        return make[kind]().fit(fit).transform(out).select(*test.columns, "prediction")
    bases = ["logistic", "bayes", "forest"]
    if kind == "voting":
        for n in bases:
            out = make[n]().setPredictionCol(f"__{n}").setRawPredictionCol(f"__r{n}").setProbabilityCol(f"__p{n}").fit(fit).transform(out)
        votes = F.array(*(F.col(f"__{n}") for n in bases))
        tally = F.transform(votes, lambda v: F.struct((-F.size(F.filter(votes, lambda w: w == v))).alias("n"), v.alias("v")))
        return out.select(*test.columns, F.array_min(tally)["v"].alias("prediction"))
    # stacking: the last model learns from probabilities for rows that the base models have not seen
    from pyspark.ml.feature import VectorAssembler

    def probabilities(model_rows: DataFrame, rows: DataFrame) -> DataFrame:
        for n in bases[:2]:
            rows = make[n]().setPredictionCol(f"__{n}").setRawPredictionCol(f"__r{n}").setProbabilityCol(f"__p{n}").fit(model_rows).transform(rows)
        return VectorAssembler(inputCols=[f"__p{n}" for n in bases[:2]], outputCol="stacked").transform(rows)

    fold = F.pmod(F.xxhash64(embedding), F.lit(3))
    parts = [probabilities(fit.where(fold != k), fit.where(fold == k)).select("label", "weight", "stacked") for k in range(3)]
    meta = LogisticRegression(featuresCol="stacked", weightCol="weight", regParam=0.01).fit(parts[0].union(parts[1]).union(parts[2]))
    return meta.transform(probabilities(fit, out)).select(*test.columns, "prediction")


def silhouette(df: DataFrame, cluster: str, embedding: str = "embedding") -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(predictionCol=cluster, featuresCol="features", distanceMeasure="cosine").evaluate(as_vectors(df, embedding))

"""How fit a corpus is to learn from: seven dimensions from 0 to 100 and their weighted sum."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ml import seeded_order
from quillon.operators.search import knn

# The weight of each dimension, the steps of volume, the bands.
WEIGHTS = {"coverage": 0.25, "text": 0.20, "balance": 0.15, "metadata": 0.15, "volume": 0.10, "embeddings": 0.10, "cleanliness": 0.05}
VOLUME = ((20_000, 100), (10_000, 85), (5_000, 70), (1_000, 50), (0, 20))
BANDS = ((90, "EXCELENTE"), (75, "BUENO"), (55, "ACEPTABLE"))
#: Classes that balance looks at, passages and neighbours that the similarity is taken of, characters of a short passage.
CLASSES, SAMPLE, NEAR, SHORT = 15, 50, 5, 50


def _share(hits: Column, n: Column) -> Column:
    return F.when(n > 0, 100 * hits / n).otherwise(0.0)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def _repeated(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values occur more than once."""
    known = df.where(F.col(column).isNotNull())
    return known.groupBy(F.xxhash64(column), F.sha2(F.col(column).cast("string"), 256)).count().agg(F.count_if(F.col("count") > 1).alias("n"))


def diagnostic(passages: DataFrame, records: DataFrame, fields: list[str], links: list[DataFrame] = (), seed: str = "diagnostic", id_col: str = "id", text: str = "text", embedding: str = "embedding", label: str = "label", number: str = "number") -> DataFrame:
    """(dimension, weight, score), and global with the weighted sum.

    passages: id, text, embedding; records: text, embedding, label, number and
    the fields whose completeness counts; links: frames whose column `record`
    names the records that have something (a subject, a thesaurus entry).
    """
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    a = passages.agg(F.count(F.lit(1)).alias("n"), F.count(embedding).alias("v"), F.count_if(empty(text)).alias("empty"), F.count_if(F.char_length(text) < SHORT).alias("short"))
    filled = [F.count(c).alias(f"f{i}") for i, c in enumerate(fields)]
    b = records.agg(F.count(F.lit(1)).alias("rn"), F.count(embedding).alias("rv"), F.count_if(empty(text)).alias("rempty"), *filled)
    top = records.where(~empty(label)).groupBy(label).count().orderBy(F.desc("count"), label).limit(CLASSES)
    total = top.agg(F.sum("count").alias("t"), F.count(F.lit(1)).alias("k"))
    p = F.col("count") / F.col("t")
    entropy = top.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("h"), F.max("k").alias("k"))  # total is one row
    sample = passages.where(F.col(embedding).isNotNull()).orderBy(seeded_order(seed, id_col), id_col).limit(SAMPLE)
    alike = knn(passages, sample, NEAR, id_col, embedding).agg(F.avg("sim").alias("sim"))
    linked = [df.agg(F.countDistinct("record").alias(f"l{i}")) for i, df in enumerate(links)]
    one = a.crossJoin(b).crossJoin(entropy).crossJoin(alike).crossJoin(_repeated(records, number).withColumnRenamed("n", "rdup")).crossJoin(_repeated(passages, text).withColumnRenamed("n", "dup"))
    for df in linked:
        one = one.crossJoin(df)  # one row each
    n, rn = F.col("n"), F.col("rn")
    parts = [_share(F.col(f"f{i}"), rn) for i in range(len(fields))] + [_share(F.col(f"l{i}"), rn) for i in range(len(links))]
    volume = F.lit(None)
    for least, score in reversed(VOLUME):
        volume = F.when(rn >= least, float(score)).otherwise(volume)
    scores = {
        "coverage": 0.6 * _share(F.col("v"), n) + 0.4 * _share(F.col("rv"), rn),
        "text": _clamped(100 - 2 * _share(F.col("empty"), n) - 0.5 * _share(F.col("short"), n) - 3 * _share(F.col("rempty"), rn)),
        "balance": F.when(F.col("k") > 1, 100 * F.col("h") / F.log2("k")).otherwise(0.0),
        "metadata": sum(parts[1:], parts[0]) / len(parts),
        "volume": volume,
        "embeddings": F.least(F.lit(100.0), F.coalesce("sim", F.lit(0.0)) * 120),
        "cleanliness": _clamped(100 - 5 * _share(F.col("rdup"), rn) - 2 * _share(F.col("dup"), n)),
    }
    whole = sum((scores[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(k).alias("dimension"), F.lit(w).alias("weight"), scores[k].cast("double").alias("score")) for k, w in WEIGHTS.items()), F.struct(F.lit("global").alias("dimension"), F.lit(1.0).alias("weight"), whole.alias("score")))
    band = F.lit("DEFICIENTE")
    for least, name in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return one.select(F.explode(rows).alias("r")).select("r.dimension", "r.weight", F.round("r.score", 4).alias("score")).withColumn("band", band)

"""Cross-validation, calibrated classifiers, the health of vectors, counters taken while writing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine
from quillon.operators import health as H
from quillon.operators import ml as M
from quillon.operators import models as C
from quillon.operators.store import temporary
from quillon.plans.registry import Tables, query, sim_sql

_FOLDS = "f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY sha1('cv' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings)"


def _by_centroid(train: DataFrame, test: DataFrame) -> DataFrame:
    """test with prediction, the class whose mean vector is nearest; one row a class goes to every task."""
    c = M.centroids(train, "label").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("all"))
    ranked = F.transform("all", lambda x: F.struct((-F.round(cosine(F.col("embedding"), x["centroid"]), 6)).alias("d"), x["label"].alias("label")))
    return test.crossJoin(F.broadcast(c)).select("vec_id", "label", F.array_min(ranked)["label"].alias("prediction"))


@query(
    f"""WITH {_FOLDS}, k AS (SELECT unnest(range(5)) AS k),
x AS (SELECT k, label, pos, avg(x) AS m FROM (SELECT fold, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM f) JOIN k ON fold <> k GROUP BY ALL),
c AS (SELECT k, label, list(m ORDER BY pos) AS cen FROM x GROUP BY ALL),
p AS (SELECT fold, f.label AS real, arg_max(c.label, (round(list_cosine_similarity(f.embedding::DOUBLE[], c.cen), 6), -c.label)) AS said FROM f JOIN c ON k = fold GROUP BY f.vec_id, fold, f.label),
s AS (SELECT fold, c, sum(a) AS support, sum(b) AS said, sum(h) AS hit FROM (SELECT fold, real AS c, 1 AS a, 0 AS b, (real = said)::INT AS h FROM p UNION ALL SELECT fold, said, 0, 1, 0 FROM p) GROUP BY ALL),
m AS (SELECT fold, support, hit, 2 * hit / (support + said) AS f1 FROM s)
SELECT fold::INT AS fold, sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM m GROUP BY fold"""
)
def cross_validation(t: Tables) -> DataFrame:
    """Five folds within classes, each predicted by the centroids of the other four; accuracy and both F1 averages a fold."""
    rows = C.folds(t.embeddings.select("vec_id", "label", "embedding"), "label", 5, "cv", "vec_id")
    return C.fold_metrics(C.out_of_fold(rows, 5, _by_centroid), "label")


@query()
def calibrated_svc(t: Tables) -> DataFrame:
    """Class probabilities for a fifth of the vectors, from the rest."""
    parts = M.stratified_split(t.embeddings.select("vec_id", "label", "embedding"), "label", 0.8, "svc", "vec_id")
    model = C.calibrated_svc(parts.where("part = 'train'"), "label")
    return model.predict(parts.where("part = 'test'")).select("vec_id", "label", "prediction", F.round(F.array_max("probabilities"), 6).alias("confidence"))


_NORM = "SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings"


@query(f"SELECT count(*) AS vectors, count(*) FILTER (WHERE l = 0) AS zeros, round(min(l), 6) AS least, round(avg(l), 6) AS mean, round(max(l), 6) AS greatest, round(stddev_pop(l), 6) AS deviation FROM ({_NORM})")
def embedding_norms(t: Tables) -> DataFrame:
    return H.norms(t.embeddings)


@query(
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY sha1('pairs' || vec_id), vec_id) AS n FROM embeddings), p AS (SELECT {sim_sql('a.embedding', 'b.embedding')} AS sim FROM r a JOIN r b ON a.n % 2 = 1 AND b.n = a.n + 1) "
    "SELECT count(*) AS pairs, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS deviation, min(sim) AS least, max(sim) AS greatest FROM p"
)
def embedding_pairs(t: Tables) -> DataFrame:
    """How alike two vectors are that have nothing to do with each other: all rows paired by hash."""
    sims = H.random_pairs(t.embeddings, "pairs")
    return sims.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.stddev_pop("sim"), 6).alias("deviation"), F.min("sim").alias("least"), F.max("sim").alias("greatest"))


@query()
def embedding_spectrum(t: Tables) -> DataFrame:
    """How many directions hold 90 and 95 % of the variance, and the share of the first."""
    shares = H.spectrum(t.embeddings)
    row = (len(shares), H.dimensions_for(shares, 0.9), H.dimensions_for(shares, 0.95), round(float(shares[0]), 6))
    return t.spark.createDataFrame([row], "dimensions int, for_90 int, for_95 int, first double")


_SEEDS, _ROUNDS = 6, 10


def _rounds_sql() -> str:
    unit = "list_transform({0}, lambda z: z / sqrt(list_dot_product({0}, {0})))"
    own = lambda r: f"(SELECT v.vec_id, v.u, arg_max(c.cluster, (round(list_dot_product(v.u, c.c), 9), -c.cluster)) AS cluster FROM v, c{r} c GROUP BY ALL)"
    steps = [f"v AS MATERIALIZED (SELECT vec_id, {unit.format('embedding::DOUBLE[]')} AS u FROM embeddings)", f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cluster, u AS c FROM v ORDER BY vec_id LIMIT {_SEEDS})"]
    for r in range(_ROUNDS):
        steps.append(f"s{r} AS (SELECT cluster, list(x ORDER BY pos) AS s FROM (SELECT cluster, pos, sum(x) AS x FROM (SELECT cluster, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM {own(r)}) GROUP BY ALL) GROUP BY cluster)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, CASE WHEN s IS NULL THEN c.c ELSE {unit.format('s')} END AS c FROM c{r} c LEFT JOIN s{r} USING (cluster))")
    return f"WITH {', '.join(steps)} SELECT vec_id, cluster FROM {own(_ROUNDS)}"


@query(_rounds_sql())
def spherical_kmeans(t: Tables) -> DataFrame:
    """Ten rounds from the first six vectors as centres; every row's cluster."""
    seeds = [r["embedding"] for r in t.embeddings.orderBy("vec_id").limit(_SEEDS).collect()]
    return H.spherical_kmeans(t.embeddings, seeds, _ROUNDS)[0]


@query("SELECT count(*) AS rows, count(DISTINCT lang) AS langs, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE length(text) < 50) AS short FROM documents")
def observed_counts(t: Tables) -> DataFrame:
    """Counters of a table taken while it is written."""
    got = H.write_counted(t.documents.select("doc_id", "lang", "text"), temporary(t.spark, "counted"), rows=F.count(F.lit(1)), langs=F.size(F.collect_set("lang")).cast("long"), chars=F.sum(F.char_length("text")).cast("long"), short=F.count_if(F.char_length("text") < 50))
    return t.spark.createDataFrame([tuple(got[n] for n in ("rows", "langs", "chars", "short"))], "rows long, langs long, chars long, short long")


@query(
    f"""WITH p AS (SELECT doc_id AS id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS text, e.embedding, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS label, 'N' || c_custkey % 500 AS number, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS court FROM customer LEFT JOIN embeddings e ON vec_id = c_custkey),
a AS (SELECT count(*) AS n, count(embedding) AS v, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty, count(*) FILTER (WHERE length(text) < 50) AS short FROM p),
b AS (SELECT count(*) AS rn, count(embedding) AS rv, count(*) FILTER (WHERE text IS NULL) AS rempty, count(label) AS f0, count(court) AS f1 FROM r),
t AS (SELECT label, count(*) AS c FROM r WHERE label IS NOT NULL GROUP BY label ORDER BY c DESC, label LIMIT 15),
h AS (SELECT -sum(c / s * log2(c / s)) / log2(count(*)) * 100 AS h FROM t, (SELECT sum(c) AS s FROM t)),
q AS (SELECT id, embedding FROM p WHERE embedding IS NOT NULL ORDER BY sha1('diagnostic' || id), id LIMIT 50),
k AS (SELECT {sim_sql('q.embedding', 'p.embedding')} AS sim FROM q JOIN p ON p.id <> q.id AND p.embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY sim DESC, p.id) <= 5),
d AS (SELECT (SELECT count(*) FROM (SELECT number FROM r GROUP BY 1 HAVING count(*) > 1)) AS rdup, (SELECT count(*) FROM (SELECT text FROM p WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS dup, (SELECT count(DISTINCT o_custkey) FROM orders) AS l0, (SELECT avg(sim) FROM k) AS sim),
s AS (SELECT 100 * (0.6 * v / n + 0.4 * rv / rn) AS coverage, greatest(0, least(100, 100 - 200 * empty / n - 50 * short / n - 300 * rempty / rn)) AS text, h AS balance, 100 * (f0 / rn + f1 / rn + l0 / rn) / 3 AS metadata,
  CASE WHEN rn >= 20000 THEN 100 WHEN rn >= 10000 THEN 85 WHEN rn >= 5000 THEN 70 WHEN rn >= 1000 THEN 50 ELSE 20 END AS volume, least(100, 120 * sim) AS embeddings, greatest(0, least(100, 100 - 500 * rdup / rn - 200 * dup / n)) AS cleanliness FROM a, b, h, d),
u AS (SELECT unnest(['coverage', 'text', 'balance', 'metadata', 'volume', 'embeddings', 'cleanliness', 'global']) AS dimension, unnest([0.25, 0.20, 0.15, 0.15, 0.10, 0.10, 0.05, 1.0])::DOUBLE AS weight,
  unnest([coverage, text, balance, metadata, volume, embeddings, cleanliness, 0.25 * coverage + 0.2 * text + 0.15 * balance + 0.15 * metadata + 0.1 * volume + 0.1 * embeddings + 0.05 * cleanliness])::DOUBLE AS x FROM s)
SELECT dimension, weight, round(x, 4) AS score, CASE WHEN round(x, 4) >= 90 THEN 'EXCELENTE' WHEN round(x, 4) >= 75 THEN 'BUENO' WHEN round(x, 4) >= 55 THEN 'ACEPTABLE' ELSE 'DEFICIENTE' END AS band FROM u"""
)
def diagnostic(t: Tables) -> DataFrame:
    """Seven dimensions of documents as passages and customers as records."""
    from quillon.operators.diagnostic import diagnostic as seven

    vectors = t.embeddings.select("vec_id", "embedding")
    passages = t.documents.join(vectors, F.col("vec_id") == F.col("doc_id"), "left").select(F.col("doc_id").alias("id"), "text", "embedding")
    c = F.col("c_custkey")
    records = t.customer.join(vectors, F.col("vec_id") == c, "left").select(
        F.when(c % 9 != 0, F.col("c_name")).alias("text"), "embedding", F.when(c % 4 != 0, F.col("c_mktsegment")).alias("label"), F.concat(F.lit("N"), (c % 500).cast("string")).alias("number"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("court")
    )
    return seven(passages, records, ["label", "court"], [t.orders.select(F.col("o_custkey").alias("record"))])


_PLAN = {0: 60, 1: 25, 2: 1000}


@query(
    f"""WITH x AS (SELECT doc_id, substr(text, 1, 512) AS cut, doc_id % 5 AS label FROM documents WHERE length(text) >= 100),
q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('ft' || doc_id), doc_id) AS n FROM x),
k AS (SELECT * FROM q WHERE n <= CASE label {' '.join(f'WHEN {c} THEN {n}' for c, n in _PLAN.items())} ELSE 0 END),
o AS (SELECT *, row_number() OVER (ORDER BY sha1('mix' || doc_id), doc_id) AS m, count(*) OVER () AS total FROM k)
SELECT doc_id, label::INT AS label, sha1(trim(cut)) AS h, CASE WHEN m <= floor(total * 0.9) THEN 'train' ELSE 'val' END AS part FROM o"""
)
def finetune_rows(t: Tables) -> DataFrame:
    """Texts for tuning an encoder: a quota a class, cut, mixed, nine tenths to train."""
    rows = t.documents.select("doc_id", "text", (F.col("doc_id") % 5).cast("int").alias("label"))
    out = M.finetune_rows(rows, "label", "text", _PLAN, "doc_id", "ft", "mix")
    return out.select("doc_id", "label", F.sha1("text").alias("h"), "part")


@query("SELECT doc_id, length(text) AS chars, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE 'new' END AS origin FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0 UNION ALL SELECT doc_id, -1, 'old' FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 1")
def feature_upsert(t: Tables) -> DataFrame:
    """Features of a corpus brought up to date: what is computed again replaces what is there, new rows are added, others stay."""
    from quillon.operators.relational import upsert_replace
    from quillon.plans.pipelines import ml_features

    d = t.documents.select("doc_id", "text")
    now = ml_features(d.where("doc_id % 3 != 1 or doc_id % 2 = 0"))
    origin = F.when(F.col("doc_id") % 3 == 0, "kept").otherwise("new")
    fresh = now.select("doc_id", F.col("char_count").cast("long").alias("chars"), origin.alias("origin"))
    old = t.documents.where("doc_id % 3 in (0, 1)").select("doc_id", F.lit(-1).cast("long").alias("chars"), F.lit("old").alias("origin"))
    return upsert_replace(old, fresh, ["doc_id"], [F.desc("chars")])


@query(
    """WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, own, other, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT vec_id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM s"""
)
def silhouette(t: Tables) -> DataFrame:
    """How well the labels part the vectors, by cosine distance."""
    return t.spark.createDataFrame([(round(M.silhouette(t.embeddings, "label"), 4),)], "silhouette double")

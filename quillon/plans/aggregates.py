"""Aggregates, audits, windows and samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import is_zero
from quillon.operators import ml as M
from quillon.operators.relational import numbered, top_categories
from quillon.plans.registry import Tables, query


@query("SELECT count(*) AS docs, count(text) AS with_text, sum((length(text) < 50)::INT)::BIGINT AS short, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, sum((lang = 'en')::INT)::BIGINT AS english, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def health_counts(t: Tables) -> DataFrame:
    return t.documents.agg(
        F.count(F.lit(1)).alias("docs"), F.count("text").alias("with_text"), F.count_if(F.char_length("text") < 50).alias("short"), F.countDistinct("source").alias("sources"),
        F.countDistinct("lang").alias("langs"), F.count_if(F.col("lang") == "en").alias("english"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
    )


@query("WITH j AS (SELECT d.*, l.quality, l.toxic, e.embedding FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id) " + " UNION ALL ".join(f"SELECT '{c}' AS col, round(avg(({c} IS NOT NULL)::INT), 6) AS ratio, count({c}) AS ok FROM j" for c in ("text", "lang", "source", "quality", "toxic", "embedding")))
def completeness(t: Tables) -> DataFrame:
    """One pass: all ratios in one row, then turned."""
    cols = ["text", "lang", "source", "quality", "toxic", "embedding"]
    joined = t.documents.join(t.labels, "doc_id", "left").join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left")
    one = joined.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in cols))
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("ok")) for c in cols))).alias("x")).select("x.col", F.round(F.col("x.ok") / F.col("n"), 6).alias("ratio"), "x.ok")


@query("SELECT lang, round(avg(length(text)), 6) AS mean, min(length(text)) AS shortest, max(length(text)) AS longest, quantile_cont(length(text), 0.5) AS median FROM documents GROUP BY lang")
def len_stats(t: Tables) -> DataFrame:
    n = F.char_length("text")
    return t.documents.groupBy("lang").agg(F.round(F.avg(n), 6).alias("mean"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.percentile(n, 0.5).alias("median"))


@query("SELECT round(avg(n), 0)::INT AS mean, max(n) AS largest, min(n) AS least, count(*) AS parents FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def chunks_per_parent(t: Tables) -> DataFrame:
    per = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("n"), 0).cast("int").alias("mean"), F.max("n").alias("largest"), F.min("n").alias("least"), F.count(F.lit(1)).alias("parents"))


@query("SELECT count(*) AS dup_groups, coalesce(sum(n), 0)::BIGINT AS dup_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def dup_groups(t: Tables) -> DataFrame:
    groups = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_rows"))


@query("SELECT count(*) - count(DISTINCT text) AS excess FROM documents")
def exact_dup_excess(t: Tables) -> DataFrame:
    return t.documents.agg((F.count(F.lit(1)) - F.countDistinct(F.sha2("text", 256))).alias("excess"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def group_topn(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("n"), "event_type").limit(5)


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def by_year_month(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY l_orderkey")
def agg_array_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def agg_string_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 15), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c) SELECT round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(max(k)), 6) AS balance FROM p")
def label_entropy(t: Tables) -> DataFrame:
    top = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(15)  # fifteen rows
    shares = top.crossJoin(top.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))).withColumn("p", F.col("n") / F.col("total"))
    entropy = -F.sum(F.col("p") * F.log2("p"))
    return shares.agg(F.round(entropy, 6).alias("entropy"), F.round(entropy / F.log2(F.max("k").cast("double")), 6).alias("balance"))


@query("WITH c AS (SELECT lang AS label, count(*) AS n FROM documents WHERE lang <> 'DESCONOCIDO' GROUP BY lang) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(t: Tables) -> DataFrame:
    return M.class_weights(t.documents.withColumnRenamed("lang", "label"), "label", "DESCONOCIDO")


@query(
    "WITH a AS (SELECT count(*) AS n, count(e.embedding) AS v, sum((length(text) >= 50)::INT) AS ok, count(l.quality) AS m, count(DISTINCT text) AS u FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l USING (doc_id)) "
    "SELECT round(100 * (0.4 * v / n + 0.3 * ok / n + 0.2 * m / n + 0.1 * u / n), 4) AS score, CASE WHEN score >= 80 THEN 'alto' WHEN score >= 60 THEN 'medio' ELSE 'bajo' END AS band FROM a"
)
def quality_score(t: Tables) -> DataFrame:
    joined = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").join(t.labels, "doc_id", "left")
    a = joined.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("v"), F.count_if(F.char_length("text") >= 50).alias("ok"), F.count("quality").alias("m"), F.countDistinct(F.sha2("text", 256)).alias("u"))
    score = F.round(100 * (0.4 * F.col("v") / F.col("n") + 0.3 * F.col("ok") / F.col("n") + 0.2 * F.col("m") / F.col("n") + 0.1 * F.col("u") / F.col("n")), 4)
    return a.select(score.alias("score")).withColumn("band", F.when(F.col("score") >= 80, "alto").when(F.col("score") >= 60, "medio").otherwise("bajo"))


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS n, count(*) OVER () AS c FROM events) SELECT value AS p95 FROM r WHERE n = least(floor(c * 0.95)::BIGINT + 1, c)")
def p95_index(t: Tables) -> DataFrame:
    """The value at place int(0.95 n) of the sorted values, by parallel numbering."""
    rows = numbered(t.events.select("value", "event_id"), [F.col("value"), F.col("event_id")], "n")
    size = t.events.agg(F.count(F.lit(1)).alias("c"))
    return rows.join(F.broadcast(size), F.col("n") == F.least(F.floor(F.col("c") * 0.95) + 1, F.col("c"))).select(F.col("value").alias("p95"))


@query("SELECT user_id, count(*) AS n, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, arg_min(event_type, event_id) AS first_type, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def group_fold(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"), F.min_by("event_type", "event_id").alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("WITH s AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) SELECT CASE WHEN source IN (SELECT source FROM s) THEN source ELSE 'OTRO' END AS source_bucket, count(*) AS n FROM documents GROUP BY 1")
def topn_bucket(t: Tables) -> DataFrame:
    return top_categories(t.documents.select("source"), "source", 5, "OTRO").groupBy("source_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('s' || doc_id), doc_id) - 1 AS n FROM documents) SELECT lang, n // 2 AS pair, max(CASE WHEN n % 2 = 0 THEN doc_id END) AS anchor, max(CASE WHEN n % 2 = 1 THEN doc_id END) AS positive FROM r GROUP BY ALL HAVING count(*) = 2")
def pair_rows(t: Tables) -> DataFrame:
    n = numbered(t.documents.select("doc_id", "lang"), [M.seeded_order("s", "doc_id"), F.col("doc_id")], "n", ["lang"]).withColumn("n", F.col("n") - 1)
    own = lambda k: F.max(F.when(F.col("n") % 2 == k, F.col("doc_id")))
    return n.groupBy("lang", F.floor(F.col("n") / 2).alias("pair")).agg(own(0).alias("anchor"), own(1).alias("positive"), F.count(F.lit(1)).alias("c")).where("c = 2").drop("c")


@query("SELECT conv_id, turn // 3 AS triple, max(CASE WHEN turn % 3 = 0 THEN text END) AS ley, max(CASE WHEN turn % 3 = 1 THEN text END) AS articulo, max(CASE WHEN turn % 3 = 2 THEN text END) AS sub FROM conversations GROUP BY ALL HAVING count(*) = 3")
def triples(t: Tables) -> DataFrame:
    own = lambda k: F.max(F.when(F.col("turn") % 3 == k, F.col("text")))
    return t.conversations.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("triple")).agg(own(0).alias("ley"), own(1).alias("articulo"), own(2).alias("sub"), F.count(F.lit(1)).alias("c")).where("c = 3").drop("c")


@query("SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42' || vec_id), vec_id) AS n FROM embeddings) WHERE n <= 10")
def hash_sample_per_class(t: Tables) -> DataFrame:
    return M.sample_per_class(t.embeddings.select("label", "vec_id"), "label", 10, "42", "vec_id")


@query("SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha1('42' || vec_id), vec_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'test' END AS part FROM embeddings")
def strat_split(t: Tables) -> DataFrame:
    return M.stratified_split(t.embeddings.select("vec_id", "label"), "label", 0.8, "42", "vec_id")


_HOLD = "h AS (SELECT doc_id, length(text) AS n FROM documents), k AS (SELECT (count(*) * 0.05)::INT // 2 AS k FROM documents), big AS (SELECT doc_id FROM h ORDER BY n DESC, doc_id LIMIT (SELECT k FROM k))"


@query(f"WITH {_HOLD} SELECT doc_id, 'largest' AS why FROM big UNION ALL SELECT doc_id, 'random' FROM (SELECT doc_id FROM h WHERE doc_id NOT IN (SELECT doc_id FROM big) ORDER BY sha1('42' || doc_id), doc_id LIMIT (SELECT k FROM k))")
def holdout_mix(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.char_length("text").alias("n"))
    k = round(rows.count() * 0.05) // 2
    big = rows.orderBy(F.desc("n"), "doc_id").limit(k).select("doc_id", F.lit("largest").alias("why"))
    rest = rows.join(big, "doc_id", "left_anti").orderBy(M.seeded_order("42", "doc_id"), "doc_id").limit(k)
    return big.unionByName(rest.select("doc_id", F.lit("random").alias("why")))


@query(r"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '^[[:punct:][:space:]]+$')")
def audit_symbol_only(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").rlike(r"^[\p{Punct}\s\x0B]+\z")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, sum((len(list_filter(embedding, lambda x: x <> 0)) = 0)::INT)::BIGINT AS zero FROM embeddings")
def audit_zero_vector(t: Tables) -> DataFrame:
    return t.embeddings.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_zero(F.col("embedding"))).alias("zero"))


@query("SELECT min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days FROM events")
def audit_date_range(t: Tables) -> DataFrame:
    one = t.events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return one.select(F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"), F.datediff(F.to_date("b"), F.to_date("a")).alias("days"))


_EMB = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"


@query(f"WITH {_EMB}, v AS (SELECT pos, var_pop(x) AS v FROM x GROUP BY pos) SELECT round(pow(sum(v), 2) / sum(v * v), 4) AS participation, round(sum(v), 6) AS total_variance FROM v")
def embedding_health(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return v.agg(F.round(F.pow(F.sum("v"), 2) / F.sum(F.col("v") * F.col("v")), 4).alias("participation"), F.round(F.sum("v"), 6).alias("total_variance"))


_CENT = f"{_EMB}, c AS (SELECT label, list(m ORDER BY pos) AS cen FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL) GROUP BY label)"


@query(f"WITH {_CENT} SELECT label, len(cen) AS dims, round(sqrt(list_dot_product(cen, cen)), 6) AS norm, round(cen[1], 6) AS first FROM c")
def class_centroids(t: Tables) -> DataFrame:
    from quillon.functions.vectors import norm

    return M.centroids(t.embeddings, "label").select("label", F.size("centroid").cast("long").alias("dims"), F.round(norm(F.col("centroid")), 6).alias("norm"), F.round(F.col("centroid")[0], 6).alias("first"))


@query(f"WITH {_CENT} SELECT c.label, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.cen)), 6) AS intra, (SELECT round(avg(list_cosine_similarity(c.cen, o.cen)), 6) FROM c o WHERE o.label <> c.label) AS inter FROM c JOIN embeddings e USING (label) GROUP BY c.label, c.cen")
def class_separability(t: Tables) -> DataFrame:
    from quillon.functions.vectors import cosine

    c = M.centroids(t.embeddings, "label")
    intra = t.embeddings.join(c, "label").groupBy("label").agg(F.round(F.avg(cosine(F.col("embedding"), F.col("centroid"))), 6).alias("intra"))
    # one row per class: the pairs are few
    other = c.select(F.col("label").alias("l2"), F.col("centroid").alias("c2"))
    inter = c.join(other, F.col("label") != F.col("l2")).groupBy("label").agg(F.round(F.avg(cosine(F.col("centroid"), F.col("c2"))), 6).alias("inter"))
    return intra.join(inter, "label", "left")


_NEAR = f"{_CENT}, n AS (SELECT e.vec_id, e.label, arg_max(c.label, (round(list_cosine_similarity(e.embedding::DOUBLE[], c.cen), 6), -c.label)) AS predicted FROM embeddings e, c GROUP BY ALL)"


def _nearest(t: Tables) -> DataFrame:
    """Each vector's nearest class centroid: one row per class goes to every task."""
    from quillon.functions.vectors import cosine

    c = M.centroids(t.embeddings, "label").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("all"))
    ranked = F.transform("all", lambda x: F.struct((-F.round(cosine(F.col("embedding"), x["centroid"]), 6)).alias("d"), x["label"].alias("label")))
    return t.embeddings.crossJoin(F.broadcast(c)).select("vec_id", "label", F.array_min(ranked)["label"].alias("predicted"))


@query(f"WITH {_NEAR} SELECT round(avg((label = predicted)::INT), 6) AS accuracy, count(*) AS n FROM n")
def nearest_centroid(t: Tables) -> DataFrame:
    return _nearest(t).agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NEAR} SELECT predicted AS cluster, count(*) AS n FROM n GROUP BY predicted")
def kmeans_assign_step(t: Tables) -> DataFrame:
    return _nearest(t).groupBy(F.col("predicted").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_NEAR}, s AS (SELECT label AS l, count(*) AS support FROM n GROUP BY label), p AS (SELECT predicted AS l, count(*) AS said FROM n GROUP BY 1), h AS (SELECT label AS l, count(*) AS hit FROM n WHERE label = predicted GROUP BY 1), "
    "m AS (SELECT l AS label, support, coalesce(hit / said, 0) AS p, coalesce(hit, 0) / support AS r FROM s LEFT JOIN p USING (l) LEFT JOIN h USING (l)) SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m"
)
def clf_metrics(t: Tables) -> DataFrame:
    return M.classification_metrics(_nearest(t), "label", "predicted")


@query(
    f"WITH {_NEAR}, c2 AS (SELECT label, predicted, count(*)::DOUBLE AS n FROM n GROUP BY ALL), ij AS (SELECT sum(n * (n - 1) / 2) AS ij FROM c2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM (SELECT label, sum(n) AS n FROM c2 GROUP BY 1)), j AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT predicted, sum(n) AS n FROM c2 GROUP BY 1)) "
    "SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari FROM ij, i, j"
)
def ari(t: Tables) -> DataFrame:
    return M.adjusted_rand(_nearest(t), "label", "predicted")


@query("SELECT doc_id, " + ", ".join(f"(lang = '{c}')::TINYINT AS lang__{c}" for c in ("en", "fr", "de", "es")) + " FROM documents")
def one_hot(t: Tables) -> DataFrame:
    return M.one_hot(t.documents.select("doc_id", "lang"), "lang", ["en", "fr", "de", "es"], "lang").drop("lang")


@query("WITH f AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, " + ", ".join(f"list_contains(f, '{c}')::TINYINT AS flag__{c}" for c in "ANR") + " FROM f")
def multi_hot(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return M.multi_hot(flags, "f", ["A", "N", "R"], "flag").drop("f")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, length(text) AS chars, (e.vec_id IS NOT NULL)::INT AS has_embedding FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings e ON vec_id = doc_id")
def feature_matrix(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left").join(t.embeddings.select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return joined.select("doc_id", "quality", "toxic", F.char_length("text").cast("long").alias("chars"), F.col("vec_id").isNotNull().cast("int").alias("has_embedding")).fillna(-1)


@query(
    "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha1('42' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels), m AS (SELECT max(n) AS m FROM r) "
    "SELECT quality, doc_id, copy FROM (SELECT quality, doc_id, unnest(range(0, ceil((m - k + 1) / n)::BIGINT))::INT AS copy FROM r, m)"
)
def oversample(t: Tables) -> DataFrame:
    return M.oversample(t.labels.select("doc_id", "quality"), "quality", "42", "doc_id").select("quality", "doc_id", "copy")


@query("WITH f AS (SELECT user_id, event_id, (value < 20) AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value < 20 ORDER BY event_id) AS run FROM events) SELECT user_id AS \"group\", min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM f WHERE bad GROUP BY user_id, run HAVING count(*) >= 3")
def failure_runs(t: Tables) -> DataFrame:
    from quillon.streaming.jobs import failure_runs as runs

    return runs(t.events.select(F.col("user_id").alias("group"), "event_id", (F.col("value") < 20).alias("bad")), "event_id", "bad", 3)


@query()
def pca(t: Tables) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return M.pca(t.embeddings, 8)[0].select("vec_id", vector_to_array("pca").alias("pca"))


@query()
def kmeans(t: Tables) -> DataFrame:
    return M.kmeans(t.embeddings, 8).select("vec_id", "cluster_id")


@query()
def classifier(t: Tables) -> DataFrame:
    split = M.stratified_split(t.embeddings, "label", 0.8, "42", "vec_id")
    return M.classify(split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part"), "label").select("vec_id", "label", "prediction")


@query()
def smote(t: Tables) -> DataFrame:
    return M.smote(t.embeddings, "label", "vec_id", "embedding", 3)


@query()
def hash_embed(t: Tables) -> DataFrame:
    return M.hash_embed(t.documents.select("doc_id", "text"))


_MARKS = ["licensed", "zzzz", "the"]


@query(" UNION ALL ".join(f"SELECT '{m}' AS section, sum((NOT contains(lower(text), '{m}'))::INT)::BIGINT AS missing, round(100 * avg((NOT contains(lower(text), '{m}'))::INT), 4) AS percent FROM documents" for m in _MARKS))
def audit_missing_sections(t: Tables) -> DataFrame:
    """Texts without each expected section mark, all marks in one pass."""
    low = F.lower("text")
    one = t.documents.agg(F.count("text").alias("n"), *(F.count_if(~F.contains(low, F.lit(m))).alias(m) for m in _MARKS))
    each = one.select("n", F.explode(F.array(*(F.struct(F.lit(m).alias("section"), F.col(m).alias("missing")) for m in _MARKS))).alias("x"))
    return each.select("x.section", "x.missing", F.round(100 * F.col("x.missing") / F.col("n"), 4).alias("percent"))


@query("SELECT vec_id, len(v) AS dims, round(list_sum(v), 5) AS total FROM (SELECT vec_id, list_concat(list_transform(embedding::DOUBLE[], lambda x: 3 * x), [2 * (label = 1)::INT, 2 * (label = 2)::INT]::DOUBLE[]) AS v FROM embeddings)")
def weighted_blocks(t: Tables) -> DataFrame:
    """One feature vector from blocks with weights of their own."""
    hot = F.array(*((F.col("label") == k).cast("double") for k in (1, 2)))
    v = M.weighted_blocks((F.col("embedding"), 3.0), (hot, 2.0))
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))

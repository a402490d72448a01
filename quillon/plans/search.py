"""Retrieval queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.rules import INTENT, intent
from quillon.functions.text import keyword_coverage, latin_fold, lexical_overlap, tokens
from quillon.operators import annindex, textindex
from quillon.operators import search as S
from quillon.operators.relational import first_seen
from quillon.operators.store import temporary
from quillon.plans.registry import Tables, query, sim_sql, tok_sql, vector_of

TERMS = ["the", "and", "that", "tion"]
TERM_SQL = "['and', 'that', 'the', 'tion']"
Q = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"
SIM = sim_sql("e.embedding", "q.v")


def _fragments(t: Tables) -> DataFrame:
    """Passages with a vector: documents and embeddings by id, the query's own left out."""
    return t.documents.join(t.embeddings.where("vec_id != 0"), F.col("doc_id") == F.col("vec_id"))


FRAGMENTS = f"f AS (SELECT d.doc_id, d.source, d.lang, d.text, e.label, {SIM} AS sim FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, q WHERE e.vec_id <> 0)"


@query(f"WITH {Q}, {FRAGMENTS} SELECT source, doc_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, doc_id) AS r FROM f) WHERE r = 1 ORDER BY sim DESC, doc_id LIMIT 10")
def sem_best_per_source(t: Tables) -> DataFrame:
    return S.best_per_parent(_fragments(t), vector_of(t), "source", 10, "doc_id").select("source", "doc_id", "sim")


@query(f"WITH {Q} SELECT e.vec_id, e.label, {SIM} AS sim FROM embeddings e, q WHERE e.vec_id <> 0 ORDER BY sim DESC, e.vec_id LIMIT 20")
def sem_topk(t: Tables) -> DataFrame:
    return S.semantic_topk(t.embeddings.where("vec_id != 0"), vector_of(t), 20, "vec_id").select("vec_id", "label", "sim")


@query(f"WITH {Q}, {FRAGMENTS} SELECT doc_id, source, sim FROM f WHERE lang = 'en' AND NOT starts_with(text, '[OCR-PENDIENTE]') AND length(text) >= 50 ORDER BY sim DESC, doc_id LIMIT 20")
def sem_topk_filtered(t: Tables) -> DataFrame:
    rows = _fragments(t).where((F.col("lang") == "en") & ~F.startswith("text", F.lit("[OCR-PENDIENTE]")) & (F.char_length("text") >= 50))
    return S.semantic_topk(rows, vector_of(t), 20, "doc_id").select("doc_id", "source", "sim")


@query(
    f"WITH {Q}, a AS (SELECT vec_id, {SIM} AS sim, CASE WHEN label % 2 = 0 THEN 'jurisprudencia' ELSE 'leyes' END AS corpus FROM embeddings e, q WHERE vec_id <> 0), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY sim DESC, vec_id) AS r FROM a) SELECT corpus, vec_id, sim FROM b WHERE r <= 10 ORDER BY sim DESC, vec_id, corpus LIMIT 10"
)
def multi_corpus_search(t: Tables) -> DataFrame:
    rows = t.embeddings.where("vec_id != 0")
    return S.multi_corpus({"jurisprudencia": rows.where("label % 2 = 0"), "leyes": rows.where("label % 2 = 1")}, vector_of(t), 10, "vec_id").select("corpus", "vec_id", "sim")


BM25 = f"""WITH p AS (SELECT doc_id, {tok_sql('text')} AS toks FROM documents),
c AS (SELECT doc_id, len(toks) AS dl, {', '.join(f"len(list_filter(toks, lambda z: z = '{x}')) AS t{i}" for i, x in enumerate(sorted(TERMS)))} FROM p),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a, {', '.join(f"sum((t{i} > 0)::INT) AS d{i}" for i in range(4))} FROM c)
SELECT doc_id, round({' + '.join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (1 - 0.75 + 0.75 * dl / a))" for i in range(4))}, 6) AS score
FROM c, s WHERE t0 + t1 + t2 + t3 > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query(BM25)
def bm25_topk(t: Tables) -> DataFrame:
    return S.bm25(t.documents, TERMS, 20, "doc_id")


COVERS = f"""x AS (SELECT doc_id, unnest({tok_sql('text')}) AS tok, generate_subscripts({tok_sql('text')}, 1) - 1 AS pos FROM documents),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM x WHERE list_contains({TERM_SQL}, tok)),
z AS (SELECT doc_id, pos, nth, {', '.join(f"max(CASE WHEN tok = '{x}' THEN pos END) OVER w AS m{i}" for i, x in enumerate(sorted(TERMS)))} FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT doc_id, least(m0, m1, m2, m3) AS a, min(pos) AS b, min(nth) AS nb FROM z WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL GROUP BY ALL),
k AS (SELECT c.doc_id, round(sum(0.1 / (1 + (b - a) - (nb - y.nth))), 6) AS score FROM c JOIN y ON c.doc_id = y.doc_id AND c.a = y.pos GROUP BY c.doc_id)"""


@query(f"WITH {COVERS} SELECT doc_id, score FROM k")
def cover_density(t: Tables) -> DataFrame:
    return S.cover_density(t.documents, TERMS, "doc_id")


@query(
    f"WITH {Q}, {FRAGMENTS}, {COVERS}, n AS (SELECT * FROM f ORDER BY sim DESC, doc_id LIMIT 100), "
    "h AS (SELECT n.source, n.doc_id, sim, round(0.7 * sim + 0.3 * least(1.0, 10 * coalesce(score, 0.0)), 6) AS hybrid FROM n LEFT JOIN k USING (doc_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hybrid DESC, doc_id) AS r FROM h) SELECT source, doc_id, sim, hybrid FROM r WHERE r = 1 ORDER BY hybrid DESC, doc_id LIMIT 10"
)
def hybrid_search(t: Tables) -> DataFrame:
    return S.hybrid(_fragments(t), vector_of(t), TERMS, "source", "doc_id").select("source", "doc_id", "sim", "hybrid")


def _text_index(t: Tables) -> str:
    """An index of all documents, every tenth first with another text and then with its own."""
    root = temporary(t.spark, "texts")
    other = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("the and that tion the "), F.col("text"))).otherwise(F.col("text"))
    textindex.add_texts(root, t.documents.select("doc_id", other.alias("text")))
    textindex.add_texts(root, t.documents.where("doc_id % 10 = 0").select("doc_id", "text"))
    return root


@query(BM25)
def index_bm25(t: Tables) -> DataFrame:
    """bm25_topk from the kept index."""
    return textindex.bm25_search(t.spark, _text_index(t), TERMS, 20)


@query(f"WITH {COVERS} SELECT doc_id, score FROM k")
def index_cover_density(t: Tables) -> DataFrame:
    """cover_density from the kept index."""
    return textindex.cover_search(t.spark, _text_index(t), TERMS)


OVERLAP = f"len(list_intersect({TERM_SQL}, list_distinct({tok_sql('text')}))) / 4.0"


@query(f"SELECT doc_id, round({OVERLAP}, 6) AS overlap FROM documents", name="lexical_overlap")
def lexical_overlap_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(lexical_overlap(TERMS, tokens(F.col("text"))), 6).alias("overlap"))


@query("SELECT item_id, round((contains(lower(text), 'tion')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'zzz')::INT) / 3.0, 6) AS coverage FROM benchmark", name="keyword_coverage")
def keyword_coverage_score(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.round(keyword_coverage(["tion", "the", "zzz"], F.col("text")), 6).alias("coverage"))


RERANK = f"""{Q}, {FRAGMENTS}, p AS (SELECT f.*, l.toxic, l.quality, {OVERLAP} AS o FROM f LEFT JOIN labels l USING (doc_id) ORDER BY sim DESC, doc_id LIMIT 40),
w AS (SELECT *, round(o, 6) AS overlap, round(0.72 * sim + 0.15 * o + 0.08 * coalesce((quality = 1)::INT, 0) + 0.03 * coalesce((toxic = 0)::INT, 0) + 0.02 * (lang = 'en')::INT, 6) AS rerank FROM p)"""


def _reranked(t: Tables) -> DataFrame:
    pool = S.semantic_topk(_fragments(t).join(t.labels, "doc_id", "left"), vector_of(t), 40, "doc_id")
    return S.rerank_features(pool, TERMS, bonuses={"outcome": (F.col("quality") == 1, 0.08), "process": (F.col("toxic") == 0, 0.03), "subject": (F.col("lang") == "en", 0.02)})


@query(f"WITH {RERANK} SELECT doc_id, sim, overlap, rerank FROM w ORDER BY rerank DESC, doc_id LIMIT 20")
def rerank_features(t: Tables) -> DataFrame:
    return _reranked(t).orderBy(F.desc("rerank"), "doc_id").limit(20).select("doc_id", "sim", "overlap", "rerank")


@query(f"WITH {RERANK}, r AS (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) AS before, row_number() OVER (ORDER BY rerank DESC, doc_id) AS after FROM w) SELECT doc_id, before, after, before - after AS shift FROM r")
def rank_shift(t: Tables) -> DataFrame:
    pool = _reranked(t)  # at most 40 rows
    ranked = pool.select("doc_id", F.row_number().over(Window.orderBy(F.desc("sim"), "doc_id")).cast("long").alias("before"), F.row_number().over(Window.orderBy(F.desc("rerank"), "doc_id")).cast("long").alias("after"))
    return ranked.withColumn("shift", F.col("before") - F.col("after"))


@query(f"WITH {Q}, {FRAGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, doc_id) AS r FROM f) SELECT source, doc_id, sim FROM r WHERE r = 1 ORDER BY sim DESC, doc_id LIMIT 8")
def first_seen_dedup(t: Tables) -> DataFrame:
    rows = S.with_similarity(_fragments(t), vector_of(t)).select("source", "doc_id", "sim")
    return first_seen(rows, "source", [F.desc("sim"), F.col("doc_id")], 8)


@query(f"WITH {Q}, {FRAGMENTS}, n AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS n FROM f QUALIFY n <= 5) SELECT string_agg('[Fuente ' || n || '] ' || source || chr(10) || substr(text, 1, 220), chr(10) || chr(10) ORDER BY n) AS context FROM n")
def build_context(t: Tables) -> DataFrame:
    best = S.semantic_topk(_fragments(t), vector_of(t), 5, "doc_id")
    return S.build_context(best, [F.desc("sim"), F.col("doc_id")], "text", "source")


@query(
    f"WITH {Q}, {FRAGMENTS}, n AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS n FROM f QUALIFY n <= 20), "
    "m AS (SELECT lang AS dominant FROM n GROUP BY lang ORDER BY count(*) DESC, min(n) LIMIT 1), s AS (SELECT string_agg('[' || n || '] ' || replace(substr(text, 1, 220), chr(10), ' '), ' ' ORDER BY n) AS snippets FROM n WHERE n <= 3) SELECT dominant, snippets FROM m, s"
)
def synthesize(t: Tables) -> DataFrame:
    best = S.semantic_topk(_fragments(t), vector_of(t), 20, "doc_id").withColumn("n", F.row_number().over(Window.orderBy(F.desc("sim"), "doc_id")))
    mode = best.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first")).orderBy(F.desc("c"), "first").limit(1).select(F.col("lang").alias("dominant"))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.replace(F.substring("text", 1, 220), F.lit("\n"), F.lit(" ")))
    text = best.where("n <= 3").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), " ").alias("snippets"))
    return mode.crossJoin(text)  # one row each


KNN = f"k AS (SELECT a.vec_id AS query_id, a.label AS query_label, b.vec_id AS id, b.label, {sim_sql('a.embedding', 'b.embedding')} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5)"


def _near(t: Tables) -> DataFrame:
    return S.knn(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 5)


@query(f"WITH {KNN} SELECT query_id, id, sim, rank FROM k")
def knn_lateral(t: Tables) -> DataFrame:
    return _near(t).select("query_id", "id", "sim", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {KNN}, m AS (SELECT query_id, query_label, avg(sim) AS s FROM k GROUP BY ALL) SELECT query_label AS label, round(avg(s), 6) AS cohesion, count(*) AS n FROM m GROUP BY query_label")
def knn_cohesion_by_label(t: Tables) -> DataFrame:
    per = _near(t).groupBy("query_id").agg(F.avg("sim").alias("s")).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return per.groupBy("label").agg(F.round(F.avg("s"), 6).alias("cohesion"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {KNN} SELECT query_id, round(avg(sim), 6) AS mean_sim, round(avg((label = query_label)::INT), 6) AS precision_at_5, max((rank = 1 AND label = query_label)::INT) AS hit_at_1 FROM k GROUP BY query_id")
def batch_topk_eval(t: Tables) -> DataFrame:
    labels = t.embeddings.select("vec_id", "label")
    rows = _near(t).join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "query_label"}), "query_id").join(labels.withColumnRenamed("vec_id", "id"), "id")
    same = (F.col("label") == F.col("query_label")).cast("int")
    return rows.groupBy("query_id").agg(F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(F.avg(same), 6).alias("precision_at_5"), F.max(F.when(F.col("rank") == 1, same).otherwise(0)).alias("hit_at_1"))


@query()
def ivf_topk(t: Tables) -> DataFrame:
    return S.ivf_topk(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 5)


@query(f"WITH {KNN}, q AS (SELECT DISTINCT query_id FROM k) SELECT query_id, 5::BIGINT AS found, true AS enough FROM q")
def index_knn(t: Tables) -> DataFrame:
    """Approximate neighbours from the kept index: how many each query got, and whether all queries together reach a recall of 0.9 against exact search."""
    root = temporary(t.spark, "vectors")
    annindex.build(root, t.embeddings)
    queries = t.embeddings.where("vec_id % 100 = 0")
    got = annindex.search(t.spark, root, queries, 5)
    exact = S.knn(t.embeddings, queries, 5).select("query_id", "id", F.lit(1).alias("hit"))
    hits = got.join(exact, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.count("hit").alias("hits"))
    recall = hits.agg((F.sum("hits") / F.sum("found")).alias("recall"))
    return hits.crossJoin(F.broadcast(recall)).select("query_id", "found", (F.col("recall") >= 0.9).alias("enough"))  # recall is one row


_ASKED = "CASE item_id % 5 WHEN 0 THEN 'Acción de nulidad contra el despido' WHEN 1 THEN 'Amparo: ha lugar' WHEN 2 THEN 'recurso de casación por estafa' WHEN 3 THEN 'sin nada' ELSE 'habeas corpus y licitación' END || ' ' || text"


def _facet_sql(hints: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(f, '{phrase}') THEN '{name}'" for name, phrases in hints.items() for phrase in phrases) + " END"


@query(f"SELECT item_id, {', '.join(f'{_facet_sql(h)} AS {k}' for k, h in INTENT.items())} FROM (SELECT item_id, lower(strip_accents({_ASKED})) AS f FROM benchmark)")
def query_intent(t: Tables) -> DataFrame:
    asked = t.benchmark.select("item_id", F.expr(_ASKED).alias("q"))
    return asked.select("item_id", *(c.alias(k) for k, c in intent(F.lower(latin_fold(F.col("q")))).items()))


_BASIS = """t AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3),
b AS (SELECT o_orderkey, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS basis, min(l_partkey) AS first_part FROM t JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)"""


@query(f"WITH {_BASIS} SELECT t.o_orderkey, coalesce(basis, 'sin base') AS basis, p_name AS norm FROM t LEFT JOIN b USING (o_orderkey) LEFT JOIN part ON p_partkey = first_part")
def expert_query(t: Tables) -> DataFrame:
    """The three best judgments, each with its distinct legal bases in one string and the norm looked up for the first of them (the smallest key, so the choice is fixed)."""
    top = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select("o_orderkey")
    links = top.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    basis = links.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "; ").alias("basis"), F.min("l_partkey").alias("first_part"))
    norms = t.part.select(F.col("p_partkey").alias("first_part"), F.col("p_name").alias("norm"))
    return top.join(basis, "o_orderkey", "left").join(norms, "first_part", "left").select("o_orderkey", F.coalesce("basis", F.lit("sin base")).alias("basis"), "norm")


@query(f"WITH {Q}, {FRAGMENTS}, g AS (SELECT source, lang, max(sim) AS s FROM f GROUP BY ALL), m AS (SELECT source, lang, s FROM g ORDER BY s DESC, source, lang LIMIT 3) SELECT m.source, m.lang, f.doc_id, f.sim FROM m JOIN f ON m.source = f.source AND m.lang = f.lang QUALIFY row_number() OVER (PARTITION BY m.source, m.lang ORDER BY f.sim DESC, f.doc_id) <= 2")
def two_level_search(t: Tables) -> DataFrame:
    """Chapters (source and language) by their best passage, then the best passages in each."""
    rows = S.with_similarity(_fragments(t), vector_of(t)).select("source", "lang", "doc_id", "sim")
    chapters = rows.groupBy("source", "lang").agg(F.max("sim").alias("s")).orderBy(F.desc("s"), "source", "lang").limit(3).select("source", "lang")
    w = Window.partitionBy("source", "lang").orderBy(F.desc("sim"), "doc_id")
    return rows.join(F.broadcast(chapters), ["source", "lang"]).withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


_CITING = "CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' Art. ' || doc_id % 30 || ' del Codigo Civil, articulo ' || doc_id % 7 || ' de la Ley' END"
_CITED_SQL = S.CITED.replace("'", "''")


@query(
    f"""WITH {Q}, {FRAGMENTS}, t AS (SELECT doc_id, sim, {_CITING} AS text FROM f ORDER BY sim DESC, doc_id LIMIT 40),
l AS (SELECT l_orderkey AS doc_id, string_agg(DISTINCT p_brand || ' (Art. ' || l_linenumber || ')', ', ' ORDER BY p_brand || ' (Art. ' || l_linenumber || ')') AS basis FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT t.doc_id, sim, coalesce(l.basis, nullif(array_to_string(list_transform(list_zip(regexp_extract_all(text, '{_CITED_SQL}', 1), regexp_extract_all(text, '{_CITED_SQL}', 2)), lambda x: 'Art. ' || x[1] || ' ' || x[2]), ', '), '')) AS basis FROM t LEFT JOIN l USING (doc_id)),
n AS (SELECT *, nullif(regexp_extract(coalesce(basis, ''), 'Art\\.?\\s*(\\d+)', 1), '') AS number FROM b),
a AS (SELECT p_size::VARCHAR AS number, min((p_brand, p_name)) AS m FROM part GROUP BY 1)
SELECT doc_id, sim, basis, m[1] AS norm_law, m[2] AS norm FROM n LEFT JOIN a USING (number)"""
)
def expert_basis(t: Tables) -> DataFrame:
    """The best passages with their legal basis, from links or else from citations in the text, and the norm that it names first."""
    best = S.semantic_topk(_fragments(t), vector_of(t), 40, "doc_id").select("doc_id", "sim", F.expr(_CITING).alias("text"))
    links = t.lineitem.where("l_orderkey % 2 = 0").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("law"), F.col("l_linenumber").alias("article"))
    articles = t.part.select(F.col("p_size").cast("string").alias("number"), F.col("p_brand").alias("law"), F.col("p_name").alias("content"))
    return S.with_norm(S.with_basis(best, links, "doc_id"), articles).select("doc_id", "sim", "basis", "norm_law", "norm")


_WORDS = "CASE vec_id % 3 WHEN 0 THEN ['THE', 'zzz'] WHEN 1 THEN ['ment'] ELSE ['und', 'los'] END"


def _report_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT query_id, round(avg(sim), 6) AS mean_sim, round(100 * avg((len(list_filter(words, lambda w: contains(lower(text), lower(w)))) > 0)::INT), 4) AS relevance
FROM (SELECT a.vec_id AS query_id, {_WORDS.replace('vec_id', 'a.vec_id')} AS words, text, {sim_sql('a.embedding', 'b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id JOIN documents ON doc_id = b.vec_id WHERE a.vec_id % 50 = 7 AND {where}
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 5) GROUP BY query_id)"""


@query(
    f"WITH {_report_sql('x', chr(39) + 'en' + chr(39) + ' = lang')}, {_report_sql('y', 'true')} SELECT query_id, coalesce(x.mean_sim, 0) AS mean_sim_before, coalesce(y.mean_sim, 0) AS mean_sim_after, coalesce(x.relevance, 0) AS relevance_before, coalesce(y.relevance, 0) AS relevance_after, "
    "round(coalesce(y.mean_sim, 0) - coalesce(x.mean_sim, 0), 6) AS mean_sim_delta, round(coalesce(y.relevance, 0) - coalesce(x.relevance, 0), 6) AS relevance_delta FROM x FULL JOIN y USING (query_id)"
)
def retrieval_benchmark(t: Tables) -> DataFrame:
    """Similarity and keyword relevance of the five nearest passages, among English ones before and among all after, and how much each query gained."""
    rows = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"))
    queries = t.embeddings.where("vec_id % 50 = 7")
    keywords = queries.select(F.col("vec_id").alias("query_id"), F.expr(_WORDS.replace("[", "array(").replace("]", ")")).alias("words"))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    reports = [S.retrieval_report(S.knn(part.select("vec_id", "embedding"), queries, 5), texts, keywords) for part in (rows.where("lang = 'en'"), rows)]
    return S.report_deltas(*reports)


@query(f"WITH {Q}, {FRAGMENTS}, p AS (SELECT * FROM f ORDER BY sim DESC, doc_id LIMIT 60), s AS (SELECT doc_id, sim, round((length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1), 6) AS score FROM p) SELECT doc_id, sim, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def rerank_scored(t: Tables) -> DataFrame:
    """A semantic pool ordered anew by a batch scorer, as a cross-encoder would be; this one is the share of one letter."""
    import pandas as pd

    def scorer(texts: pd.Series) -> pd.Series:
        return (texts.str.count("e") / texts.str.len().clip(lower=1)).round(6)

    pool = S.semantic_topk(_fragments(t), vector_of(t), 60, "doc_id")
    return S.rerank(pool, scorer).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "sim", "score")

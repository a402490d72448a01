"""Text functions, extraction, chunking and duplicates over documents and pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import chunking as C
from quillon.functions import extract as X
from quillon.functions import rules as L
from quillon.functions import text as N
from quillon.operators import dedup as D
from quillon.operators.store import written
from quillon.plans.registry import Tables, clean_sql, query, strip_sql, tok_sql

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
sq = SQUEEZE.format


@query(f"SELECT doc_id, sha1({clean_sql('text')}) AS h FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(N.clean_text(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, len({tok_sql('text')}) AS n, len(list_distinct({tok_sql('text')})) AS distinct_n, array_to_string({tok_sql('text')}[1:5], ' ') AS head FROM documents")
def tokenize(t: Tables) -> DataFrame:
    toks = t.documents.select("doc_id", N.tokens(F.col("text")).alias("k"))
    return toks.select("doc_id", F.size("k").cast("long").alias("n"), F.size(F.array_distinct("k")).cast("long").alias("distinct_n"), F.array_join(F.slice("k", 1, 5), " ").alias("head"))


@query("SELECT doc_id, len(list_filter(" + tok_sql("text") + ", lambda z: z NOT IN (" + ", ".join(f"'{w}'" for w in N.STOPWORDS_ES) + "))) AS n FROM documents")
def tokenize_stopwords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(N.tokens(F.col("text"), N.STOPWORDS_ES)).cast("long").alias("n"))


@query("SELECT doc_id, sha1(" + sq(r"regexp_replace(replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), chr(10), ' '), '(?i)^\s*considerando\s*(\([^)]*\))?\s*:\s*que\s*', '')") + ") AS h FROM documents")
def sanitize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(N.sanitize(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, sha1(lower({sq('strip_accents(text)')})) AS h FROM documents")
def accent_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(F.lower(N.squeeze(N.accent_fold(F.col("text"))))).alias("h"))


@query("SELECT doc_id, sha1(" + sq("translate(lower(text), 'áéíóúñ', 'aeioun')") + ") AS h FROM documents")
def scraper_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(N.scraper_key(F.col("text"))).alias("h"))


_MARKED = "'  Página ' || doc_id || ' de 9' || chr(10) || 'Ficha JURISPRUDENCIAL' || chr(10) || chr(10) || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)) || chr(10) || ' '"
_UNMARKED = f"regexp_replace(regexp_replace({_MARKED}, '(?i)p[áa]gina\\s+\\d+\\s+de\\s+\\d+', '', 'g'), '(?i)ficha jurisprudencial', '', 'g')"


@query(f"SELECT doc_id, sha1(regexp_replace(regexp_replace({_UNMARKED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS h, sha1({sq(_UNMARKED)}) AS flat FROM documents")
def clean_full_text(t: Tables) -> DataFrame:
    """Page marks and record titles out of every text, with line breaks kept to two and without them."""
    text = F.expr(_MARKED)
    return t.documents.select("doc_id", F.sha1(N.clean_full_text(text)).alias("h"), F.sha1(N.clean_full_text(text, collapse=True)).alias("flat"))


@query("SELECT page_id, substr(" + sq(r"""regexp_replace(url, '[\\/*?:"<>|\x00-\x1F]', '_', 'g')""") + ", 1, 40) AS name FROM pages")
def safe_filename(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.safe_filename(F.col("url"), 40).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS loose FROM orders")
def parse_dates(t: Tables) -> DataFrame:
    raw = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, "12").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("b"))
    return raw.select("o_orderkey", N.parse_date_text(F.col("a")).alias("iso"), N.parse_date(F.col("a")).alias("day"), N.parse_date_text(F.col("b")).alias("loose"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def file_dates(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Exp_"), F.col("o_orderkey").cast("string"), F.lit("_FRes_"), F.date_format("o_orderdate", "dd_MM_yyyy"), F.lit(".pdf"))
    return t.orders.select("o_orderkey", N.file_date(name).alias("day"))


@query("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, (isodow(ts) - 1)::INT AS weekday, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS days FROM events")
def date_parts(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.weekday("ts").alias("weekday"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, starts_with(url, 'https') AS secure FROM pages")
def url_parts(t: Tables) -> DataFrame:
    repaired = F.regexp_replace("url", "^htt://", "https://")
    return t.pages.select("page_id", F.parse_url(repaired, F.lit("HOST")).alias("host"), F.parse_url(repaired, F.lit("PATH")).alias("path"), F.startswith("url", F.lit("https")).alias("secure"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(r"SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text, chr(10) || chr(9) || chr(13) || ' '), '\s+')) END AS n FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", N.word_count(F.col("text")).cast("long").alias("n"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n FROM documents")
def sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(N.sentences(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT page_id, sha1({sq(strip_sql('html'))}) AS h FROM pages")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha1(N.squeeze(N.strip_html(F.col("html")))).alias("h"))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(X.links(F.col("html"))).alias("link"))


@query("SELECT doc_id, coalesce(list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 8)[1:30], lambda x: NOT regexp_matches(x, '(?i)^La Gaceta|^\\d[\\d\\s]*$'))[1][1:200], '[SIN-NOMBRE]') AS title FROM documents")
def doc_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.document_title(F.col("text")).alias("title"))


_CARD = "'Sentencia S-' || o_orderkey || chr(10) || 'Tipo de proceso:' || chr(10) || o_orderpriority || chr(10) || 'Materia:' || chr(10) || ' Civil  y  Penal ' || chr(10) || 'Fecha de resolución:' || chr(10) || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || 'Fallo:' || chr(10) || 'No ha' || chr(10) || 'lugar'"


def _cards(t: Tables) -> DataFrame:
    text = F.concat(
        F.lit("Sentencia S-"), F.col("o_orderkey").cast("string"), F.lit("\nTipo de proceso:\n"), F.col("o_orderpriority"), F.lit("\nMateria:\n Civil  y  Penal \nFecha de resolución:\n"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nFallo:\nNo ha\nlugar\nHechos relevantes:\nx"),
    )
    return t.orders.select("o_orderkey", text.alias("text"))


@query("SELECT o_orderkey, 'S-' || o_orderkey AS sentencia_id, o_orderpriority AS tipo_proceso, 'Civil y Penal' AS materia, strftime(o_orderdate, '%d/%m/%Y') AS fecha_resolucion, 'No ha lugar' AS fallo FROM orders")
def kv_extract(t: Tables) -> DataFrame:
    got = X.key_values(F.col("text"))
    return _cards(t).select("o_orderkey", *(got[k].alias(k) for k in ("sentencia_id", "tipo_proceso", "materia", "fecha_resolucion", "fallo")))


@query("SELECT doc_id, CASE WHEN a = 0 THEN NULL WHEN b = 0 THEN length(text) - a + 1 WHEN b >= a THEN b - a ELSE 0 END AS n FROM (SELECT doc_id, text, strpos(lower(text), ' the ') AS a, strpos(lower(text), ' and ') AS b FROM documents)")
def section_slice(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.char_length(X.between(F.col("text"), " the ", [" and "])).cast("long").alias("n"))


def _code(t: Tables) -> DataFrame:
    """A statute per nation: two chapters with three articles."""
    n = F.col("n_name")
    return t.nation.select("n_nationkey", F.concat(F.lit("Libro\nCAPÍTULO I\nARTÍCULO 1.- "), n, F.lit(" uno.\nARTÍCULO 2.- Segundo art. 5 de la Ley Penal.\nCAPÍTULO II\nARTÍCULO 3.- "), n, F.lit(" tres.")).alias("text"))


@query("SELECT n_nationkey, unnest(['1', '2', '3']) AS numero, unnest(['ARTÍCULO 1.- ' || n_name || ' uno.', 'ARTÍCULO 2.- Segundo art. 5 de la Ley Penal. CAPÍTULO II', 'ARTÍCULO 3.- ' || n_name || ' tres.']) AS texto FROM nation")
def article_split(t: Tables) -> DataFrame:
    return _code(t).select("n_nationkey", F.explode(X.articles(F.col("text"))).alias("a")).select("n_nationkey", "a.numero", "a.texto")


@query("SELECT n_nationkey, unnest(['CAPÍTULO I', 'CAPÍTULO II']) AS etiqueta, unnest([2, 1])::BIGINT AS n FROM nation")
def chapter_article(t: Tables) -> DataFrame:
    return _code(t).select("n_nationkey", F.explode(X.chapters(F.col("text"))).alias("c")).select("n_nationkey", "c.etiqueta", F.size(X.articles(F.col("c.cuerpo"))).cast("long").alias("n"))


@query("SELECT n_nationkey, '5' AS numero, 'Ley Penal' AS ley FROM nation")
def citations(t: Tables) -> DataFrame:
    return _code(t).select("n_nationkey", F.explode(X.citations(F.col("text"))).alias("c")).select("n_nationkey", "c.*")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '7b' END AS articulo, 'codigo ' || lower(n_name) AS ley FROM nation")
def infer_reference(t: Tables) -> DataFrame:
    law, art = F.concat(F.lit("Codigo "), F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, "Articulo 7b").otherwise("sin")
    return t.nation.select("n_nationkey", X.article_hint(law, art).alias("articulo"), X.law_name(law, art).alias("ley"))


_HEAD = r"""x AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents), h AS (SELECT doc_id, upper(substr(s, 1, 1)) || lower(substr(s, 2)) AS head FROM x WHERE length(s) BETWEEN 3 AND 55 AND NOT ends_with(s, '.') AND NOT ends_with(s, ',') AND NOT regexp_matches(s, '^[\d/\-]+$') AND NOT regexp_matches(s, '(?i)^(Página|Centro Electrónico|De Información|FICHA)')),
p AS (SELECT head, doc_id, count(*) AS n FROM h GROUP BY ALL)"""


@query(f"WITH {_HEAD} SELECT head, count(*) AS docs, sum((n > 1)::INT)::BIGINT AS multiple FROM p GROUP BY head HAVING count(*) >= greatest(1, (SELECT count(*) * 0.01 FROM documents)::INT)")
def header_freq(t: Tables) -> DataFrame:
    per = t.documents.select("doc_id", F.explode(X.header_lines(F.col("text"))).alias("head")).groupBy("head", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = t.documents.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * F.lit(0.01)).cast("int")).alias("least"))
    freq = per.groupBy("head").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > 1).alias("multiple"))
    return freq.crossJoin(F.broadcast(least)).where("docs >= least").drop("least")


_CASES = ["No ha lugar el recurso", "HA LUGAR; se confirma", "Nulidad de actuaciones: nulo", "nada", "con lugar y confirmado"]
_CASE_SQL = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CASES)) + " END"


def _outcomes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.array(*map(F.lit, _CASES))[(F.col("o_orderkey") % 5).cast("int")].alias("fallo"))


def _count_sql(pattern: str) -> str:
    """Matches of a pattern; what a look-behind forbids is counted and taken off."""
    found = lambda p: f"len(regexp_extract_all(s, '{p}'))"
    if pattern.startswith(r"(?<!no )"):
        rest = pattern.removeprefix(r"(?<!no )").removeprefix(r"\b")
        return f"{found(chr(92) + 'b' + rest)} - {found('no ' + rest)}"
    return found(pattern)


_KW_SQL = ", ".join(f"({' + '.join(map(_count_sql, ps))}) AS {k}_count, ({' + '.join(map(_count_sql, ps))} > 0)::INT AS {k}_flag" for k, ps in L.KEYWORDS.items())


@query(
    f"WITH c AS (SELECT o_orderkey, lower(strip_accents(f)) AS s, f FROM (SELECT o_orderkey, {_CASE_SQL} AS f FROM orders)) SELECT o_orderkey, {_KW_SQL}, "
    "length(f) AS texto_char_len, len(regexp_extract_all(f, chr(10))) AS texto_linebreaks, round(len(regexp_extract_all(f, '[A-Z]')) / len(regexp_extract_all(f, '[A-Za-z]')), 6) AS texto_upper_ratio FROM c"
)
def keyword_features(t: Tables) -> DataFrame:
    vector = L.keyword_vector(F.lit(" "), F.col("fallo"))
    whole = lambda k, c: F.round(c, 6) if k == "texto_upper_ratio" else c.cast("int") if k.endswith("_flag") else c.cast("long")
    return _outcomes(t).select("o_orderkey", *(whole(k, c).alias(k) for k, c in vector.items()))


_RULES_SQL = "CASE WHEN coalesce(f, '') = '' THEN 'DESCONOCIDO' " + " ".join(f"WHEN contains(lower(trim(f)), '{p}') THEN '{k}'" for k, ps in L.OUTCOMES.items() for p in ps) + " ELSE 'OTRO' END"
_LONG = sorted(((p, k) for k, ps in L.OUTCOMES.items() for p in ps), key=lambda x: -len(x[0]))
_LONG_SQL = "CASE WHEN coalesce(f, '') = '' THEN 'DESCONOCIDO' " + " ".join(f"WHEN contains(lower(trim(f)), '{p}') THEN '{k}'" for p, k in _LONG) + " ELSE 'OTRO' END"


@query(f"SELECT o_orderkey, {_RULES_SQL} AS faithful, {_LONG_SQL} AS longest FROM (SELECT o_orderkey, {_CASE_SQL} AS f FROM orders)")
def label_rules(t: Tables) -> DataFrame:
    return _outcomes(t).select("o_orderkey", L.first_rule(F.col("fallo")).alias("faithful"), L.first_rule(F.col("fallo"), longest_match=True).alias("longest"))


_SLIDE = r"p AS (SELECT doc_id, text, string_split_regex(trim(text), '\s+') AS w FROM documents)"


@query(
    f"WITH {_SLIDE}, i AS (SELECT doc_id, w, CASE WHEN len(w) <= 300 THEN [0::BIGINT] ELSE range(0, len(w), 250) END AS ix FROM p WHERE length(text) >= 50), "
    "c AS (SELECT doc_id, w, unnest(ix) AS a, generate_subscripts(ix, 1) AS chunk_no FROM i) SELECT doc_id, chunk_no, sha1(array_to_string(w[a + 1:a + 300], ' ')) AS h FROM c"
)
def chunk_sliding(t: Tables) -> DataFrame:
    return C.explode_chunks(t.documents.select("doc_id", "text"), C.sliding_chunks(F.col("text")), "doc_id").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.sha1("chunk").alias("h"))


def _chunks(preset: str):
    def plan(t: Tables) -> DataFrame:
        return C.explode_sentences(t.documents, preset, "text", "doc_id")

    plan.__name__ = f"chunk_sentences_{preset}"
    return plan


for _preset in C.PRESETS:
    query()(_chunks(_preset))
query(name="chunk_sentences")(_chunks("statutes"))

_PREP = f"""k AS (SELECT doc_id, {tok_sql(clean_sql('text'))} AS k FROM documents),
d AS (SELECT doc_id, len(k) AS n, sha1(array_to_string(k, ' ')) AS clean_hash, CASE WHEN len(k) = 0 THEN 'empty' ELSE sha1(array_to_string(k[1:12], '|') || '|...|' || CASE WHEN len(k) > 12 THEN array_to_string(k[greatest(len(k) - 11, 1):], '|') || '|' ELSE '' END || (len(k) // 10)::VARCHAR) END AS near_key,
CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 5 THEN [array_to_string(k, ' ')] ELSE list_distinct(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], ' '))) END AS sh FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY near_key ORDER BY doc_id) AS rn FROM d WHERE n > 0),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))), 6) AS similarity FROM r a JOIN r b ON a.near_key = b.near_key AND a.rn < b.rn WHERE a.rn <= 40 AND b.rn <= 40 AND abs(a.n - b.n) <= 5)"""


@query(f"WITH {_PREP} SELECT doc_id, near_key FROM d")
def near_key(t: Tables) -> DataFrame:
    return D.prepared(t.documents).select("doc_id", "near_key")


@query(f"WITH {_PREP} SELECT doc_id, min(doc_id) OVER (PARTITION BY clean_hash) AS duplicate_of, count(*) OVER (PARTITION BY clean_hash) AS n_copies FROM d")
def exact_dedup(t: Tables) -> DataFrame:
    return D.exact_groups(written(D.prepared(t.documents).select("doc_id", "clean_hash"))).select("doc_id", "duplicate_of", "n_copies")


@query(f"WITH {_PREP} SELECT a, b, similarity FROM e WHERE similarity >= 0.9")
def near_dup_pairs(t: Tables) -> DataFrame:
    return D.near_pairs(written(D.prepared(t.documents)))


@query(f"WITH {_PREP} SELECT d.doc_id, len(d.sh) AS n_shingles, round(CASE WHEN len(d.sh) + len(p.sh) = 0 THEN 1.0 ELSE len(list_intersect(d.sh, p.sh)) / (len(d.sh) + len(p.sh) - len(list_intersect(d.sh, p.sh))) END, 6) AS similarity FROM d JOIN d p ON p.doc_id = d.doc_id + 1")
def shingle_jaccard(t: Tables) -> DataFrame:
    p = written(D.prepared(t.documents))
    nxt = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sh").alias("next"))
    return p.join(nxt, "doc_id").select("doc_id", F.size("sh").cast("long").alias("n_shingles"), F.round(N.jaccard(F.col("sh"), F.col("next")), 6).alias("similarity"))


_PREP_WHOLE = _PREP.replace(" WHERE a.rn <= 40 AND b.rn <= 40 AND ", " WHERE ")  # no limit on a bucket


@query(
    f"WITH RECURSIVE {_PREP_WHOLE}, l AS (SELECT a, b FROM e WHERE similarity >= 0.9 UNION SELECT x.doc_id, y.m FROM d x JOIN (SELECT clean_hash, min(doc_id) AS m FROM d GROUP BY 1) y USING (clean_hash) WHERE x.doc_id <> y.m), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), "
    "w AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT w.node, s.b FROM w JOIN s ON w.reach = s.a) SELECT node AS doc_id, min(reach) AS component FROM w GROUP BY node"
)
def dup_components(t: Tables) -> DataFrame:
    return D.duplicate_components(written(D.prepared(t.documents)))


@query()
def greedy_dedup(t: Tables) -> DataFrame:
    return D.greedy(written(D.prepared(t.documents)))


@query("WITH RECURSIVE s AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.95), w AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT w.node, s.b FROM w JOIN s ON w.reach = s.a) SELECT node AS vec_id, min(reach) AS component FROM w GROUP BY node")
def embedding_dups(t: Tables) -> DataFrame:
    return D.embedding_components(t.embeddings)


@query()
def stream_vectorize(t: Tables) -> DataFrame:
    """Texts embedded by a resumable stream over the table's files, then read back."""
    import uuid

    from quillon.streaming.jobs import vectorize

    spark, path = t.spark, f"{t.sf_dir}/documents.parquet"
    written(spark.range(1))
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    vectorize(spark, path, f"{base}/out", f"{base}/state", t.documents.schema)
    return spark.read.parquet(f"{base}/out").select("doc_id", "embedding")


@query()
def stream_dedup(t: Tables) -> DataFrame:
    """Greedy duplicates with state per key, by a stream over the table's files."""
    import uuid

    from quillon.streaming.jobs import incremental_dedup, stream

    spark = t.spark
    written(spark.range(1))
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = incremental_dedup(stream(spark, f"{t.sf_dir}/documents.parquet", t.documents.schema).select("doc_id", "text"))
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "duplicate_of")


_ML = f"k AS (SELECT doc_id, text, {tok_sql(clean_sql('text'))} AS k FROM documents), h AS (SELECT doc_id, len(k) AS token_count, length(text) AS char_count, sha1(array_to_string(k, ' ')) AS clean_hash FROM k)"


@query(f"WITH {_ML} SELECT doc_id, token_count, char_count, token_count BETWEEN 20 AND 400 AS within_target_window, doc_id <> min(doc_id) OVER w AS is_duplicate, min(doc_id) OVER w AS duplicate_group FROM h WINDOW w AS (PARTITION BY clean_hash)")
def ml_features(t: Tables) -> DataFrame:
    from quillon.plans.pipelines import ml_features as features

    return features(t.documents.select("doc_id", "text")).select("doc_id", F.col("token_count").cast("long").alias("token_count"), F.col("char_count").cast("long").alias("char_count"), "within_target_window", "is_duplicate", "duplicate_group")


@query("SELECT o_orderpriority AS nombre, count(*) AS sentencias FROM orders GROUP BY 1")
def decompose_3nf(t: Tables) -> DataFrame:
    from quillon.plans.pipelines import decompose, parse_records

    tables = decompose(parse_records(_cards(t)))
    return tables["sentencias"].join(tables["tipo_proceso"].withColumnRenamed("id", "tipo_proceso_id"), "tipo_proceso_id").groupBy("nombre").agg(F.count(F.lit(1)).alias("sentencias"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def catalog_counts(t: Tables) -> DataFrame:
    parts = [getattr(t, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("documents", "pages", "benchmark")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_rows(t: Tables) -> DataFrame:
    from quillon.sources.readers import pending

    return pending(t.documents, t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id").agg(F.count(F.lit(1)).alias("n"))

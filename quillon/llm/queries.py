"""The op queries: whole tables, production parameters, digests of the operators' results."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import quality, toxicity
from quillon.llm._labels import fold
from quillon.llm._store import discard, temporary
from quillon.llm.bpe_codec import bpe_codec
from quillon.llm.html_text import extract_text
from quillon.llm.leaks import flag_leaks
from quillon.llm.licenses import scan_licenses, scan_sql
from quillon.llm.lm import pseudo_likelihood
from quillon.llm.prefix_trie import ordered_turns, prefix_trie, spliced
from quillon.llm.rules import quality_rules
from quillon.llm.simhash import near_duplicates
from quillon.llm.spelling import variants, word_counts
from quillon.llm.substring import substring_dedup
from quillon.llm.warc import read_archive, write_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("evidence.doc_id").alias("nearest"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = temporary(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    found = read_archive(spark, folder, payload=False)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4))
    rebuilt = spliced(turns, head, F.col("conv") - F.col("conv") % 20, 3)
    nodes = prefix_trie(rebuilt, turns.select("conv").distinct())
    discard(turns)
    return nodes.drop("node", "parent")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    spoilt = F.when(h % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    counts = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), spoil=spoilt)
    return variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_bpe_encode_decode": op10_bpe_encode_decode,
    "op11_warc": op11_warc,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op1_license_scan": scan_sql(),
    "op2_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM p),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS pos FROM m),
l AS (SELECT r, list(pos) AS gone FROM c GROUP BY r),
k AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(l.gone), 0) AS n_removed,
        CASE WHEN l.gone IS NULL THEN array_to_string(d.w, ' ')
             ELSE coalesce((SELECT string_agg(w2.x, ' ' ORDER BY w2.pos) FROM (
               SELECT unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS pos) w2
               WHERE NOT list_contains(l.gone, w2.pos)), '') END AS kept
      FROM d LEFT JOIN l USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k
""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, true AS intact
FROM t
""",
    "op12_conversation_prefix_trie": r"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS at_, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 4 AS h
  FROM (SELECT DISTINCT c FROM o)),
b AS (
  SELECT o.c, at_, r, t FROM o JOIN h USING (c) WHERE at_ >= h
  UNION ALL SELECT h.c, at_, r, t FROM h JOIN o ON o.c = h.c - h.c % 20 WHERE at_ < h),
q AS (
  SELECT h.c, coalesce(s, []) AS s FROM h LEFT JOIN (SELECT c, list(struct_pack(r := r, t := t) ORDER BY at_) AS s FROM b GROUP BY c) USING (c)),
p AS (SELECT c, len(s) AS l, d, s[1:d] AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM q)),
n AS (
  SELECT k, d, min(c) AS c, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) END AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE l = d), '')) AS e
  FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS m FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(m, 0) AS m FROM n LEFT JOIN kids USING (k, d)),
sub AS (
  SELECT k[1:a] AS k, a AS d, sum((n - 1) * w) AS saved, count(*) FILTER (WHERE m = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, up.c AS parent_conv_id, f.n AS n_convs, f.m::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, f.e AS ends_sha256
FROM f JOIN sub USING (k, d) LEFT JOIN f up ON up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]
""",
    "op13_spelling_variants": r"""
WITH r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS x FROM documents),
u AS (SELECT doc_id, x, count(*) AS m FROM r GROUP BY ALL),
h AS (
  SELECT x, m, length(x) AS l, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || x)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) AS h
  FROM u),
v AS (
  SELECT w, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(x, 1, h % l) || substr(x, h % l + 2) ELSE x END AS w, m FROM h)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(m) >= 2),
c AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
gone AS (SELECT w, n, substr(w, 1, i - 1) || substr(w, i + 1) AS k FROM c),
hole AS (SELECT w, n, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS k FROM c),
p AS (
  SELECT DISTINCT a.w AS a, a.n AS an, b.w AS b, b.n AS bn FROM hole a JOIN hole b USING (k) WHERE a.w <> b.w
  UNION SELECT g.w, g.n, v.w, v.n FROM gone g JOIN v ON v.w = g.k
  UNION SELECT v.w, v.n, g.w, g.n FROM gone g JOIN v ON v.w = g.k),
f AS (
  SELECT a AS w, count(*) AS n_near, first(CASE WHEN bn >= 10 * an THEN b END ORDER BY bn DESC, encode(b)) AS form,
         first(CASE WHEN bn >= 10 * an THEN bn END ORDER BY bn DESC, encode(b)) AS form_n
  FROM p GROUP BY a),
j AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, form, form_n FROM v LEFT JOIN f USING (w)),
chain AS (
  WITH RECURSIVE t(w, at_, step) AS (
    SELECT w, w, 0 FROM j UNION ALL SELECT t.w, j.form, step + 1 FROM t JOIN j ON j.w = t.at_ WHERE j.form IS NOT NULL)
  SELECT w, max_by(at_, step) AS root FROM t GROUP BY w)
SELECT w AS word, form, root, n, n_near::BIGINT AS n_near, form_n FROM j JOIN chain USING (w)
""",
}

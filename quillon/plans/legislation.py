"""References to laws and articles, whole norm collections, and tables that are published together."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_key
from quillon.operators.norms import load_norms, norms_schema
from quillon.operators.reconcile import reconcile, reconcile_into
from quillon.operators.store import temporary
from quillon.plans.registry import Tables, query
from quillon.sources import versions

_NAME = "CASE p_partkey % 6 WHEN 0 THEN 'Ley de ' || n_name WHEN 1 THEN '  LEY  de ' || n_name WHEN 2 THEN 'Código de ' || n_name WHEN 3 THEN 'Código de ' || n_name || ' y anexos' WHEN 4 THEN 'Estatuto' ELSE n_name END"
_ARTICLE = "CASE p_size % 3 WHEN 0 THEN 'Artículo ' || (p_size % 30) WHEN 1 THEN CAST(p_size % 30 AS STRING) ELSE 'inciso ' || p_size END"
_SUB = "CASE WHEN p_size % 5 = 0 THEN CAST(p_size % 7 AS STRING) || 'b' END"
_FORMS = ("Ley de ", "Código de ", "Estatuto de ")


def _refs(t: Tables) -> DataFrame:
    return t.part.join(t.nation, F.expr("p_partkey % 25 = n_nationkey")).select(F.col("p_partkey").cast("long").alias("legislacion_id"), F.expr(_NAME).alias("nombre_ley"), F.expr(_ARTICLE).alias("articulo"), F.expr(_SUB).alias("sub_indice"))


def _aliases(t: Tables, known: Column) -> DataFrame:
    names = F.explode(F.array(*(F.concat(F.lit(f), "n_name") for f in _FORMS)))
    return t.nation.where(known).select(F.col("n_nationkey").cast("long").alias("ley_id"), names.alias("alias")).select("ley_id", normalize_key(F.col("alias")).alias("alias_norm"))


def _law_articles(t: Tables) -> DataFrame:
    n = F.col("s_suppkey") % 40
    label = F.when(n % 2 == 0, F.concat(F.lit("Artículo "), n.cast("string"))).otherwise(F.concat(F.lit("Art. "), n.cast("string")))
    number = F.when(n % 4 != 0, F.when(n % 5 == 0, F.concat((n % 7).cast("string"), F.lit("B"))).otherwise(n.cast("string")))
    return t.supplier.select(F.col("s_nationkey").cast("long").alias("ley_id"), F.col("s_suppkey").cast("long").alias("articulo_id"), number.alias("articulo_numero"), label.alias("articulo_etiqueta"), (F.col("s_acctbal") > 3000).alias("es_vigente"), F.col("s_suppkey").alias("orden"))


_FOLD = r"nullif(trim(regexp_replace(lower(strip_accents({})), '\s+', ' ', 'g')), '')"
_SQL_ARTICLE, _SQL_SUB = _ARTICLE.replace("STRING", "VARCHAR"), _SUB.replace("STRING", "VARCHAR")


def _mapping_sql(name: str, known: str) -> str:
    """The mapping of a run that knows some nations' aliases."""
    return f"""{name}_a AS (SELECT n_nationkey::BIGINT AS ley_id, {_FOLD.format('f || n_name')} AS alias FROM nation, (SELECT unnest({list(_FORMS)}) AS f) WHERE {known}),
{name}_l AS (SELECT h.alias, count(DISTINCT ley_id) FILTER (WHERE a.alias = h.alias) AS e, count(DISTINCT ley_id) AS m, min(ley_id) FILTER (WHERE a.alias = h.alias) AS exact, min(ley_id) AS part
  FROM (SELECT DISTINCT alias FROM hints WHERE alias IS NOT NULL) h JOIN {name}_a a ON contains(a.alias, h.alias) OR contains(h.alias, a.alias) GROUP BY h.alias),
{name} AS (SELECT id AS legislacion_id, l.ley_id, k.articulo_id, h.alias AS alias_detectado,
  greatest(coalesce(l.c, 0), CASE WHEN k.articulo_id IS NOT NULL THEN 0.98 ELSE 0 END)::DOUBLE AS confianza,
  CASE WHEN k.articulo_id IS NOT NULL THEN 'articulo_encontrado' WHEN l.ley_id IS NOT NULL THEN 'ley_encontrada' ELSE 'pendiente' END AS estado_match, 'article_hint=' || h.hint AS notas
  FROM hints h LEFT JOIN (SELECT alias, CASE WHEN e = 1 THEN exact WHEN e = 0 AND m = 1 THEN part END AS ley_id, CASE WHEN e = 1 THEN 0.99 WHEN e = 0 AND m = 1 THEN 0.75 END AS c FROM {name}_l) l ON l.alias = h.alias
  LEFT JOIN keys k ON k.ley_id = l.ley_id AND k.hint = h.hint)"""


_HINTS = f"""refs AS (SELECT p_partkey::BIGINT AS id, {_NAME} AS nombre_ley, {_SQL_ARTICLE} AS articulo, {_SQL_SUB} AS sub_indice FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
folded AS (SELECT id, {_FOLD.format('nombre_ley')} AS a, {_FOLD.format('articulo')} AS b, {_FOLD.format('sub_indice')} AS c FROM refs),
hints AS (SELECT id, CASE WHEN regexp_matches(a, 'ley|codigo|estatuto') THEN a END AS alias,
  CASE WHEN regexp_full_match(c, '(articulo\\s*)?\\d+[a-z]?') THEN regexp_replace(c, '^articulo\\s*', '') WHEN regexp_full_match(b, '(articulo\\s*)?\\d+[a-z]?') THEN regexp_replace(b, '^articulo\\s*', '') END AS hint FROM folded),
arts AS (SELECT s_nationkey::BIGINT AS ley_id, s_suppkey::BIGINT AS articulo_id, s_suppkey % 40 AS n, s_acctbal > 3000 AS v FROM supplier),
arts2 AS (SELECT *, CASE WHEN n % 4 <> 0 THEN CASE WHEN n % 5 = 0 THEN (n % 7) || 'b' ELSE n::VARCHAR END END AS numero, CASE WHEN n % 2 = 0 THEN 'artículo ' || n ELSE 'art. ' || n END AS etiqueta FROM arts),
keys AS (SELECT ley_id, hint, articulo_id FROM (SELECT *, row_number() OVER (PARTITION BY ley_id, hint ORDER BY v DESC, articulo_id) AS r FROM
  (SELECT ley_id, articulo_id, v, unnest([numero, etiqueta, regexp_replace(etiqueta, '^artículo ', '')]) AS hint FROM arts2) WHERE hint IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {_HINTS}, {_mapping_sql('m', 'true')} SELECT * FROM m")
def article_mapping(t: Tables) -> DataFrame:
    """References to nations' statutes, resolved to law and article with status and confidence."""
    return reconcile(_refs(t), _aliases(t, F.lit(True)), _law_articles(t))


_MERGED = f"""{_HINTS}, {_mapping_sql('one', 'n_nationkey % 2 = 0')}, {_mapping_sql('two', 'n_nationkey % 3 <> 0')},
score AS (SELECT *, CASE estado_match WHEN 'articulo_encontrado' THEN 2 WHEN 'ley_encontrada' THEN 1 ELSE 0 END AS s FROM one UNION ALL BY NAME SELECT *, CASE estado_match WHEN 'articulo_encontrado' THEN 2 WHEN 'ley_encontrada' THEN 1 ELSE 0 END AS s FROM two),
best AS (SELECT o.legislacion_id, CASE WHEN (t.s, t.confianza) > (o.s, o.confianza) THEN t.articulo_id ELSE o.articulo_id END AS articulo_id, CASE WHEN (t.s, t.confianza) > (o.s, o.confianza) THEN t.alias_detectado ELSE o.alias_detectado END AS alias, o.articulo_id AS before
  FROM (SELECT * FROM score WHERE false UNION ALL BY NAME SELECT *, CASE estado_match WHEN 'articulo_encontrado' THEN 2 WHEN 'ley_encontrada' THEN 1 ELSE 0 END AS s FROM one) o JOIN (SELECT *, CASE estado_match WHEN 'articulo_encontrado' THEN 2 WHEN 'ley_encontrada' THEN 1 ELSE 0 END AS s FROM two) t USING (legislacion_id)),
cited AS (SELECT DISTINCT l_orderkey::BIGINT AS case_id, articulo_id FROM lineitem JOIN best ON legislacion_id = l_partkey WHERE articulo_id IS NOT NULL
  UNION SELECT DISTINCT l_orderkey::BIGINT, before FROM lineitem JOIN best ON legislacion_id = l_partkey WHERE before IS NOT NULL)"""


@query(f"WITH {_MERGED} SELECT articulo_id, count(*) AS cases, 0.98::DOUBLE AS confianza FROM cited GROUP BY articulo_id")
def article_links(t: Tables) -> DataFrame:
    """Orders that cite each article, after two runs that know different aliases and merge into one pair of tables."""
    root = temporary(t.spark, "reconciled")
    uses = t.lineitem.select(F.col("l_orderkey").cast("long").alias("sentencia_id"), F.col("l_partkey").cast("long").alias("legislacion_id"))
    for known in ("n_nationkey % 2 = 0", "n_nationkey % 3 <> 0"):
        reconcile_into(root, _refs(t), uses, _aliases(t, F.expr(known)), _law_articles(t))
    return versions.load(t.spark, root, "enlaces").groupBy("articulo_id").agg(F.count(F.lit(1)).alias("cases"), F.max("confianza").alias("confianza"))


def _norm_documents(t: Tables) -> DataFrame:
    """A document for each fifty customers: two versions of segments over customers, relations to the next document and to one that is not there."""
    k = F.expr("c_custkey div 50").cast("long")
    none = F.lit(None)
    fields = {f.name: f.dataType for f in norms_schema(1).fields}
    version = fields["versiones"].elementType
    node = version["estructura"].dataType.elementType
    leaf = node["nodos"].dataType.elementType

    def filled(kind, **given: Column) -> Column:
        return F.struct(*(given.get(f.name, none).cast(f.dataType).alias(f.name) for f in kind.fields))

    people = t.customer.select(k.alias("k"), (F.col("c_custkey") % 2).cast("int").alias("v"), "c_mktsegment", "c_custkey", "c_name")
    leaves = people.groupBy("k", "v", "c_mktsegment").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: filled(leaf, ref=F.concat(F.lit("c"), x["c_custkey"].cast("string")), tipo_nodo=F.lit("articulo"), etiqueta=x["c_name"], texto=F.concat(F.lit("  Texto de "), x["c_name"], F.lit(".  Fin. ")))).alias("leaves"))
    trees = leaves.groupBy("k", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "leaves"))), lambda x: filled(node, ref=none, tipo_nodo=F.lit("capitulo"), etiqueta=x["c_mktsegment"], nodos=x["leaves"])).alias("tree"))
    made = F.transform(F.array_sort(F.collect_list(F.struct("v", "tree"))), lambda x: filled(version, ref=F.concat(F.lit("v"), F.col("k").cast("string"), F.lit("_"), x["v"].cast("string")), version_label=F.concat(F.lit("version "), x["v"].cast("string")), es_vigente=F.when(x["v"] == 0, F.lit(False)), texto_consolidado=F.when(x["v"] == 1, F.lit("Todo el texto. Junto.")), estructura=x["tree"]))
    docs = trees.groupBy("k").agg(made.alias("versiones"))
    relation = fields["relaciones"].elementType
    text = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    key = F.col("k").cast("string")
    following = filled(relation, tipo_relacion=F.lit("reforma"), documento_destino_ref=text("d", (F.col("k") + 1).cast("string")), version_origen_ref=text("v", key, "_1"), version_destino_ref=F.lit("nowhere"), nodo_origen_ref=text("c", (F.col("k") * 50).cast("string")), nodo_destino_ref=text("c", (F.col("k") * 50 + 50).cast("string")))
    lost = filled(relation, tipo_relacion=F.lit("deroga"), documento_destino_ref=F.lit("unknown"))
    family = filled(fields["legislacion"], codigo=text("L", (F.col("k") % 5).cast("string")))
    values = {"ref": text("d", key), "tipo_documento": F.lit("ley"), "nombre_oficial": text("Ley número ", key), "nombre_corto": text("LEY  NUMERO ", key), "sigla": text("L", key), "documento_padre_ref": text("d", (F.col("k") - 1).cast("string")), "legislacion": family, "versiones": F.col("versiones"), "relaciones": F.array(following, lost)}
    return docs.select(*(values.get(n, none).cast(kind).alias(n) for n, kind in fields.items()))


_CUSTOMERS = "c AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey // 50 AS k, c_custkey % 2 AS v FROM customer), d AS (SELECT DISTINCT k FROM c)"


@query(
    f"""WITH {_CUSTOMERS}, n AS (SELECT k, count(DISTINCT v) AS versions, count(DISTINCT (v, c_mktsegment)) + count(*) + count(DISTINCT v) FILTER (WHERE v = 1) AS nodes, count(*) + count(DISTINCT v) FILTER (WHERE v = 1) AS passages,
  max('version ' || v || ': ' || c_mktsegment || ' > ' || c_name) AS last_path FROM c GROUP BY k)
SELECT 'Ley número ' || n.k AS name, 'L' || (n.k % 5) AS family, CASE WHEN p.k IS NOT NULL THEN 'Ley número ' || p.k END AS parent, 2::BIGINT AS aliases, versions, nodes, passages, last_path FROM n LEFT JOIN d p ON p.k = n.k - 1"""
)
def norm_load(t: Tables) -> DataFrame:
    """What the loader makes of each document: family, parent, aliases (two of three names are one in normal form), versions, nodes with the whole-text one, passages, the last path."""
    out = load_norms(_norm_documents(t), depth=1)
    count = lambda name, key, alias: out[name].groupBy(key).agg(F.count(F.lit(1)).alias(alias))
    own = out["norma_versiones"].select("version_id", "documento_id", "version_label")
    path = F.when(F.col("profundidad") == 1, F.concat("version_label", F.lit(": "), "path_text"))
    nodes = out["norma_nodos"].join(own, "version_id").groupBy("documento_id").agg(F.count(F.lit(1)).alias("nodes"), F.max(path).alias("last_path"))
    docs = out["norma_documentos"].join(out["legislaciones"].select("legislacion_id", F.col("codigo").alias("family")), "legislacion_id")
    parents = out["norma_documentos"].select(F.col("documento_id").alias("documento_padre_id"), F.col("nombre_oficial").alias("parent"))
    docs = docs.join(parents, "documento_padre_id", "left").join(count("norma_aliases", "documento_id", "aliases"), "documento_id").join(count("norma_versiones", "documento_id", "versions"), "documento_id")
    return docs.join(nodes, "documento_id").join(count("norma_fragmentos", "documento_id", "passages"), "documento_id").select(F.col("nombre_oficial").alias("name"), "family", "parent", "aliases", "versions", "nodes", "passages", "last_path")


@query(
    f"""WITH {_CUSTOMERS} SELECT 'Ley número ' || d.k AS origin, 'Ley número ' || (d.k + 1) AS destination, 'reforma' AS kind,
  (SELECT 'version 1' FROM c WHERE c.k = d.k AND v = 1 LIMIT 1) AS origin_version, NULL::VARCHAR AS destination_version,
  (SELECT c_name FROM c WHERE c_custkey = d.k * 50) AS origin_node, (SELECT c_name FROM c WHERE c_custkey = d.k * 50 + 50) AS destination_node
FROM d WHERE d.k + 1 IN (SELECT k FROM d)"""
)
def norm_relations(t: Tables) -> DataFrame:
    """Relations with both ends, versions and nodes by name: what cannot be resolved is null, a relation without a destination is gone."""
    out = load_norms(_norm_documents(t), depth=1)
    rows = out["norma_relaciones"].withColumnRenamed("tipo_relacion", "kind")
    for table, key, label, ends in (("norma_documentos", "documento", "nombre_oficial", ("origen", "destino")), ("norma_versiones", "version", "version_label", ("origen", "destino")), ("norma_nodos", "nodo", "etiqueta", ("origen", "destino"))):
        for end in ends:
            name = {"documento": "", "version": "_version", "nodo": "_node"}[key]
            name = {"origen": "origin", "destino": "destination"}[end] + name
            rows = rows.join(out[table].select(F.col(f"{key}_id").alias(f"{key}_{end}_id"), F.col(label).alias(name)), f"{key}_{end}_id", "left")
    return rows.select("origin", "destination", "kind", "origin_version", "destination_version", "origin_node", "destination_node")


@query("SELECT c_custkey, c_acctbal + coalesce(s, 0) AS balance, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def versioned_load(t: Tables) -> DataFrame:
    """Two tables published together, then both again, one made of its own earlier state."""
    root = temporary(t.spark, "versions")
    versions.publish(t.spark, root, {"accounts": t.customer.select("c_custkey", "c_acctbal"), "orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice")})
    even = versions.load(t.spark, root, "orders").where("o_orderkey % 2 = 0")
    paid = even.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"), F.count(F.lit(1)).alias("orders"))
    joined = versions.load(t.spark, root, "accounts").join(paid, "c_custkey", "left")
    versions.publish(t.spark, root, {"accounts": joined.select("c_custkey", (F.col("c_acctbal") + F.coalesce("s", F.lit(0))).alias("balance"), F.coalesce("orders", F.lit(0)).alias("orders")), "orders": even})
    return versions.load(t.spark, root, "accounts")

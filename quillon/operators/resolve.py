"""Entity resolution, trees and the statute loaders."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import normalize_key, uuid5
from quillon.operators.relational import distinct_on
from quillon.operators.store import written

DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
EXACT, VERIFIED, PARTIAL = 0.99, 0.98, 0.75
#: Longest run of characters that texts are indexed by for the containment test.
GRAM = 3


def build_aliases(entities: DataFrame, id_col: str, names: Column, order: list[Column]) -> DataFrame:
    """(id, alias, alias_norm, is_main): trimmed names, one per normal form and entity, the first is the main one."""
    named = entities.select(id_col, F.posexplode(names).alias("pos", "alias")).withColumn("alias", F.trim("alias")).withColumn("alias_norm", normalize_key(F.col("alias"))).where("alias_norm is not null")
    return distinct_on(named, [id_col, "alias_norm"], [F.col("pos")]).withColumn("is_main", F.col("pos") == 0).drop("pos")


def _runs(c: str, n: int) -> Column:
    """Distinct runs of n characters of a text that has as many."""
    size = F.char_length(c)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): distinct texts of inner.a within those of outer.b, as many as there are, at any size.

    A text within another shares all its runs of GRAM characters (a shorter
    one is a run itself); each meets the others under its rarest one only, so
    a common word brings few pairs together. The index holds numbers; texts come
    back for the pairs that met.
    """
    small = inner.select(a).where(F.char_length(a) > 0).distinct()
    large = written(outer.select(b).where(F.col(b).isNotNull()).distinct().withColumn("__at", F.monotonically_increasing_id()))
    keys = F.concat(*(_runs(b, n) for n in range(1, GRAM + 1)))
    index = large.select("__at", F.explode(keys).alias("run"))
    often = index.groupBy("run").agg(F.count(F.lit(1)).alias("often"))
    own = F.when(F.char_length(a) < GRAM, F.array(F.col(a))).otherwise(_runs(a, GRAM))
    # a run that no text has is the rarest of all
    rarest = small.select(a, F.explode(own).alias("run")).join(often, "run", "left").groupBy(a).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "run")).alias("best"))
    return rarest.where("best.often > 0").select(a, F.col("best.run").alias("run")).join(index, "run").select(a, "__at").join(large, "__at").where(F.contains(F.col(b), F.col(a))).select(a, b)


def resolve(refs: DataFrame, aliases: DataFrame, ref_id: str, ref_norm: str, target: str) -> DataFrame:
    """(ref_id, target, status, confidence).

    exact: one target has the alias; ambiguous: several; else partial: one
    target has an alias that contains the reference or is contained in it.
    """
    hits = aliases.groupBy(F.col("alias_norm").alias(ref_norm)).agg(F.countDistinct(target).alias("n"), F.min(target).alias(target))
    exact = refs.join(hits, ref_norm, "left")
    found = exact.where("n = 1").select(ref_id, target, F.lit("exact").alias("status"), F.lit(EXACT).alias("confidence"))
    many = exact.where("n > 1").select(ref_id, F.lit(None).cast("long").alias(target), F.lit("ambiguous").alias("status"), F.lit(0.0).alias("confidence"))
    rest = exact.where("n is null").select(ref_id, ref_norm)
    distinct = rest.select(ref_norm).where(F.col(ref_norm).isNotNull()).distinct()
    names = aliases.select(target, "alias_norm").distinct()
    within = contained(distinct, names, ref_norm, "alias_norm").union(contained(names, distinct, "alias_norm", ref_norm).select(ref_norm, "alias_norm"))
    pairs = within.distinct().join(names, "alias_norm").select(ref_norm, target)
    partial = pairs.groupBy(ref_norm).agg(F.countDistinct(target).alias("m"), F.min(target).alias(target))
    out = rest.join(partial, ref_norm, "left")
    one = F.col("m") == 1
    some = out.select(ref_id, F.when(one, F.col(target)).alias(target), F.when(one, "partial").when(F.col("m") > 1, "ambiguous").otherwise("none").alias("status"), F.when(one, PARTIAL).otherwise(0.0).alias("confidence"))
    return found.unionByName(many).unionByName(some)


def tree_paths(nodes: DataFrame, node: str, parent: str, label: str, sep: str = " > ", most: int = 64) -> DataFrame:
    """(node, depth, path): level by level from the roots; the loop's length is the tree's depth."""
    level = nodes.where(F.col(parent).isNull()).select(node, F.lit(0).alias("depth"), F.col(label).alias("path"))
    out = level
    for _ in range(most):
        up = level.select(F.col(node).alias(parent), F.col("depth").alias("d"), F.col("path").alias("p"))
        level = nodes.join(up, parent).select(node, (F.col("d") + 1).alias("depth"), F.concat("p", F.lit(sep), F.col(label)).alias("path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def node_type(depth: int) -> T.StructType:
    """A statute node with children down to depth."""
    fields = [T.StructField(n, T.StringType()) for n in ("id", "tipo_nodo", "etiqueta", "identificador", "titulo", "texto")] + [T.StructField("orden", T.IntegerType())]
    if depth:
        fields.append(T.StructField("nodos", T.ArrayType(node_type(depth - 1))))
    return T.StructType(fields)


ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("articulo_numero", "articulo_etiqueta", "numeral", "literal", "rubro", "texto_oficial")] + [T.StructField("orden", T.IntegerType())])


def statutes_schema(depth: int = 6) -> T.StructType:
    s = T.StringType()
    version = T.StructType([T.StructField("version_label", s), T.StructField("es_vigente", T.BooleanType()), T.StructField("texto_consolidado", s), T.StructField("nodos", T.ArrayType(node_type(depth))), T.StructField("articulos", T.ArrayType(ARTICLE))])
    law = T.StructType([T.StructField(n, s) for n in ("tipo_norma", "nombre_oficial", "nombre_corto", "sigla", "estado_vigencia")] + [T.StructField("aliases", T.ArrayType(s)), T.StructField("versiones", T.ArrayType(version))])
    return T.StructType([T.StructField("codigo", s), T.StructField("nombre", s), T.StructField("descripcion", s), T.StructField("leyes", T.ArrayType(law))])


def load_statutes(docs: DataFrame, depth: int = 6) -> dict[str, DataFrame]:
    """Nested statutes to six tables with stable ids: legislaciones, leyes, leyes_alias, leyes_versiones, articulos, nodos."""
    legs = docs.select(uuid5(DNS, F.lit("legislacion"), F.coalesce("codigo", "nombre")).alias("legislacion_id"), "codigo", "nombre", "descripcion", "leyes")
    laws = legs.select("legislacion_id", F.explode("leyes").alias("l")).select(uuid5(DNS, F.lit("ley"), F.col("legislacion_id"), F.col("l.nombre_oficial")).alias("ley_id"), "legislacion_id", "l.*")
    laws = laws.withColumns({"tipo_norma": F.coalesce("tipo_norma", F.lit("ley")), "estado_vigencia": F.coalesce("estado_vigencia", F.lit("vigente"))})
    names = F.filter(F.concat(F.array("nombre_oficial", "nombre_corto", "sigla"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    versions = laws.select("ley_id", F.posexplode("versiones").alias("pos", "v")).select(uuid5(DNS, F.lit("version"), F.col("ley_id"), F.coalesce("v.version_label", F.col("pos").cast("string"))).alias("version_id"), "ley_id", "v.*").withColumn("es_vigente", F.coalesce("es_vigente", F.lit(True)))
    arts = versions.select("version_id", F.posexplode("articulos").alias("pos", "a")).select("version_id", uuid5(DNS, F.lit("articulo"), F.col("version_id"), F.col("a.articulo_numero"), F.col("a.numeral"), F.col("a.literal")).alias("articulo_id"), F.coalesce("a.orden", F.col("pos") + 1).alias("orden"), "a.articulo_numero", "a.rubro", "a.texto_oficial")
    level = versions.select("version_id", F.lit(None).cast("string").alias("padre_id"), F.lit(0).alias("profundidad"), F.lit("").alias("up"), F.posexplode("nodos").alias("pos", "n"))
    nodes = None
    for k in range(depth + 1):
        path = F.when(F.col("up") == "", F.col("n.etiqueta")).otherwise(F.concat("up", F.lit(" > "), "n.etiqueta"))
        own = level.withColumn("path_text", path).withColumn("nodo_id", uuid5(DNS, F.lit("nodo"), F.col("version_id"), F.col("path_text"), F.col("pos")))
        flat = own.select("nodo_id", "version_id", "padre_id", "profundidad", F.coalesce("n.orden", F.col("pos") + 1).alias("orden"), "n.tipo_nodo", "n.etiqueta", "n.titulo", "n.texto", "path_text")
        nodes = flat if nodes is None else nodes.unionByName(flat)
        if k < depth:
            level = own.select("version_id", F.col("nodo_id").alias("padre_id"), (F.col("profundidad") + 1).alias("profundidad"), F.col("path_text").alias("up"), F.posexplode("n.nodos").alias("pos", "n"))
    return {
        "legislaciones": legs.drop("leyes"),
        "leyes": laws.drop("aliases", "versiones"),
        "leyes_alias": build_aliases(laws.select("ley_id", names.alias("names")), "ley_id", F.col("names"), []),
        "leyes_versiones": versions.drop("nodos", "articulos"),
        "articulos": arts,
        "nodos": nodes,
    }


def resolve_relations(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations with document refs turned to ids; those to unknown documents are left out."""
    by = lambda role: documents.select(F.col("ref").alias(f"{role}_ref"), F.col("documento_id").alias(f"{role}_id"))
    return relations.join(by("origen"), "origen_ref").join(by("destino"), "destino_ref").select("origen_id", "destino_id", "tipo_relacion")

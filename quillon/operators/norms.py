"""The loader of whole norm collections: documents, versions, trees, passages, and the relations between them."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.chunking import explode_sentences
from quillon.functions.text import normalize_key, null_if_empty, squeeze, uuid5
from quillon.operators.relational import distinct_on
from quillon.operators.resolve import DNS
from quillon.sources.readers import DOCUMENT_TYPES

S = T.StringType()


def _struct(names: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*(T.StructField(n, S) for n in names.split()), *more])


def _list(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, T.ArrayType(kind))


SOURCE = _struct("id codigo nombre base_url tipo_fuente fuente_url ruta_archivo checksum_archivo", T.StructField("es_principal", T.BooleanType()))
ENDS = ("documento_destino", "version_origen", "version_destino", "nodo_origen", "nodo_destino")
RELATION = _struct("id tipo_relacion fecha_relacion notas " + " ".join(f"{e}_id {e}_ref" for e in ENDS))


def node_type(depth: int) -> T.StructType:
    """A node with children down to depth."""
    own = _struct("id ref tipo_nodo etiqueta identificador titulo articulo_numero texto", T.StructField("orden", T.IntegerType()))
    return T.StructType([*own.fields, _list("nodos", node_type(depth - 1))]) if depth else own


def norms_schema(depth: int = 6) -> T.StructType:
    """A document as it comes in JSON; read lists and wrapped lists with readers.json_documents(.., 'documentos', norms_schema())."""
    version = _struct("id ref version_label numero_version fecha_inicio_vigencia fecha_fin_vigencia texto_consolidado", T.StructField("es_vigente", T.BooleanType()), _list("fuentes", SOURCE), _list("estructura", node_type(depth)))
    return _struct(
        "id ref tipo_documento documento_padre_ref nombre_oficial nombre_corto sigla numero_oficial autoridad_emisora ambito estado_vigencia fecha_emision fecha_publicacion fecha_vigencia fecha_derogacion",
        T.StructField("legislacion", _struct("id codigo nombre descripcion")), _list("aliases", S), _list("versiones", version), _list("relaciones", RELATION),
    )


def references(rows: DataFrame, ref: str, target: str, kind: str) -> DataFrame:
    """(kind_ref, kind_found): the dictionary from load references to ids; of several rows with a reference the greatest id."""
    return rows.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias(f"{kind}_ref")).agg(F.max(target).alias(f"{kind}_found"))


def resolved(rows: DataFrame, dictionary: DataFrame, kind: str) -> DataFrame:
    """rows with kind_id: the given id, else that of kind_ref, else null."""
    return rows.join(dictionary, f"{kind}_ref", "left").withColumn(f"{kind}_id", F.coalesce(f"{kind}_id", f"{kind}_found")).drop(f"{kind}_found")


def _last(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of rows with an id the last one written."""
    return distinct_on(rows, [key], order)


def _nodes(versions: DataFrame, depth: int) -> DataFrame:
    """The trees of all versions, level by level, with depth, path and place."""
    level = versions.select("version_id", "documento_id", F.lit(None).cast("string").alias("nodo_padre_id"), F.lit(0).alias("profundidad"), F.lit(None).cast("string").alias("up"), F.array().cast("array<int>").alias("at"), F.posexplode("estructura").alias("pos", "n"))
    levels = []
    for k in range(depth + 1):
        own = level.withColumn("path_text", F.concat_ws(" > ", "up", "n.etiqueta")).withColumn("place", F.concat("at", F.array("pos")))
        made = uuid5(DNS, F.lit("norma_nodo"), F.col("version_id"), F.coalesce("n.ref", "n.tipo_nodo"), F.col("nodo_padre_id"), F.coalesce("n.identificador", "n.etiqueta"))
        own = own.withColumn("nodo_id", F.coalesce("n.id", made)).withColumn("texto", null_if_empty(squeeze(F.col("n.texto"))))
        levels.append(own.select("nodo_id", "version_id", "documento_id", "nodo_padre_id", F.col("n.ref").alias("ref_carga"), "n.tipo_nodo", "n.etiqueta", "n.identificador", "n.titulo", "n.articulo_numero", "texto", F.coalesce("n.orden", F.col("pos") + 1).alias("orden"), "profundidad", "path_text", "place"))
        if k < depth:
            level = own.select("version_id", "documento_id", F.col("nodo_id").alias("nodo_padre_id"), (F.col("profundidad") + 1).alias("profundidad"), F.col("path_text").alias("up"), F.col("place").alias("at"), F.posexplode("n.nodos").alias("pos", "n"))
    return reduce(DataFrame.unionByName, levels)


def _whole_texts(versions: DataFrame) -> DataFrame:
    """One more node a version that has its text in one piece."""
    text = null_if_empty(squeeze(F.col("texto_consolidado")))
    label = F.coalesce("version_label", "nombre_oficial")
    ref = uuid5(DNS, F.lit("norma_nodo_documento"), F.col("version_id"))
    made = uuid5(DNS, F.lit("norma_nodo"), F.col("version_id"), ref, F.lit(None).cast("string"), label)
    none = F.lit(None).cast("string")
    return versions.where(F.col("texto_consolidado") != "").select(
        made.alias("nodo_id"), "version_id", "documento_id", none.alias("nodo_padre_id"), ref.alias("ref_carga"), F.lit("documento").alias("tipo_nodo"), label.alias("etiqueta"), none.alias("identificador"),
        F.lit("Texto consolidado").alias("titulo"), none.alias("articulo_numero"), text.alias("texto"), F.lit(1).alias("orden"), F.lit(0).alias("profundidad"), label.alias("path_text"), F.array(F.lit(1 << 30)).alias("place"),
    )


def load_norms(docs: DataFrame, depth: int = 6, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents of norms_schema to nine tables with stable ids; sources: more sources, of SOURCE's columns.

    Rows come first; parents and relations are resolved afterwards through the
    references of all documents, versions and nodes, wherever they stand. A
    relation to an unknown document is left out; unknown versions and nodes give
    null, and so does an unknown parent. An id that occurs again replaces the row
    before. A document type that is not seeded ends the load with an error.
    """
    given = docs.withColumn("documento_id", F.coalesce("id", uuid5(DNS, F.lit("norma_documento"), F.coalesce("ref", "nombre_oficial"))))
    kind = F.when(F.col("tipo_documento").isin(DOCUMENT_TYPES), F.col("tipo_documento")).otherwise(F.raise_error(F.concat(F.lit("document type is not seeded: "), F.coalesce("tipo_documento", F.lit("null")))).cast("string"))
    family = F.coalesce("legislacion.codigo", "legislacion.nombre")
    family_id = F.when(family.isNotNull(), F.coalesce("legislacion.id", uuid5(DNS, F.lit("legislacion_lenta"), F.lower(family))))
    given = given.withColumns({"tipo_documento": kind, "legislacion_id": family_id, "estado_vigencia": F.coalesce("estado_vigencia", F.lit("vigente"))})
    families = given.where("legislacion_id is not null").groupBy("legislacion_id").agg(F.min("legislacion.codigo").alias("codigo"), F.min(F.coalesce("legislacion.nombre", "legislacion.codigo")).alias("nombre"), F.min("legislacion.descripcion").alias("descripcion"))
    plain = ["documento_id", "ref", "legislacion_id", "tipo_documento", "documento_padre_ref", "nombre_oficial", "nombre_corto", "sigla", "numero_oficial", "autoridad_emisora", "ambito", "estado_vigencia", "fecha_emision", "fecha_publicacion", "fecha_vigencia", "fecha_derogacion"]
    documents = _last(given.select(*plain), "documento_id", [F.desc_nulls_last("ref"), F.desc("nombre_oficial")])
    by_document = references(documents, "ref", "documento_id", "documento")
    parents = by_document.withColumnsRenamed({"documento_ref": "documento_padre_ref", "documento_found": "documento_padre_id"})
    names = F.filter(F.concat(F.array("nombre_oficial", "nombre_corto", "sigla"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    named = given.select("documento_id", F.posexplode(names).alias("pos", "alias")).withColumn("alias", squeeze(F.col("alias"))).withColumn("alias_normalizado", normalize_key(F.col("alias"))).where("alias_normalizado is not null")
    aliases = named.groupBy("documento_id", "alias_normalizado").agg(F.min_by("alias", "pos").alias("alias"), (F.min("pos") == 0).alias("es_principal"))

    v = given.select("documento_id", "nombre_oficial", F.explode("versiones").alias("v")).select("documento_id", "nombre_oficial", "v.*")
    made = uuid5(DNS, F.lit("norma_version"), F.col("documento_id"), F.coalesce("ref", "version_label"), F.col("fecha_inicio_vigencia"))
    v = _last(v.withColumn("version_id", F.coalesce("id", made)), "version_id", [F.desc_nulls_last("version_label")])
    v = v.withColumns({"es_vigente": F.coalesce("es_vigente", F.lit(True)), "hash_texto": F.when(F.col("texto_consolidado") != "", F.sha2("texto_consolidado", 256))})

    used = v.select("version_id", F.explode("fuentes").alias("s")).select("version_id", "s.*").where("codigo is not null").withColumnRenamed("id", "dado")
    wanted = "dado codigo nombre base_url tipo_fuente".split()
    every = used.select(*wanted) if sources is None else sources.withColumnRenamed("id", "dado").select(*wanted).unionByName(used.select(*wanted))
    fuentes = every.groupBy("codigo").agg(F.min("dado").alias("dado"), F.min("nombre").alias("nombre"), F.min("base_url").alias("base_url"), F.min("tipo_fuente").alias("tipo_fuente"))
    fuentes = fuentes.select(F.coalesce("dado", uuid5(DNS, F.lit("fuente"), F.col("codigo"))).alias("fuente_id"), "codigo", F.coalesce("nombre", "codigo").alias("nombre"), "base_url", "tipo_fuente")
    by_version = used.join(fuentes.select("codigo", "fuente_id"), "codigo")
    own_id = F.coalesce("dado", uuid5(DNS, F.lit("norma_version_fuente"), F.col("version_id"), F.coalesce("codigo", "fuente_url"), F.col("ruta_archivo")))
    version_sources = by_version.select(own_id.alias("version_fuente_id"), "version_id", "fuente_id", "fuente_url", "ruta_archivo", "checksum_archivo", F.coalesce("es_principal", F.lit(False)).alias("es_principal"))

    trees = _last(_nodes(v, depth), "nodo_id", [F.desc("place")])
    nodes = trees.unionByName(_whole_texts(v)).withColumn("texto_normalizado", normalize_key(F.col("texto")))
    texts = nodes.where("texto is not null").withColumn("anchor", F.coalesce("etiqueta", "titulo", "tipo_nodo"))
    chunks = explode_sentences(texts, "statutes", "texto", "documento_id", "version_id", "nodo_id", "tipo_nodo", "anchor").select("*", (F.col("chunk_no") - 1).alias("pos"), F.col("chunk").alias("trozo"))
    label = F.when((F.col("anchor") == "") | F.startswith("trozo", "anchor"), F.col("trozo")).otherwise(F.concat("anchor", F.lit(". "), "trozo"))
    tipo = F.concat(F.lit("nodo_"), "tipo_nodo")
    passages = chunks.select(uuid5(DNS, F.lit("norma_fragmento"), F.col("nodo_id"), F.col("pos") + 1, tipo).alias("fragmento_id"), "documento_id", "version_id", "nodo_id", tipo.alias("tipo_fragmento"), label.alias("contenido"), (F.col("pos") + 1).alias("orden"))

    r = given.select(F.col("documento_id").alias("documento_origen_id"), F.explode("relaciones").alias("r")).select("documento_origen_id", "r.*")
    versions, tree_refs = references(v, "ref", "version_id", "version"), references(trees, "ref_carga", "nodo_id", "nodo")
    for end in ENDS:
        kind = end.split("_")[0]
        source = {"documento": by_document, "version": versions, "nodo": tree_refs}[kind]
        r = resolved(r, source.withColumnsRenamed({f"{kind}_ref": f"{end}_ref", f"{kind}_found": f"{end}_found"}), end)
    made = uuid5(DNS, F.lit("norma_relacion"), F.col("documento_origen_id"), F.col("documento_destino_id"), F.col("tipo_relacion"), F.col("version_origen_ref"), F.col("version_destino_ref"))
    r = r.where("documento_destino_id is not null").withColumn("relacion_id", F.coalesce("id", made))
    relations = _last(r, "relacion_id", [F.desc_nulls_last("notas"), F.desc_nulls_last("nodo_origen_id"), F.desc_nulls_last("nodo_destino_id")])
    return {
        "legislaciones": families,
        "norma_fuentes": fuentes,
        "norma_documentos": documents.join(parents, "documento_padre_ref", "left").withColumnRenamed("ref", "ref_carga").drop("documento_padre_ref"),
        "norma_aliases": aliases.withColumn("alias_id", uuid5(DNS, F.lit("norma_alias"), F.col("documento_id"), F.col("alias_normalizado"))),
        "norma_versiones": v.drop("id", "fuentes", "estructura", "nombre_oficial").withColumnRenamed("ref", "ref_carga"),
        "norma_version_fuentes": version_sources,
        "norma_nodos": nodes.drop("place", "documento_id"),
        "norma_fragmentos": passages,
        "norma_relaciones": relations.select("relacion_id", "documento_origen_id", "documento_destino_id", "tipo_relacion", *(f"{e}_id" for e in ENDS[1:]), "fecha_relacion", "notas"),
    }

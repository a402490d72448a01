"""From free-text references to laws and articles, kept as tables that later runs merge into."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.extract import article_hint, law_name
from quillon.operators.relational import distinct_on, tasks_for
from quillon.operators.resolve import VERIFIED, resolve
from quillon.operators.store import discard, written
from quillon.sources import versions

FOUND, LAW, PENDING = "articulo_encontrado", "ley_encontrada", "pendiente"
SOURCE = "reconciliacion_automatica"
MAPPING = ["legislacion_id", "ley_id", "articulo_id", "alias_detectado", "confianza", "estado_match", "notas"]


def _rank(status: Column) -> Column:
    return F.when(status == FOUND, 2).when(status == LAW, 1).otherwise(0)


def _article_keys(articles: DataFrame) -> DataFrame:
    """(ley_id, hint, articulo_id): each spelling that names an article of a law, and the one it names: in force first, then by order, then by id."""
    label = F.lower(F.trim("articulo_etiqueta"))
    forms = F.array_distinct(F.array_compact(F.array(F.lower(F.trim("articulo_numero")), label, F.regexp_replace(label, r"^artículo ", ""))))
    keyed = articles.select("ley_id", "articulo_id", "es_vigente", "orden", F.explode(forms).alias("hint"))
    return distinct_on(keyed, ["ley_id", "hint"], [F.desc_nulls_last("es_vigente"), F.asc_nulls_last("orden"), F.col("articulo_id")]).select("ley_id", "hint", "articulo_id")


def reconcile(refs: DataFrame, aliases: DataFrame, articles: DataFrame, ref_id: str = "legislacion_id", fields: tuple[str, ...] = ("nombre_ley", "articulo", "sub_indice")) -> DataFrame:
    """The mapping table: for each reference its law, article, confidence and status.

    refs: a row a distinct reference; aliases: (ley_id, alias_norm); articles:
    (ley_id, articulo_id, articulo_numero, articulo_etiqueta, es_vigente, orden).
    A law by its name (exact 0.99, else contained or containing 0.75, each only
    if it is one law's); in a law, an article by number or label (0.98). A
    reference is parsed once, in as many tasks as there are rows for, not in
    those of its files; names are resolved once each, however many references
    hold them.
    """
    values = [F.col(c) for c in fields]
    dealt = refs.select(ref_id, *fields).repartition(tasks_for(refs.select(ref_id)), ref_id)
    hints = written(dealt.select(F.col(ref_id).alias("legislacion_id"), law_name(*values).alias("alias_detectado"), article_hint(*values).alias("hint")))
    names = written(hints.select(F.col("alias_detectado").alias("name"), F.col("alias_detectado").alias("norm")).where("name is not null").distinct())
    laws = resolve(names, aliases, "name", "norm", "ley_id").select("name", "ley_id", "confidence").where("ley_id is not null")
    known = hints.join(laws, F.col("alias_detectado") == F.col("name"), "left").drop("name")
    found = known.join(_article_keys(articles), ["ley_id", "hint"], "left")
    status = F.when(F.col("articulo_id").isNotNull(), FOUND).when(F.col("ley_id").isNotNull(), LAW).otherwise(PENDING)
    sure = F.when(F.col("articulo_id").isNotNull(), F.greatest(F.col("confidence"), F.lit(VERIFIED))).otherwise(F.coalesce("confidence", F.lit(0.0)))
    notes = F.when(F.col("hint").isNotNull(), F.concat(F.lit("article_hint="), "hint"))
    return found.select("legislacion_id", "ley_id", "articulo_id", "alias_detectado", sure.alias("confianza"), status.alias("estado_match"), notes.alias("notas"))


def merge_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row a reference: the new one where it finds more (an article over a law over nothing, then higher confidence), else the old one as it was."""
    both = old.select(*MAPPING, F.lit(0).alias("run")).unionByName(new.select(*MAPPING, F.lit(1).alias("run")))
    best = both.groupBy("legislacion_id").agg(F.max_by(F.struct(*MAPPING[1:]), F.struct(_rank(F.col("estado_match")), "confianza", -F.col("run"))).alias("b"))
    return best.select("legislacion_id", "b.*")


def article_links(mapping: DataFrame, uses: DataFrame, case: str = "sentencia_id") -> DataFrame:
    """(case, article, source, alias, confidence): what each case cites by way of its references; uses: (case, legislacion_id). Of several references to an article the last one's alias counts."""
    found = mapping.where("articulo_id is not null").select("legislacion_id", "articulo_id", "alias_detectado")
    cited = uses.select(case, "legislacion_id").join(found, "legislacion_id")
    links = cited.groupBy(case, "articulo_id").agg(F.max_by("alias_detectado", "legislacion_id").alias("alias_detectado"))
    return links.select(case, "articulo_id", F.lit(SOURCE).alias("fuente_extraccion"), "alias_detectado", F.lit(VERIFIED).alias("confianza"))


def merge_links(old: DataFrame, new: DataFrame, case: str = "sentencia_id") -> DataFrame:
    """Links of both; where both have one its source stays, the new alias counts and the higher confidence."""
    rows = old.withColumn("run", F.lit(0)).unionByName(new.withColumn("run", F.lit(1)))
    return rows.groupBy(case, "articulo_id").agg(F.min_by("fuente_extraccion", "run").alias("fuente_extraccion"), F.max_by("alias_detectado", "run").alias("alias_detectado"), F.max("confianza").alias("confianza"))


def reconcile_into(root: str, refs: DataFrame, uses: DataFrame, aliases: DataFrame, articles: DataFrame) -> int:
    """A run over tables kept under root (mapeo, enlaces): both are merged and published together. Returns the state's number."""
    spark = refs.sparkSession
    number = versions.current(spark, root)[0]
    mapping = reconcile(refs, aliases, articles)
    if number:
        mapping = merge_mapping(versions.load(spark, root, "mapeo", number), mapping)
    mapping = written(mapping)
    links = article_links(mapping, uses)
    if number:
        links = merge_links(versions.load(spark, root, "enlaces", number), links)
    done = versions.publish(spark, root, {"mapeo": mapping, "enlaces": links})
    discard(mapping)
    return done

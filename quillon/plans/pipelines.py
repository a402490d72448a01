"""The two batch pipelines: corpus build and ML preparation, as lists of pure steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.chunking import explode_chunks, explode_sentences, sliding_chunks
from quillon.functions.extract import between, card, certificate_parts, thesaurus
from quillon.functions.rules import first_rule
from quillon.functions.text import clean_full_text, clean_text, near_key, parse_date, sanitize, tokens, uuid5
from quillon.operators.ml import hash_embed
from quillon.operators.resolve import DNS
from quillon.operators.store import written

FRAGMENTS = ("considerandos", "por_tanto")


def parse_records(raw: DataFrame, text: str = "text") -> DataFrame:
    """Judgment texts to typed columns: the card's fields, the dates, the outcome class, the thesaurus, the two sections (of the certificate where there is one)."""
    fields = card(F.col(text))
    certificate = certificate_parts(F.col(text))[1]
    body = F.when(certificate != "", certificate).otherwise(F.col(text))
    out = raw.select("*", *(c.alias(k) for k, c in fields.items()))
    return out.withColumns(
        {
            "id": uuid5(DNS, F.lit("sentencia"), F.col("sentencia_id")),
            "resuelta": parse_date(F.col("fecha_resolucion")),
            "recurrida": parse_date(F.col("fecha_sentencia_recurrida")),
            "fallo_macro": first_rule(F.col("fallo")),
            "tesauros": thesaurus(F.col(text)),
            "considerandos": clean_full_text(between(body, "CONSIDERANDO", ["POR TANTO", "FALLA"])),
            "por_tanto": clean_full_text(F.coalesce(between(body, "POR TANTO", []), between(body, "FALLA", []))),
        }
    )


def decompose(records: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Parsed records to twelve normalised tables: dimensions by upper-case natural key, judgments with their keys, thesaurus, laws, links, fragments, and files where path names their column."""
    out, facts = {}, records
    for name in ("tipo_proceso", "magistrado", "tribunal", "materia"):
        key = F.upper(F.trim(name))
        named = records.groupBy(key.alias("key")).agg(F.min(name).alias("nombre")).where("key is not null")
        out[name] = named.select(uuid5(DNS, F.lit(name), F.col("key")).alias("id"), "nombre")
        facts = facts.withColumn(f"{name}_id", F.when(F.col(name).isNotNull(), uuid5(DNS, F.lit(name), key)))
    people = records.select(F.explode(F.array(*(F.struct(F.col(c).alias("nombre"), F.lit(c).alias("rol_habitual")) for c in ("recurrente", "recurrido")))).alias("p")).select("p.*").where("nombre is not null")
    public = F.col("nombre").rlike("(?iu)tribunal|corte")
    out["personas_entidades"] = people.groupBy(uuid5(DNS, F.lit("persona"), F.upper("nombre")).alias("id")).agg(F.min("nombre").alias("nombre"), F.min("rol_habitual").alias("rol_habitual")).withColumn("tipo", F.when(public, "institución_pública").otherwise("persona"))
    facts = facts.withColumns({f"{c}_id": F.when(F.col(c).isNotNull(), uuid5(DNS, F.lit("persona"), F.upper(c))) for c in ("recurrente", "recurrido")})
    out["sentencias"] = facts.select("id", "sentencia_id", "resuelta", "recurrida", "fallo", "fallo_macro", "tipo_proceso_id", "magistrado_id", "tribunal_id", "recurrente_id", "recurrido_id").dropDuplicates(["id"])
    out["sentencias_materias"] = facts.where("materia_id is not null").select("id", "materia_id").distinct()
    entries = records.select("id", F.posexplode("tesauros").alias("pos", "t"))
    asked = entries.where("t.problema is not null")
    out["tesauro"] = asked.select(uuid5(DNS, F.lit("tesauro"), F.col("id"), F.col("pos")).alias("tesauro_id"), F.col("id").alias("sentencia_id"), F.col("t.categoria").alias("categoria"), F.col("t.problema").alias("problema_juridico"), F.col("t.respuesta").alias("respuesta_juridica")).dropDuplicates(["tesauro_id"])
    laws = entries.select("id", F.explode("t.legislaciones").alias("l")).select("id", uuid5(DNS, F.lit("legislacion"), F.col("l.ley"), F.col("l.articulo"), F.col("l.sub_indice")).alias("legislacion_id"), F.col("l.ley").alias("nombre_ley"), "l.articulo", "l.sub_indice")
    out["legislacion"] = laws.drop("id").distinct()
    out["sentencias_legislacion"] = laws.select("id", "legislacion_id").distinct()
    said = F.transform("tesauros", lambda t: F.struct(F.lit("consideraciones_sala").alias("tipo"), t["consideraciones"].alias("texto")))
    sections = F.concat(said, F.array(*(F.struct(F.lit(c).alias("tipo"), F.col(c).alias("texto")) for c in FRAGMENTS)))
    parts = records.dropDuplicates(["id"]).select("id", F.posexplode(sections).alias("parte", "f")).select("id", "parte", "f.*").where("texto is not null and texto != ''")
    chunks = explode_sentences(parts.withColumn("texto", sanitize(F.col("texto"))), "batches", "texto", "id", "parte", "tipo")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("parte", "chunk_no"))  # a record's own passages
    out["fragmentos_texto"] = chunks.select("id", "tipo", "chunk", nth.alias("orden")).select(uuid5(DNS, F.lit("fragmento"), F.col("id"), F.col("orden")).alias("fragmento_id"), F.col("id").alias("sentencia_id"), "tipo", "orden", F.col("chunk").alias("contenido"))
    if path:
        out["documentos_pdf"] = records.where(F.col(path).isNotNull()).select(uuid5(DNS, F.lit("pdf"), F.col("id")).alias("documento_id"), F.col("id").alias("sentencia_id"), F.col(path).alias("ruta_archivo")).dropDuplicates(["documento_id"])
    return out


def rechunk(fragments: DataFrame, id_col: str, text: str) -> DataFrame:
    """Sanitised texts in sliding windows: (id, chunk_no, chunk); a text without chunks goes."""
    return explode_chunks(fragments.select(id_col, sanitize(F.col(text)).alias("t")), sliding_chunks(F.col("t")), id_col)


def ml_features(df: DataFrame, id_col: str = "doc_id", text: str = "text", low: int = 20, high: int = 400) -> DataFrame:
    """The feature table of a corpus: cleaned text's hash and key, counts, window flag, duplicates. Texts are cleaned once, and the features written."""
    clean = df.select("*", tokens(clean_text(F.col(text))).alias("__toks"))
    toks = F.col("__toks")
    base = clean.select(*(F.col(f"`{c}`") for c in df.columns if c != text), F.sha1(F.array_join(toks, " ")).alias("clean_hash"), near_key(toks).alias("near_key"), F.size(toks).alias("token_count"), F.char_length(F.coalesce(text, F.lit(""))).alias("char_count"))
    base = written(base.withColumn("within_target_window", F.col("token_count").between(low, high)))
    exact = base.groupBy("clean_hash").agg(F.min(id_col).alias("duplicate_group"))
    return base.join(exact, "clean_hash").withColumn("is_duplicate", F.col(id_col) != F.col("duplicate_group")).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("duplicate_group")))


def embed_pending(df: DataFrame, done: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Vectors for rows that have none yet."""
    return hash_embed(df.join(done.select(id_col), id_col, "left_anti").select(id_col, text), text)

"""Whole records made of conversations: cards in two layouts, thesaurus entries, the twelve tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.extract import card, thesaurus
from quillon.operators.store import discard, written
from quillon.plans.pipelines import decompose, parse_records
from quillon.plans.registry import Tables, query

_CARD = [("Sentencia", "'S-' || conv_id"), ("Tipo de proceso", "'Tipo ' || conv_id % 4"), ("Subtipo de proceso", "'Sub ' || conv_id % 3"), ("Magistrado ponente", "'Mag ' || conv_id % 7"), ("Materia", "'Materia ' || conv_id % 5"), ("Fecha de resolución", "'0' || (1 + conv_id % 9) || '/0' || (1 + conv_id % 7) || '/2020'")]
_PARTIES = [("Recurrente", "'Ana ' || conv_id % 6"), ("Recurrido", "'Corte ' || conv_id % 5"), ("Tribunal", "'Sala ' || conv_id % 3"), ("Fecha de sentencia recurrida", "'01/02/2019'")]


def _records(t: Tables) -> DataFrame:
    """A record a conversation: odd ones with labels without colons; each user turn is a thesaurus entry with the next turn as its answer and views, and the last turns are the certificate's sections."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(order).alias("reply"))
    answer = F.when(F.col("reply").isNotNull(), F.concat(F.lit("Respuesta al problema jurídico\n"), "reply", F.lit("\nConsideraciones de la sala\nPágina 1 de 2\n\n\n\n"), "reply", F.lit("\n"))).otherwise(F.lit(""))
    laws = F.concat(F.lit("Legislación aplicada\nArtículo\nSub Indice\nLey "), (F.col("conv_id") % 9).cast("string"), F.lit("\n"), F.col("turn").cast("string"), F.lit("\n--\nSuelta\nJerarquía\nalta"))
    entry = F.concat(F.lit("\nTesauro\nCat "), (F.col("turn") % 3).cast("string"), F.lit("\n¿"), "text", F.lit("?\n"), answer, laws)
    per = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", entry.alias("e"))))), lambda x: x["e"]), "").alias("entries"), F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    colon = F.when(F.col("conv_id") % 2 == 0, F.lit(":")).otherwise(F.lit(""))

    def line(label: str, value: str) -> list:
        if label == "Sentencia":
            return [F.lit("Sentencia "), F.expr(value), F.lit("\n")]
        mark = F.lit("Tribunal de procedencia") if label == "Tribunal" else F.lit(label)
        mark = F.when(F.col("conv_id") % 2 == 0, F.lit("Fecha de sentencia\nrecurrida")).otherwise(F.lit(label)) if label.endswith("recurrida") else mark
        mark = F.when(F.col("conv_id") % 2 == 0, F.lit(label)).otherwise(mark) if label == "Tribunal" else mark
        return [mark, colon, F.lit("\n"), F.expr(value), F.lit("\n")]

    fields = [x for label, value in [*_CARD, *_PARTIES] for x in line(label, value)]
    text = F.concat(*fields, F.lit("Fallo"), colon, F.lit("\nNo ha\nlugar\nHechos relevantes"), colon, F.lit("\nx"), F.col("entries"), F.lit("\nSentencia CERTIFICACIÓN\nCONSIDERANDO: "), "first", F.lit("\nPOR TANTO: "), "last")
    return per.select("conv_id", text.alias("text"), F.concat(F.lit("/files/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"))


_CARD_SQL = ", ".join(f"{v} AS {k}" for k, v in zip(("sentencia_id", "tipo_proceso", "subtipo_proceso", "magistrado", "materia", "fecha_resolucion", "recurrente", "recurrido", "tribunal", "fecha_sentencia_recurrida"), (v for _, v in [*_CARD, *_PARTIES]), strict=True))


@query(f"SELECT conv_id, {_CARD_SQL}, 'No ha lugar' AS fallo FROM (SELECT DISTINCT conv_id FROM conversations)")
def card_fields(t: Tables) -> DataFrame:
    """All eleven fields of a card, whatever its layout."""
    return _records(t).select("conv_id", *(c.alias(k) for k, c in card(F.col("text")).items()))


_SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_ENTRIES = "u AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)"


@query(
    f"""WITH {_ENTRIES} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry, 'Cat ' || turn % 3 AS categoria, {_SQ.format("'Cat ' || turn % 3 || ' ¿' || split_part(text, '?', 1)")} || '?' AS problema,
  {_SQ.format('reply')} AS respuesta, regexp_replace(regexp_replace(reply, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS consideraciones, 1::BIGINT AS laws, 'Ley ' || conv_id % 9 AS ley, turn::VARCHAR AS articulo, NULL::VARCHAR AS sub_indice FROM u WHERE role = 'user'"""
)
def thesaurus_entries(t: Tables) -> DataFrame:
    """The thesaurus entries of every record: category, problem, answer, the court's views without page marks, the laws in whole triples."""
    rows = _records(t).select("conv_id", F.posexplode(thesaurus(F.col("text"))).alias("pos", "e"))
    law = F.get("e.legislaciones", F.lit(0))
    return rows.select("conv_id", (F.col("pos") + 1).cast("long").alias("entry"), "e.categoria", "e.problema", "e.respuesta", "e.consideraciones", F.size("e.legislaciones").cast("long").alias("laws"), law["ley"].alias("ley"), law["articulo"].alias("articulo"), law["sub_indice"].alias("sub_indice"))


_ONE = "SELECT '{}' AS name, count(DISTINCT {}) AS n FROM c"
_TABLES_SQL = " UNION ALL ".join(
    [
        *(_ONE.format(n, x) for n, x in {"tipo_proceso": "conv_id % 4", "magistrado": "conv_id % 7", "tribunal": "conv_id % 3", "materia": "conv_id % 5", "sentencias": "conv_id", "sentencias_materias": "conv_id", "documentos_pdf": "conv_id"}.items()),
        "SELECT 'personas_entidades', count(DISTINCT conv_id % 6) + count(DISTINCT conv_id % 5) FROM c",
        "SELECT 'tesauro', count(*) FROM u WHERE role = 'user'",
        "SELECT 'legislacion', count(DISTINCT (conv_id % 9, turn)) FROM u WHERE role = 'user'",
        "SELECT 'sentencias_legislacion', count(DISTINCT (conv_id, turn)) FROM u WHERE role = 'user'",
    ]
)


@query(f"WITH {_ENTRIES}, c AS (SELECT DISTINCT conv_id FROM conversations) {_TABLES_SQL}")
def record_tables(t: Tables) -> DataFrame:
    """Rows of the tables that records are taken apart into, passages aside."""
    records = written(parse_records(_records(t)))
    tables = {n: df for n, df in decompose(records, "path").items() if n != "fragmentos_texto"}
    counts = reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in tables.items()))
    out = written(counts)
    discard(records)
    return out


@query(
    f"""WITH {_ENTRIES}, c AS (SELECT DISTINCT conv_id FROM conversations) SELECT 'Corte ' || conv_id % 5 AS name, 'institución_pública' AS kind, count(*) AS records FROM c GROUP BY ALL
UNION ALL SELECT 'Ana ' || conv_id % 6, 'persona', count(*) FROM c GROUP BY ALL"""
)
def record_parties(t: Tables) -> DataFrame:
    """The parties with their kind and how many records name them."""
    tables = decompose(parse_records(_records(t)))
    people, cases = tables["personas_entidades"], tables["sentencias"]
    ids = cases.select(F.explode(F.array("recurrente_id", "recurrido_id")).alias("id"))
    return ids.join(people, "id").groupBy(F.col("nombre").alias("name"), F.col("tipo").alias("kind")).agg(F.count(F.lit(1)).alias("records"))

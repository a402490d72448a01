import html
import re
import unicodedata
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import chunking as C
from quillon.functions import extract as X
from quillon.functions import rules as L
from quillon.functions import text as N
from quillon.functions import vectors as V


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_scalars(spark):
    c = F.col("c0")
    assert one(spark, N.normalize_key(c), "  ÁRBOL   Ñandú ") == "arbol nandu"
    assert one(spark, N.normalize_key(c), "   ") is None
    assert one(spark, N.accent_fold(c), unicodedata.normalize("NFD", "acción ñ")) == "accion n"
    assert one(spark, N.latin_fold(c), "Ñandú É") == "Nandu E"
    assert one(spark, N.strip_html(c), "<p>a &lt;b&gt;</p><script>x</script>c").split() == ["a", "c"]
    assert one(spark, N.clean_text(c), None) == ""
    assert one(spark, N.tokens(c), "acción A_1 b") == ["acci", "n", "a_1", "b"]
    assert one(spark, N.tokens(c, N.STOPWORDS_ES), "la casa de x") == ["casa", "x"]
    assert one(spark, N.sanitize(c), "CONSIDERANDO (1): Que la pala-\nbra  si\ngue") == "la palabra si gue"
    assert one(spark, N.clean_string(c), " -- ") is None
    assert one(spark, N.safe_filename(c, 8), 'a/b:c"d e f g') == "a_b_c_d "[:8]
    assert [one(spark, N.parse_date_text(c), v) for v in ("05/02/2020", "5-2-2020", "2020")] == ["2020-02-05", "2020-2-5", "2020"]
    assert str(one(spark, N.parse_date(c), "05/02/2020")) == "2020-02-05" and one(spark, N.parse_date(c), "45/02/2020") is None
    assert str(one(spark, N.file_date(c), "x_FRes_09_11_2019.pdf")) == "2019-11-09" and one(spark, N.file_date(c), "x.pdf") is None
    assert [one(spark, N.word_count(c), v) for v in ("", " a b  c ")] == [0, 3]
    assert one(spark, N.uuid5(uuid.NAMESPACE_DNS.hex, c, F.lit(None).cast("string")), "ley") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "ley|"))


def test_shingles_and_near_key(spark):
    t = F.split("c0", " ")
    assert one(spark, N.shingles(t), "a b c") == ["a b c"]
    assert len(one(spark, N.shingles(t), "a b c d e f")) == 2
    assert one(spark, N.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    twelve = " ".join(map(str, range(12)))
    assert one(spark, N.near_key(t), twelve) != one(spark, N.near_key(t), twelve + " 12")


def test_rules(spark):
    c = F.col("c0")
    assert [one(spark, L.first_rule(c), v) for v in ("No ha lugar", "Infundada la queja", "Confirma inadmisibilidad", "xyz", "", None)] == ["ADMITIDO", "ADMITIDO", "DENEGADO", "OTRO", "DESCONOCIDO", "DESCONOCIDO"]
    assert one(spark, L.first_rule(c, longest_match=True), "No ha lugar") == "DENEGADO"
    counts = L.keyword_counts(c)
    assert one(spark, counts["kw_ha_lugar"], "no ha lugar y ha lugar") == 1
    assert one(spark, L.upper_ratio(c), "ABc") == pytest.approx(2 / 3)


def test_extraction(spark):
    card = "Sentencia AA-1\nTipo de proceso:\nAmparo\nRecurrente:\nUno\nDos\nRecurrido:\nTres\nTribunal:\nCorte\nFecha de sentencia\nrecurrida:\n01/02/2003\nFallo:\nSin\nlugar\nHechos relevantes:\nx"
    got = {k: one(spark, v, card) for k, v in X.key_values(F.col("c0")).items()}
    assert got["sentencia_id"] == "AA-1" and got["recurrente"] == "Uno Dos" and got["fecha_sentencia_recurrida"] == "01/02/2003" and got["fallo"] == "Sin lugar" and got["materia"] is None
    assert one(spark, X.between(F.col("c0"), "CONSIDERANDO", ["POR TANTO", "FALLA"]), "x Considerando a FALLA b") == "Considerando a "
    assert one(spark, X.between(F.col("c0"), "CONSIDERANDO", []), "x") is None
    law = "Pre\nCAPÍTULO I\nARTÍCULO 1.- uno\nARTÍCULO 2.- dos\nCAPÍTULO II\nArtículo 3.- tres"
    assert [a.numero for a in one(spark, X.articles(F.col("c0")), law)] == ["1", "2", "3"]
    assert [(c.etiqueta, "ARTÍCULO 1" in c.cuerpo) for c in one(spark, X.chapters(F.col("c0")), law)] == [("CAPÍTULO I", True), ("CAPÍTULO II", False)]
    assert one(spark, X.document_title(F.col("c0")), "La Gaceta\n12 34\nUna primera linea\nx") == "Una primera linea"
    assert one(spark, X.document_title(F.col("c0")), "12\n") == "[SIN-NOMBRE]"
    assert one(spark, X.header_lines(F.col("c0")), "HECHOS PROBADOS\nuna frase.\n12/3\nPágina 1") == ["Hechos probados"]


def test_vectors(spark):
    a, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, a)) == 1.0 and one(spark, V.cosine(a, z)) is None and one(spark, V.is_zero(z))
    assert one(spark, V.parse_vector(F.col("c0")), "[1,2.5]") == [1.0, 2.5] and one(spark, V.parse_vector(F.col("c0")), "[]") is None


def test_sliding_chunks(spark):
    words = lambda n: " ".join(f"w{i:04d}" for i in range(n))
    sizes = {n: [len(x.split()) for x in one(spark, C.sliding_chunks(F.col("c0")), words(n))] for n in (5, 300, 301, 510)}
    assert sizes == {5: [], 300: [300], 301: [300, 51], 510: [300, 260, 10]}
    assert one(spark, C.sliding_chunks(F.col("c0")), None) == []


@given(st.lists(st.integers(1, 30), max_size=30), st.sampled_from(sorted(C.PRESETS)))
def test_sentence_chunks_cover_everything(lengths, preset):
    target, overlap, strict, cut = C.PRESETS[preset]
    target, overlap, cut = target // 10, overlap // 10, cut // 10
    sentences = [" ".join([f"s{i}"] * n) + "." for i, n in enumerate(lengths)]
    chunks = C.pack_sentences(" ".join(sentences), target, overlap, strict, cut)
    seen = " ".join(chunks)
    assert all(f"s{i}" in seen for i in range(len(lengths)))
    first = [int(c.split()[0].strip(".")[1:]) for c in chunks]
    assert first == sorted(first)
    assert all(len(c.split()) <= max(target, *lengths) + max([overlap, *lengths]) for c in chunks)


def test_titles_laws_and_entities(spark):
    """Every pattern of a name; folded law words; neighbours that make a law's name together; all character references; NFKC."""
    title = X.document_title(F.col("c0"))
    assert one(spark, title, "La Gaceta\nNORMA TECNICA DE CALIDAD DEL AGUA\nx").startswith("NORMA TECNICA DE CALIDAD")
    assert one(spark, title, "x\nRESOLUCIÓN GENERAL SOBRE TARIFAS POSTALES\n") == "RESOLUCIÓN GENERAL SOBRE TARIFAS POSTALES"
    assert one(spark, title, "DECRETO No. 12-2020 sobre algo\n").startswith("DECRETO No")
    assert one(spark, title, "La primera imprenta llegó a Honduras en 1829\nUna primera linea\n") == "Una primera linea"
    law = lambda *v: one(spark, X.law_name(*map(F.lit, v)), "")
    assert law("Código Penal", "Artículo 5") == "codigo penal" and law("Convención  Americana", None) == "convencion americana"
    assert law("decreto", "acuerdo") is None and law("Código", "de Trabajo Ley 9") == "codigo de trabajo ley 9" and law("co", "digo") is None
    assert one(spark, X.article_hint(F.lit("ley"), F.lit("Artículo 12B"), F.lit(None).cast("string")), "") == "12b"
    assert one(spark, N.clean_text(F.col("c0")), "<p>Caf&eacute; &amp; ﬁn&#233; &hellip;</p>") == "café & finé ..."


def test_keyword_vector(spark):
    """A flag and a count for all 18 groups, then length, line breaks and capitals; the other text where the first is blank."""
    v = L.keyword_vector(F.col("c0"), F.lit("CON LUGAR\nnulidad"))
    assert len(v) == 18 * 2 + 3 and one(spark, v["kw_nulidad_count"], " ") == 1 and one(spark, v["texto_linebreaks"], "") == 1
    assert one(spark, v["kw_ha_lugar_count"], "No ha lugar; ha lugar") == 1 and one(spark, v["kw_casacion_flag"], "Casación") == 1
    assert one(spark, v["texto_char_len"], " abc ") == 3 and one(spark, v["texto_upper_ratio"], "aB1") == 0.5


def test_references_end_with_a_semicolon_and_most_texts_skip_python(spark):
    """Without a semicolon a reference stays, as in SQL; the JVM's way and Python's agree."""
    c = F.col("c0")
    assert [one(spark, N.strip_html(c), v) for v in ("a &amp</title>b", "&amp;amp;lt; &eacute;&#x41;&amp", "&notit; &unknown; &notin;")] == ["a &amp b", "&amp;lt; éA&amp", "&notit; &unknown; ∉"]
    texts = ["plain é ñ", "hard\u00a0space&nbsp;&lt;b&gt;x", "<ScRipt >y</script>ﬁne ²<i>z</i>", "e\u0301 &#65;\x07", "&hellip; <style>q</style>Ω", None]
    for text in texts:
        x = "" if text is None else text
        for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", "<[^>]+>", r"[\x00-\x1f\x7f]"):
            x = re.sub(pattern, " ", unicodedata.normalize("NFKC", html.unescape(x)) if pattern.startswith("[") else html.unescape(x))
        assert one(spark, N.clean_text(c), text) == re.sub(r"\s+", " ", x).strip(" ").lower(), text


def test_shingle_hashes(spark):
    """As many distinct shingles as the general form; a shingle is known by a number."""
    c = F.col("c0")
    for text in ("Hello, wörld_1 -- a  b c d e f g a b c d e", "", "...", "one two", "a b c d e a b c d e a b c d e"):
        hashes = one(spark, N.shingle_hashes(N.tokens(c)), text)
        assert len(hashes) == len(one(spark, N.shingles(N.tokens(c)), text)) and all(isinstance(h, int) for h in hashes)


def test_sentence_chunks_are_passed_on_as_they_come():
    """A worker holds about HELD characters of chunks, not those of a whole batch; texts without chunks give no rows."""
    import pyarrow as pa

    from quillon.functions import chunking as C

    texts = [None, "", *(f"Sentence number {i} says this. " * (i % 900) for i in range(700)), "  "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for preset, parameters in C.PRESETS.items():
        out = list(C._sentences(preset)([batch]))
        assert len(out) > 5 and all(sum(map(len, b.column(2).to_pylist())) < 2 * C.HELD for b in out)
        got = [tuple(r.values()) for b in out for r in b.to_pylist()]
        assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(C.pack_sentences(t, *parameters), 1)]

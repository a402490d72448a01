"""Encoders that fail, the diagnostic and reports on odd input."""

from pyspark.sql import functions as F

from quillon.operators import dedup, ml, search
from quillon.operators.diagnostic import WEIGHTS, diagnostic


def test_an_encoder_that_fails(spark):
    """A batch that fails goes row by row, a row that fails by its first half, else it stays without a vector."""

    def encoder(texts):
        if any(len(t) > 6 or t == "bad" for t in texts):
            raise MemoryError
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "abcdefgh"), (3, None), (4, "x" * 40), (5, "bad"), (6, "de")], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in ml.encode_with(rows, encoder, batch=3).collect()}
    assert got == {1: [3.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0], 4: None, 5: [1.0, 1.0], 6: [2.0, 1.0]}


def test_rerank_by_a_batch_scorer(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "a"), (3, "aaa")], "id long, text string")
    assert [r.id for r in search.rerank(rows, lambda s: s.str.len().astype(float)).orderBy(F.desc("score")).collect()] == [3, 1, 2]


def test_diagnostic_of_an_empty_corpus(spark):
    passages = spark.createDataFrame([], "id long, text string, embedding array<float>")
    records = spark.createDataFrame([], "text string, embedding array<float>, label string, number string, court int")
    got = {r.dimension: (r.score, r.band) for r in diagnostic(passages, records, ["label", "court"]).collect()}
    assert set(got) == {*WEIGHTS, "global"} and got["coverage"] == (0.0, "DEFICIENTE") and got["text"][0] == 100 and got["volume"][0] == 20 and got["global"] == (27.0, "DEFICIENTE")


def test_report_deltas_of_queries_that_one_side_lacks(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id long, mean_sim double, relevance double")
    got = {r.query_id: (r.mean_sim_delta, r.relevance_before, r.relevance_delta) for r in search.report_deltas(make([(1, 0.5, 100.0), (2, 0.2, 20.0)]), make([(1, 0.75, 80.0), (3, 0.1, 0.0)])).collect()}
    assert got == {1: (0.25, 100.0, -20.0), 2: (-0.2, 20.0, -20.0), 3: (0.1, 0.0, 0.0)}


def test_basis_from_links_or_citations(spark):
    rows = spark.createDataFrame([(1, "ver art. 5 del Codigo Civil"), (2, "según Artículo 12 Ley Penal Nueva y arts 7 de la Constitucion."), (3, "nada"), (4, None)], "case long, text string")
    links = spark.createDataFrame([(1, "CP", 9), (1, "CP", 9), (1, "CC", 3)], "case long, law string, article int")
    articles = spark.createDataFrame([("3", "Z", "z3"), ("3", "CC", "tres"), ("7", "Q", "siete")], "number string, law string, content string")
    got = {r.case: (r.basis, r.norm_law, r.norm) for r in search.with_norm(search.with_basis(rows, links, "case"), articles).collect()}
    assert got[1] == ("CC (Art. 3), CP (Art. 9)", "CC", "tres") and got[3] == got[4] == (None, None, None) and got[2] == ("Art. 7 Constitucion", "Q", "siete")


def test_pairs_beyond_the_limit(spark):
    rows = spark.createDataFrame([(i, "same words in all of them but one " + "x" * (i == 59)) for i in range(60)], "doc_id long, text string")
    p = dedup.prepared(rows).cache()
    assert dedup.near_pairs(p).count() == 40 * 39 // 2 and dedup.near_pairs(p, most=None).where("a < 40").count() > 40 * 39 // 2

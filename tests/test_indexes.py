"""Kept indexes against the scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import annindex, search, textindex
from quillon.sources import versions


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_index_gives_the_scores_of_the_scan(spark, sf, tmp_path):
    root = f"file:{tmp_path}/i"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "solo the and tion that")], "doc_id long, text string"))
    old = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the the and "), "text")).otherwise(F.col("text")))
    textindex.add_texts(root, old)
    textindex.add_texts(root, docs.where("doc_id % 3 = 0"))
    for step in range(2):
        for query in (["the"], ["the", "and", "The"], ["tion", "nowhere", "solo"]):
            assert _rows(textindex.bm25_search(spark, root, query, 1000)) == _rows(search.bm25(docs, [q.lower() for q in query], 1000, "doc_id"))
            assert _rows(textindex.cover_search(spark, root, query)) == _rows(search.cover_density(docs, [q.lower() for q in query], "doc_id"))
        if not step:
            assert len(versions.current(spark, root)[1]) == 4
            textindex.compact(spark, root)
    assert set(versions.current(spark, root)[1]) == {"postings0", "texts0"}
    plan = textindex.postings_of(spark, root, ["the", "and"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    with pytest.raises(FileNotFoundError):
        textindex.bm25_search(spark, f"file:{tmp_path}/none", ["the"], 5)


def test_text_index_with_stems(spark, tmp_path):
    root = f"file:{tmp_path}/s"
    stem = lambda c: F.regexp_replace(c, "(es|s)$", "")
    docs = spark.createDataFrame([(1, "Leyes y ley"), (2, "la ley"), (3, "nada")], "doc_id long, text string")
    textindex.add_texts(root, docs, stem=stem)
    assert {r.doc_id for r in textindex.bm25_search(spark, root, ["LEYES"], 5, stem=stem).collect()} == {1, 2}
    assert _rows(textindex.postings_of(spark, root, ["ley"]).select("id", "tf", "places")) == [(1, 2, [0, 2]), (2, 1, [1])]


def _vectors(spark, x):
    return spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("clustered", [False, True])
def test_vector_index(spark, tmp_path, clustered, monkeypatch):
    """Recall against exact search, whole vectors compared for few rows, odd dimensions, equal and missing vectors, cells in several files."""
    rng, root = np.random.default_rng(4), f"file:{tmp_path}/v"
    x = rng.normal(size=(900, 13))
    if clustered:
        x = x * 0.3 + rng.normal(size=(12, 13))[rng.integers(0, 12, 900)]
    x[800:] = x[0]  # a ninth of all rows are one vector
    df = _vectors(spark, x).unionByName(spark.createDataFrame([(2000, None), (2001, [0.0] * 13)], "vec_id long, embedding array<float>"))
    monkeypatch.setattr(annindex, "FILE", 40)
    told = annindex.build(root, df, recall=0.92)
    assert told["rows"] == 900 and told["cells"] == 30 and told["recall"] >= 0.9
    queries = df.where("vec_id % 20 = 7 or vec_id = 2000")
    asked = df.where("vec_id % 20 = 7").count()
    exact = search.knn(df, queries, 5).select("query_id", "id")
    found = annindex.search(spark, root, queries, 5)
    assert found.join(exact, ["query_id", "id"]).count() >= 0.9 * exact.count()
    sims = {(r.query_id, r.id): r.sim for r in search.knn(df, queries, 900).collect()}
    assert all(abs(sims[r.query_id, r.id] - r.sim) < 2e-6 for r in found.collect())
    assert annindex.shortlisted(spark, root, queries).count() <= 0.33 * asked * 900
    assert spark.read.parquet(f"{root}/{versions.current(spark, root)[1]['codes']}").count() == 900
    if clustered:
        assert told["probes"] <= 10
        assert "PartitionFilters: [cell" in annindex.shortlisted(spark, root, queries, probes=2)._jdf.queryExecution().toString()


def test_vector_index_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        annindex.build(f"file:{tmp_path}/e", _vectors(spark, np.zeros((2, 3))))


def test_nearest_holds_slices_and_k_rows(spark, monkeypatch):
    """Ties, own rows and zero vectors as by brute force, however small the slices; what is held is k rows a query."""
    import numpy as np

    from quillon.operators import search as S

    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, (300, 4)).astype(float)  # many equal vectors, some zero
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    length = np.linalg.norm(x, axis=1)
    want = set()
    for q in range(0, 300, 10):
        sims = np.round(x @ x[q] / np.maximum(length * length[q], 1e-300), 6)
        order = [i for i in np.lexsort((np.arange(300), -sims)) if i != q and length[i]][:5]
        want |= {(q, int(i), float(sims[i]) + 0.0, n + 1) for n, i in enumerate(order)}
    monkeypatch.setattr(S, "SLICE", 7)
    got = {(r.query_id, r.id, r.sim + 0.0, r["rank"]) for r in S.knn(df, df.where("vec_id % 10 = 0"), 5).collect()}
    assert got == want
    best = S.Best(2, 3)
    for a in range(0, 3000, 100):
        best.add(np.arange(2), np.arange(a, a + 100), rng.random((2, 100)))
    assert len(best.id) == 6


def test_words_are_grouped_where_the_text_is(spark, tmp_path, monkeypatch):
    """Postings of each text as counted by hand, null and empty texts too, whatever the slice; no shuffle of words comes before them."""
    from quillon.operators import textindex as X

    monkeypatch.setattr(X, "TEXTS", 2)
    texts = {1: "b a b", 2: None, 3: "", 4: "A a c", 5: "b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    X.add_texts(str(tmp_path / "t"), df)
    got = {(r.term, r.id, r.dl, r.tf, tuple(r.places)) for r in X.postings_of(spark, str(tmp_path / "t"), ["a", "b", "c"]).collect()}
    assert got == {("a", 1, 3, 1, (1,)), ("b", 1, 3, 2, (0, 2)), ("a", 4, 3, 2, (0, 1)), ("c", 4, 3, 1, (2,)), ("b", 5, 1, 1, (0,))}
    schema = "id long, dl int, posts array<struct<term: string, places: array<int>>>"
    toks = spark.createDataFrame([(1, 2, ["a", None])], "id long, dl int, toks array<string>")
    assert [[(p.term, p.places) for p in r.posts] for r in toks.mapInArrow(X._grouped, schema).collect()] == [[("a", [0])]]

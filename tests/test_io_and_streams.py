import json

from pyspark.sql import functions as F

from quillon.sources import readers, sinks
from quillon.streaming import jobs


def test_manifest_skips_broken_lines(spark, tmp_path):
    good = {"source": "s", "title": "t", "page_number": 1, "pdf_url": "u1", "local_path": "p1", "size_bytes": 5}
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"pdf_url": "u2", "local_path": "p2"})]))
    df = readers.manifest(spark, str(tmp_path / "m.jsonl"))
    assert df.count() == 2
    found = spark.createDataFrame([("u1", "new"), ("new", "p2"), ("u9", "p9")], "pdf_url string, local_path string")
    assert [r.pdf_url for r in sinks.new_manifest_rows(df, found).collect()] == ["u9"]


def test_file_pairs_and_binary_text(spark, tmp_path):
    for name, raw in {"A1_pag1.pdf": b"%PDF one", "A1_FRes_01_02_2020_TipoCertificado.pdf": b"%PDF two", "B2_pag9.pdf": b"junk"}.items():
        (tmp_path / name).write_bytes(raw)
    pairs = {r.base: (bool(r.card), bool(r.certificate)) for r in readers.file_pairs(spark, str(tmp_path)).collect()}
    assert pairs == {"A1": (True, True), "B2": (True, False)}
    texts = {r.path[-11:]: r.text for r in readers.binary_text(spark, str(tmp_path), lambda b: b.decode()[5:], "*pag*.pdf", b"%PDF").collect()}
    assert texts == {"A1_pag1.pdf": "one", "B2_pag9.pdf": None}


def test_export_swap_truncate(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.export(spark.range(5), path)
    try:
        sinks.export(spark.range(5), path)
        raise AssertionError("overwrote")
    except Exception as e:  # noqa: BLE001
        assert "exists" in str(e).lower()
    sinks.swap(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3
    sinks.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0
    assert sinks.with_search_column(spark.createDataFrame([("La Acción de la ley",)], "t string"), "t").first()["lexemes"] == ["accion", "ley"]


def test_resumable_vectors(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = spark.createDataFrame([(i, f"text number {i}") for i in range(6)], "doc_id long, text string")
    rows.where("doc_id < 3").write.parquet(src)
    jobs.vectorize(spark, src, out, state, rows.schema)
    rows.where("doc_id >= 3").write.mode("append").parquet(src)
    jobs.vectorize(spark, src, out, state, rows.schema)
    jobs.vectorize(spark, src, out, state, rows.schema)
    got = spark.read.parquet(out)
    assert got.count() == got.select("doc_id").distinct().count() == 6 and got.where("size(embedding) = 64").count() == 6


def test_stream_dedup_agrees_with_batch(spark, sf, tmp_path):
    from quillon.operators.dedup import greedy, prepared

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.coalesce(1).write.parquet(str(tmp_path / "src"))
    rows = jobs.incremental_dedup(jobs.stream(spark, str(tmp_path / "src"), docs.schema))
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.doc_id: r.duplicate_of for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.duplicate_of for r in greedy(prepared(docs)).collect()}


def test_stream_dedup_beyond_forty_representatives(spark, tmp_path):
    """A row is compared with every representative of its key, in one run and in the next."""
    head, tail = " ".join(f"h{i}" for i in range(12)), " ".join(f"t{i}" for i in range(12))
    middle = lambda k, own: " ".join([f"m{k}x{i}" for i in range(48)] + own + [f"m{k}x{i}" for i in range(48, 95)])
    make = lambda start, own: spark.createDataFrame([(start + k, f"{head} {middle(k, [f'{own}{k}'])} {tail}") for k in range(70)], "doc_id long, text string").coalesce(1)
    got = {}
    for run, rows in enumerate([make(0, "a").unionByName(make(100, "b")).coalesce(1), make(200, "c")]):
        rows.write.mode("append").parquet(str(tmp_path / "src"))
        found = jobs.incremental_dedup(jobs.stream(spark, str(tmp_path / "src"), rows.schema))
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = {r.doc_id: r.duplicate_of for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert len(got) == 140 + 70 * run
    assert got == {k: None for k in range(70)} | {100 + k: k for k in range(70)} | {200 + k: k for k in range(70)}


def test_leaders_find_the_first_near_one():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (6, 100), np.int64)
    leaders, sets = jobs.Leaders([], []), []
    for i in range(400):
        sh = base[i % 6].copy()
        sh[rng.choice(100, i % 9, replace=False)] = rng.integers(-(2**63), 2**63 - 1, i % 9, np.int64)
        n, own = 104 + i % 13, set(sh.tolist())
        want = next((j for j, (m, s) in enumerate(sets) if abs(m - n) <= 5 and len(own & s) / len(own | s) >= 0.9), None)
        assert leaders.first(n, sh) == want
        leaders.add(n, sh)
        sets.append((n, own))


def test_failure_runs(spark):
    df = spark.createDataFrame([(1, i, i in (2, 3, 4, 8)) for i in range(10)], "group int, at int, bad boolean")
    assert [tuple(r) for r in jobs.failure_runs(df, "at", "bad", 3).collect()] == [(1, 2, 4, 3)]


def test_two_json_shapes(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.json").write_text('{"documentos": [{"ref": "1"}, {"ref": "2"}]}')
    (tmp_path / "b.json").write_text('[{"ref": "3"}]')
    df = readers.json_documents(spark, str(tmp_path), "documentos", T.StructType([T.StructField("ref", T.StringType())]))
    assert sorted(r.ref for r in df.collect()) == ["1", "2", "3"]
    assert readers.seed(spark, readers.DOCUMENT_TYPES).count() == 9
    spark.range(1).createOrReplaceTempView("some_view")
    assert readers.catalog(spark).where(F.col("table") == "some_view").count() == 1

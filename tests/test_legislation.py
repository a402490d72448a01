"""Reconciliation in runs, norm collections, and tables that are published together."""

import json

import pytest

from quillon.operators import norms, reconcile as R
from quillon.sources import readers, versions


def _mapping(spark, rows):
    return spark.createDataFrame(rows, "legislacion_id long, ley_id long, articulo_id long, alias_detectado string, confianza double, estado_match string, notas string")


def test_reference_to_law_to_article(spark):
    refs = spark.createDataFrame(
        [(1, "Código Civil", "Artículo 5", None), (2, "codigo  civil", "99", "5B"), (3, "Ley", "del Agua", "7"), (4, "Código Civil reformado", "8", None), (5, "Estatuto", "5", None), (6, None, None, None), (7, "Código Penal", "3", None)],
        "legislacion_id long, nombre_ley string, articulo string, sub_indice string",
    )
    aliases = spark.createDataFrame([(10, "codigo civil"), (20, "ley del agua"), (30, "estatuto uno"), (31, "estatuto dos"), (40, "codigo penal"), (41, "codigo penal")], "ley_id long, alias_norm string")
    articles = spark.createDataFrame(
        [(10, 100, "5", "Artículo 5", False, 1), (10, 101, "5", "Artículo 5", True, 9), (10, 102, "5", "Artículo 5", True, 8), (10, 103, "5b", "Art. 5B", None, None), (20, 200, None, "ARTÍCULO 7", True, 1), (40, 400, "3", None, True, 1)],
        "ley_id long, articulo_id long, articulo_numero string, articulo_etiqueta string, es_vigente boolean, orden int",
    )
    got = {r.legislacion_id: (r.ley_id, r.articulo_id, r.confianza, r.estado_match, r.notas) for r in R.reconcile(refs, aliases, articles).collect()}
    assert got == {
        1: (10, 102, 0.99, R.FOUND, "article_hint=5"), 2: (10, 103, 0.99, R.FOUND, "article_hint=5b"), 3: (20, 200, 0.98, R.FOUND, "article_hint=7"), 4: (10, None, 0.75, R.LAW, "article_hint=8"),
        5: (None, None, 0.0, R.PENDING, "article_hint=5"), 6: (None, None, 0.0, R.PENDING, None), 7: (None, None, 0.0, R.PENDING, "article_hint=3"),
    }


def test_references_are_read_once_and_dealt_by_their_number(spark, monkeypatch):
    """Whatever files they come from, references are parsed once, in tasks that follow their number."""
    from pyspark.sql import functions as F

    from quillon.operators import relational

    read, plans, real = spark.sparkContext.accumulator(0), [], R.written

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    def kept(df):
        plans.append(df._jdf.queryExecution().toString())
        return real(df)

    monkeypatch.setattr(R, "written", kept)
    monkeypatch.setattr(relational, "TASK_ROWS", 8)
    refs = spark.range(90).coalesce(1).select(F.col("id").alias("legislacion_id"), seen(F.concat(F.lit("Ley "), (F.col("id") % 3).cast("string"))).alias("nombre_ley"), F.lit("5").alias("articulo"), F.lit(None).cast("string").alias("sub_indice"))
    aliases = spark.createDataFrame([(10, "ley 0"), (20, "ley 1"), (30, "ley 2 del agua")], "ley_id long, alias_norm string")
    articles = spark.createDataFrame([(10, 100, "5", None, True, 1)], "ley_id long, articulo_id long, articulo_numero string, articulo_etiqueta string, es_vigente boolean, orden int")
    got = {r.legislacion_id: (r.ley_id, r.articulo_id, r.confianza) for r in R.reconcile(refs, aliases, articles).collect()}
    assert got == {i: [(10, 100, 0.99), (20, None, 0.99), (30, None, 0.75)][i % 3] for i in range(90)}
    assert read.value == 90 and "hashpartitioning(legislacion_id" in plans[0] and ", 12), REPARTITION_BY_NUM" in plans[0]


def test_a_later_run_changes_only_what_got_better(spark, tmp_path):
    old = [(1, 5, 50, "a", 0.99, R.FOUND, None), (2, 5, None, "b", 0.75, R.LAW, None), (3, None, None, None, 0.0, R.PENDING, None), (4, 6, None, "d", 0.99, R.LAW, "old")]
    new = [(1, 5, None, "x", 0.99, R.LAW, None), (2, 5, None, "y", 0.99, R.LAW, None), (3, 7, 70, "z", 0.98, R.FOUND, None), (4, 6, None, "w", 0.99, R.LAW, "new"), (5, 8, None, "v", 0.75, R.LAW, None)]
    got = {r.legislacion_id: (r.articulo_id, r.alias_detectado) for r in R.merge_mapping(_mapping(spark, old), _mapping(spark, new)).collect()}
    assert got == {1: (50, "a"), 2: (None, "y"), 3: (70, "z"), 4: (None, "d"), 5: (None, "v")}
    uses = spark.createDataFrame([(9, 1), (9, 3), (8, 3), (8, 2)], "sentencia_id long, legislacion_id long")
    links = R.article_links(_mapping(spark, old), uses)
    merged = R.merge_links(links, R.article_links(_mapping(spark, [*new, (1, 5, 50, "again", 0.99, R.FOUND, None)][1:]), uses))
    assert sorted(tuple(r) for r in merged.select("sentencia_id", "articulo_id", "alias_detectado", "confianza").collect()) == [(8, 70, "z", 0.98), (9, 50, "again", 0.98), (9, 70, "z", 0.98)]


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """A load that dies at any step leaves the whole old state."""
    root = f"file:{tmp_path}/t"
    old = {"a": spark.range(3), "b": spark.range(4)}
    assert versions.current(spark, root) == (0, {}) and versions.publish(spark, root, old) == 1
    steps = {"write a": 0, "write b": 1}
    real = versions._point
    for after in [*steps.values(), "pointer", "rename"]:
        written = []

        class Dies(RuntimeError):
            pass

        def table(n, after=after, written=written, dies=Dies):
            df = spark.range(n)
            if isinstance(after, int):
                from pyspark.sql import functions as F

                if len(written) == after:
                    df = df.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
                written.append(n)
            return df

        def dies(spark, root, number, folders, after=after):
            if after == "rename":
                fs, temp = versions.hadoop(spark, f"{root}/{versions.POINTERS}/_half.json")
                fs.create(temp).close()
            raise RuntimeError("lost")

        with monkeypatch.context() as m:
            if not isinstance(after, int):
                m.setattr(versions, "_point", dies)
            with pytest.raises(Exception, match="lost"):
                versions.publish(spark, root, {"a": table(30), "b": table(40)})
        assert [versions.load(spark, root, n).count() for n in "ab"] == [3, 4] and versions.current(spark, root)[0] == 1
    assert versions._point is real
    assert versions.publish(spark, root, {"a": versions.load(spark, root, "a").where("id > 0"), "c": spark.range(1)}) == 2
    assert [versions.load(spark, root, n).count() for n in "abc"] == [2, 4, 1] and versions.load(spark, root, "a", 1).count() == 3
    with pytest.raises(OSError, match="another writer"):
        versions._point(spark, root, 2, {})
    assert versions.vacuum(spark, root) >= 5 and [versions.load(spark, root, n).count() for n in "abc"] == [2, 4, 1]


def test_norm_collection_from_json(spark, tmp_path):
    node = {"tipo_nodo": "libro", "etiqueta": "Libro I", "nodos": [{"ref": "n1", "tipo_nodo": "articulo", "etiqueta": "Artículo 1", "texto": " Uno.\n Dos. ", "orden": 7}, {"tipo_nodo": "articulo", "etiqueta": "Artículo 2", "texto": ""}]}
    first = {"ref": "A", "tipo_documento": "codigo", "nombre_oficial": "Código Uno", "sigla": "CU", "aliases": ["código  uno", "El Código"], "documento_padre_ref": "B", "legislacion": {"nombre": "Civil"}}
    first["versiones"] = [{"ref": "v1", "version_label": "2020", "texto_consolidado": "Libro I. Todo. " * 3, "estructura": [node], "fuentes": [{"codigo": "gaceta", "fuente_url": "u"}, {"codigo": "gaceta", "fuente_url": "u2", "ruta_archivo": "r", "es_principal": True}]}]
    first["relaciones"] = [{"tipo_relacion": "reforma", "documento_destino_ref": "B", "version_origen_ref": "v1", "nodo_origen_ref": "n1", "nodo_destino_ref": "zz"}, {"tipo_relacion": "x", "documento_destino_ref": "none"}, {"tipo_relacion": "y", "documento_destino_id": "given"}]
    second = {"ref": "B", "tipo_documento": "ley", "nombre_oficial": "Ley Dos", "estado_vigencia": "derogada"}
    (tmp_path / "a.json").write_text(json.dumps({"documentos": [first]}))
    (tmp_path / "b.json").write_text(json.dumps([second, second]))
    docs = readers.json_documents(spark, str(tmp_path), "documentos", norms.norms_schema())
    out = {k: [r.asDict() for r in v.collect()] for k, v in norms.load_norms(docs).items()}
    by = {d["nombre_oficial"]: d for d in out["norma_documentos"]}
    assert len(by) == len(out["norma_documentos"]) == 2 and by["Código Uno"]["documento_padre_id"] == by["Ley Dos"]["documento_id"] and by["Ley Dos"]["estado_vigencia"] == "derogada"
    assert sorted((a["alias"], a["es_principal"]) for a in out["norma_aliases"]) == [("CU", False), ("Código Uno", True), ("El Código", False), ("Ley Dos", True)]
    assert sorted((n["path_text"], n["profundidad"], n["orden"], n["texto"]) for n in out["norma_nodos"]) == [("2020", 0, 1, "Libro I. Todo. Libro I. Todo. Libro I. Todo."), ("Libro I", 0, 1, None), ("Libro I > Artículo 1", 1, 7, "Uno. Dos."), ("Libro I > Artículo 2", 1, 2, None)]
    assert sorted(f["contenido"] for f in out["norma_fragmentos"]) == ["2020. Libro I. Todo. Libro I. Todo. Libro I. Todo.", "Artículo 1. Uno. Dos."]
    assert len(out["norma_fuentes"]) == 1 and sorted((s["ruta_archivo"], s["es_principal"]) for s in out["norma_version_fuentes"] if s["ruta_archivo"]) == [("r", True)] and len(out["norma_version_fuentes"]) == 2
    relations = {r["tipo_relacion"]: r for r in out["norma_relaciones"]}
    assert set(relations) == {"reforma", "y"} and relations["y"]["documento_destino_id"] == "given"
    node_id = next(n["nodo_id"] for n in out["norma_nodos"] if n["ref_carga"] == "n1")
    assert (relations["reforma"]["nodo_origen_id"], relations["reforma"]["nodo_destino_id"], relations["reforma"]["version_origen_id"]) == (node_id, None, out["norma_versiones"][0]["version_id"])
    with pytest.raises(Exception, match="not seeded: carta"):
        norms.load_norms(spark.createDataFrame([(None, "Z", "carta")], "id string, ref string, tipo_documento string").select("*", *(_none(f) for f in norms.norms_schema().fields if f.name not in ("id", "ref", "tipo_documento"))))["norma_documentos"].collect()


def _none(field):
    from pyspark.sql import functions as F

    return F.lit(None).cast(field.dataType).alias(field.name)

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import dedup as D
from quillon.operators import ml as M
from quillon.operators import relational as R
from quillon.operators import resolve as E
from quillon.operators import search as S
from quillon.operators.components import components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    assert rows(R.upsert_ignore(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(R.upsert_replace(old, new, ["k"], [F.desc("v")])) == [(1, "a"), (2, "c"), (3, "e")]
    once = R.upsert_replace(old, new, ["k"], [F.desc("v")])
    assert rows(R.upsert_replace(once, new, ["k"], [F.desc("v")])) == rows(once)
    assert rows(R.upsert_combine(old, new, ["k"], {"v": F.max("v")})) == [(1, "a"), (2, "c"), (3, "e")]
    wide = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, v string, e double")
    assert rows(R.update_from(wide, spark.createDataFrame([(1, "a"), (2, "z")], "k long, v string"), ["k"], ["v"], ["e"])) == [(1, "a", 1.0), (2, "z", None)]
    assert rows(R.delete_keys(old, new, ["k"])) == [(1, "a")]


def test_numbering_is_total(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 501).alias("x")).repartition(7)
    got = {r.x: r.n for r in R.numbered(df, [F.col("x")], "n").collect()}
    assert [got[x] for x in sorted(got)] == list(range(1, 501))


def test_numbering_within_values(spark):
    df = spark.range(900).select(F.when(F.col("id") < 700, "hot").when(F.col("id") < 800, None).otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 901).alias("x")).repartition(7)
    got = {}
    for r in R.numbered(df, [F.col("x")], "n", ["k"]).collect():
        got.setdefault(r.k, []).append((r.x, r.n))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values()) and len(got["hot"]) == 700


def test_components(spark):
    nodes = spark.range(60).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 49), (50, 51)], "a long, b long")
    got = {r.node: r.component for r in components(nodes, edges, "n").collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 49 and got[40] == 40


def test_dedup_cases(spark):
    base = " ".join(f"t{i % 50}x{i}" for i in range(60))
    near = base.replace("t25x25", "zz")
    far = " ".join(base.split()[:12] + [f"q{i}" for i in range(36)] + base.split()[-12:])
    docs = spark.createDataFrame([(1, base), (2, f"<b>{base}</b>"), (3, near), (4, far), (5, None), (6, ""), (7, "a b")], "doc_id long, text string")
    p = D.prepared(docs).cache()
    group = {r.doc_id: r.component for r in D.duplicate_components(p).collect()}
    assert group[2] == 1 and group[4] == 4 and group[5] == group[6] == 5
    near_ok = rows(D.near_pairs(p).select("a", "b"))
    assert ((1, 3) in near_ok) == (group[3] == 1)
    of = {r.doc_id: r.duplicate_of for r in D.greedy(p).collect()}
    assert of[1] is None and of[2] == 1 and of[4] is None and of[6] == 5


def test_components_of_buckets_beyond_the_limit(spark, monkeypatch):
    """All near texts of one key are linked, whether few meet on a shingle or many, and none that only share a template."""
    import random

    rng = random.Random(4)
    head, tail = [f"h{i}" for i in range(12)], [f"t{i}" for i in range(12)]
    body = lambda k, n: [f"m{k}x{i}" for i in range(n)]
    texts = [head + body(k, 95) + tail for k in range(60)]  # alone in the key, all of them first
    for k in range(60):
        for _ in range(2):  # one to six words changed: about where the threshold lies
            words = body(k, 95)
            for i in rng.sample(range(95), rng.randint(1, 6)):
                words[i] = f"c{rng.randrange(10**6)}"
            texts.append(head + words + tail)
    drift = body("d", 95)
    for i in range(0, 90, 3):  # each near the one before, not the first
        drift = drift[:i] + [f"e{i}"] + drift[i + 1 :]
        texts.append(head + drift + tail)
    texts += [head + body("s", 40) + [f"u{k}"] + body("z", 54) + tail for k in range(90)]  # all near all others
    texts += [head + body("a", 20) + [f"v{k % 9}"] + body("b", 40) + [f"w{k // 9}"] + body("c", 33) + tail for k in range(81)]  # near if one slot agrees
    texts += [head + [f"m{k % 7}x{i}" for i in range(30)] + [f"only{k}x{i}" for i in range(65)] + tail for k in range(70)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string")
    p = D.prepared(docs).cache()
    assert p.select("near_key").distinct().count() == 1
    sets = [set(zip(*(t[i:] for i in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= D.JACCARD:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i % len(texts)) for i in range(len(texts) + 50)}
    assert 150 < len(set(want.values())) < 250
    monkeypatch.setattr(D, "CROWD", 3, raising=False)
    monkeypatch.setattr(D, "BLOCK", 16, raising=False)
    assert {r.doc_id: r.component for r in D.duplicate_components(p).collect()} == want


def test_spanning_links():
    rng = np.random.default_rng(0)
    near = rng.random((40, 60)) > 0.95
    a, b = D.spanning(near, np.arange(40), np.arange(100, 160))
    assert len(a) <= 100
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[find(x)] = find(y)
    assert all(find(i) == find(100 + j) for i, j in zip(*np.nonzero(near), strict=True))


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 8)).astype(np.float32)
    x[7] = 0
    x[9] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): r.id for r in S.knn(df, df.where("vec_id < 10 and vec_id != 7"), 4).collect()}
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    sims = np.round(unit @ unit.T, 6)
    for q in (0, 8):
        order = [i for i in sorted(range(80), key=lambda i: (-sims[q, i], i)) if i not in (q, 7)][:4]
        assert [got[q, k] for k in range(1, 5)] == order
    found = S.ivf_topk(df.where("embedding is not null and vec_id != 7"), df.where("vec_id < 7"), 4, cells=4, probes=4)
    assert found.count() == 28


def test_ivf_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = df.where("vec_id % 100 = 0")
    exact = {tuple(r) for r in S.knn(df, q, 5).select("query_id", "id").collect()}
    near = {tuple(r) for r in S.ivf_topk(df, q, 5).select("query_id", "id").collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_hybrid_recalls_only_the_semantic_pool(spark):
    v = lambda *x: [float(i) for i in x]
    df = spark.createDataFrame([(1, "p1", "alpha beta", v(1, 0)), (2, "p1", "x", v(0.9, 0.1)), (3, "p2", "alpha beta", v(0, 1)), (4, "p3", "beta", None)], "id long, parent string, text string, embedding array<float>")
    got = S.hybrid(df, v(1, 0), ["alpha", "beta"], "parent", "id", pool=2).collect()
    assert [(r.id, r.hybrid) for r in got] == [(1, 1.0)]
    with pytest.raises(ValueError):
        S.multi_corpus({"leyes": df}, v(1, 0), 3, "id", corpus="otro")


def test_statute_loader(spark, tmp_path):
    from quillon.sources.readers import json_documents

    node = {"tipo_nodo": "libro", "etiqueta": "L1", "nodos": [{"tipo_nodo": "titulo", "etiqueta": "T1", "nodos": [{"tipo_nodo": "cap", "etiqueta": "C1", "nodos": [{"tipo_nodo": "sec", "etiqueta": "S1", "texto": "x"}]}]}]}
    law = {"nombre_oficial": "Ley Uno", "sigla": "LU", "aliases": [" ley  UNO ", "La Uno"], "versiones": [{"version_label": "v1", "nodos": [node], "articulos": [{"articulo_numero": "1", "texto_oficial": "t"}, {"articulo_numero": "2"}]}]}
    (tmp_path / "a.json").write_text(json.dumps({"legislaciones": [{"codigo": "A", "nombre": "A", "leyes": [law]}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"codigo": "B", "nombre": "B", "leyes": [law]}]))
    got = E.load_statutes(json_documents(spark, str(tmp_path), "legislaciones", E.statutes_schema()))
    n = {k: v.count() for k, v in got.items()}
    assert n == {"legislaciones": 2, "leyes": 2, "leyes_alias": 6, "leyes_versiones": 2, "articulos": 4, "nodos": 8}
    assert {(r.profundidad, r.path_text) for r in got["nodos"].collect()} == {(0, "L1"), (1, "L1 > T1"), (2, "L1 > T1 > C1"), (3, "L1 > T1 > C1 > S1")}
    assert got["nodos"].where("padre_id is not null").join(got["nodos"].select(F.col("nodo_id").alias("padre_id")), "padre_id", "left_anti").count() == 0
    assert got["leyes"].where("estado_vigencia = 'vigente' and tipo_norma = 'ley'").count() == 2


def test_resolution_statuses(spark):
    refs = spark.createDataFrame([(1, "civil"), (2, "x"), (3, "codigo penal militar"), (4, "comun"), (5, None)], "ref long, norm string")
    names = spark.createDataFrame([(10, "civil"), (11, "codigo penal"), (12, "comun"), (13, "comun")], "id long, alias_norm string")
    got = {r.ref: (r.id, r.status) for r in E.resolve(refs, names, "ref", "norm", "id").collect()}
    assert got == {1: (10, "exact"), 2: (None, "none"), 3: (11, "partial"), 4: (None, "ambiguous"), 5: (None, "none")}


def test_relations_to_unknown_documents_go(spark):
    rel = spark.createDataFrame([("a", "b", "deroga"), ("a", "z", "reforma")], "origen_ref string, destino_ref string, tipo_relacion string")
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "ref string, documento_id string")
    assert rows(E.resolve_relations(rel, docs)) == [("1", "2", "deroga")]


def test_oversample_reaches_the_largest(spark):
    df = spark.createDataFrame([(i, int(i < 7)) for i in range(10)], "i long, y int")
    assert {r.y: r["count"] for r in M.oversample(df, "y", "s", "i").groupBy("y").count().collect()} == {0: 7, 1: 7}


def test_encoder_ladder():
    def encoder(batch):
        if len(batch) > 1 or len(batch[0]) > 4:
            raise MemoryError
        return [[float(len(batch[0]))]]

    assert M.encode_safely(encoder, ["ab", "abcdefgh", "a" * 20]) == [[2.0], [4.0], None]


@pytest.mark.parametrize("kind", ["logistic", "svc", "bayes", "forest", "voting", "stacking"])
def test_classifiers(spark, kind):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 3, (rng.normal(size=4) * 0.3 + np.eye(4)[i % 3] * 2).tolist()) for i in range(150)], "i long, y int, embedding array<double>").cache()
    out = M.classify(df.where("i < 120"), df.where("i >= 120"), "y", kind=kind)
    assert out.where("prediction = y").count() >= 27


def test_service(spark):
    from quillon.api import SearchService, serve

    df = spark.createDataFrame([(1, "a", "alpha beta gamma", [1.0, 0.0]), (2, "b", "beta", [0.0, 1.0]), (3, "c", "x", None)], "id long, parent string, text string, embedding array<float>")
    service = SearchService({"jurisprudencia": df, "leyes": df.where("id = 2")}, lambda q: [1.0, 0.0], reranker=lambda q, t: [float(len(x)) for x in t])
    assert service.health()["jurisprudencia"] == {"rows": 3, "vectors": 2, "parents": 3, "pending": 1}
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/api/"

    def post(path, body):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, json.dumps(body).encode()), timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert post("semantic-search", {"query": "q", "top_k": 1})[1]["results"][0]["id"] == 1
    assert [r["id"] for r in post("hybrid-search", {"query": "alpha beta", "corpus": "jurisprudencia"})[1]["results"]] == [1, 2]
    assert post("llm-search", {"query": "alpha"})[1]["results"]["sources"]
    assert post("semantic-search", {"query": " "})[0] == post("semantic-search", {"query": "q", "corpus": "z"})[0] == post("semantic-search", {})[0] == 400
    assert post("nothing", {})[0] == 404
    server.shutdown()


def test_numbers_of_large_tables_with_payload(spark):
    """Over a million rows, a key that most of them share and a payload: numbers are exact, in all and within keys, and a split keeps its shares."""
    from pyspark.sql import functions as F

    from quillon.operators import ml as M
    from quillon.operators import relational as R

    n = 1_200_000
    df = spark.range(n, numPartitions=12).select("id", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), (F.xxhash64("id") % 1000).alias("x"))
    got = R.numbered(df, [F.col("x"), F.col("id")], "n").agg(F.countDistinct("n"), F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(got) == (n, 1, n, n)
    within = R.numbered(df, [F.col("x"), F.col("id")], "n", ["k"])
    assert within.groupBy("k").agg(F.countDistinct("n").alias("d"), F.max("n").alias("m"), F.count("*").alias("c")).where("d != c or m != c").count() == 0
    parts = {(r.k, r.part): r["count"] for r in M.stratified_split(df, "k", 0.8, "s", "id").groupBy("k", "part").count().collect()}
    sizes = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert all(parts[k, "train"] == -(-sizes[k] * 8 // 10) for k in sizes)
    clashing = df.limit(50).withColumns({"__part": F.lit(1), "__size": F.lit(2), "__own": F.lit(3)})
    assert sorted(r.n for r in R.numbered(clashing, [F.col("id")], "n").collect()) == list(range(1, 51))


def test_containment_at_any_size(spark):
    """The same pairs as comparing all, with short texts, common runs and cut words."""
    import random

    from quillon.operators import resolve as E

    rng = random.Random(9)
    say = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))).strip() or "a"
    small, large = {say() for _ in range(80)} | {"mexi", "a", "ab"}, {say() + say() for _ in range(120)} | {"mexico", "nuevo mexico"}
    got = {(r.a, r.b) for r in E.contained(spark.createDataFrame([(x,) for x in small], "a string"), spark.createDataFrame([(x,) for x in large], "b string"), "a", "b").collect()}
    assert got == {(a, b) for a in small for b in large if a in b} and ("mexi", "mexico") in got
    refs = spark.createDataFrame([("r1", "mexico"), ("r2", "xyz")], "ref string, norm string")
    names = spark.createDataFrame([(1, "mexi"), (2, "peru")], "id long, alias_norm string")
    assert {r.ref: (r.status, r.id) for r in E.resolve(refs, names, "ref", "norm", "id").collect()} == {"r1": ("partial", 1), "r2": ("none", None)}


def test_exact_copies_beyond_the_bucket_limit(spark, tmp_path):
    """Representatives beyond the limit are still found by their hash, in batches and as rows arrive."""
    from quillon.operators import dedup as D
    from quillon.streaming import jobs

    head, tail = " ".join(f"h{i}" for i in range(12)), " ".join(f"t{i}" for i in range(12))
    middle = lambda k: " ".join(f"m{k}x{i}" for i in range(40))  # noqa: E731  one near key, different texts
    rows = [(k, f"{head} {middle(k)} {tail}") for k in range(60)] + [(100 + k, f"{head} {middle(k)} {tail}") for k in range(60)] + [(300 + k, "") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: None for k in range(60)} | {100 + k: k for k in range(60)} | {300: None, 301: 300, 302: 300}
    assert D.prepared(docs).where("doc_id < 200").select("near_key").distinct().count() == 1
    assert {r.doc_id: r.duplicate_of for r in D.greedy(D.prepared(docs)).collect()} == want
    docs.coalesce(1).write.parquet(str(tmp_path / "src"))
    found = jobs.incremental_dedup(jobs.stream(spark, str(tmp_path / "src"), docs.schema))
    q = found.writeStream.format("memory").queryName("beyond_limit").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r.doc_id: r.duplicate_of for r in spark.table("beyond_limit").collect()} == want

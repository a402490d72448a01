"""The stages on a table with planted cases, and the same table with oddities."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    rows, marks = {}, []
    for i in range(300):
        rows[i] = say(int(rng.integers(80, 160)))
        if i % 6 == 0:
            rows[i] += " scumbag " + say(5)
        marks.append((i, 1, int(i % 6 == 0)))
    item, passage = say(40), say(60)
    rows |= {1000: rows[1], 1001: rows[1], 1002: rows[2] + " x", 1010: f"{say(30)} {item} {say(30)}", 1020: f"{say(50)} {passage} {say(50)}", 1021: f"{say(50)} {passage} {say(50)}", 1030: None, 1031: ""}
    path = str(tmp_path_factory.mktemp("planted"))
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages(spark, planted):
    import corpus_pipeline as P

    path, rows = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, path)
        if name != "bpe":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in (docs if name != "bpe" else out).collect()}
    assert not {i for i in range(0, 300, 6)} & set(kept["toxicity"]) and {i for i in range(300) if i % 6} <= set(kept["toxicity"])
    first = set(kept["near_duplicates"])
    assert 1 in first and not {1000, 1001} & first and len({1030, 1031} & first) == 1
    cut = kept["substring_dedup"]
    assert set(cut) == first and cut[1020].n_chars < len(rows[1020]) - 200 and cut[3].text == rows[3]
    assert set(kept["decontamination"]) == first - {1010}
    assert set(kept["bpe"]) == first - {1010} and kept["bpe"][3].n_tokens > 0
    whole = {r.doc_id: r.n_tokens for r in P.run(spark, path).collect()}
    assert whole == {i: r.n_tokens for i, r in kept["bpe"].items()}


def test_odd_and_empty_tables(spark, docs, clashing, planted):
    import corpus_pipeline as P

    path, _ = planted
    for table in (docs, docs.limit(0), clashing):
        now = table
        for name, stage in P.STAGES:
            out = stage(spark, now, path)
            now = spark.createDataFrame(out.collect(), out.schema)
            assert name == "bpe" or now.columns == table.columns
        assert now.count() <= table.count()
        assert now.where("doc_id is null").count() == table.where("doc_id is null").count()
    assert {r["further_0"] for r in now.select("further_0").collect()} == {"x"}


def test_nothing_stays_in_the_shared_folder(spark, planted):
    """What stages write for themselves goes; what the result is read from stays until the process ends."""
    import pathlib

    import corpus_pipeline as P
    from quillon.llm._store import checkpoint_dir

    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("written-*"))
    rows = P.run(spark, planted[0])
    assert len(set(folder.glob("written-*")) - before) == 1 and rows.count() > 0


def test_rows_of_one_doc_id(spark):
    """Of different rows with one doc_id one stays, the same every time; equal rows are one."""
    import corpus_pipeline as P

    rows = [(1, f"text number {i} " * 20, "en", "s", 1) for i in range(5)] + [(2, "other words here", "en", "s", 1)] * 3 + [(None, None, "en", "s", 1)] * 4
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted((r.doc_id or 0, r.text or "") for r in P.drop_near_duplicates(spark, table.repartition(n), "").collect()) for n in (1, 4)]
    assert got[0] == got[1] and [x[0] for x in got[0]] == [0, 0, 0, 0, 1, 2]


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillon.llm import _store as S
    from quillon.llm.simhash import near_duplicates

    monkeypatch.setattr(S, "HOT", 8)
    rows = [(i, "the same text again and again" if i % 3 else f"text {i} of its own and more") for i in range(4500)] + [(None, "the same text again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_duplicates(docs)
    assert got.count() == 4501 and {r.component_id for r in got.where("doc_id is null or doc_id % 3 != 0").select("component_id").distinct().collect()} == {1}
    left = docs.withColumn("k", F.xxhash64("text"))
    table = left.groupBy("k").agg(F.count("*").alias("n"), F.lit("v").alias("v"))
    assert S.spread_join(left, table, "k", "n").where("v = 'v'").count() == 4501


def test_every_query_is_registered():
    import __spark_entry__ as E

    names = list(E.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)


@pytest.mark.parametrize("small", [6, 0])
def test_near_copies_at_every_similarity(spark, small, monkeypatch):
    """Copies planted at 0.80 to 0.95 go, those just below 0.8 stay; against all pairs by brute force."""
    import corpus_pipeline as P
    from quillon.llm import similar as S

    rng = np.random.default_rng(3)
    rows, sets = {}, {}
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(150, 500)))]
        rows[i] = w
        for k, edits in enumerate((1, 3, 5, 8)):  # one new word in about every 100 to 30
            v = w.copy()
            for at in rng.choice(len(w), max(1, edits * len(w) // 400), replace=False):
                v[at] = f"e{rng.integers(1 << 40)}"
            rows[1000 * (k + 1) + i] = v
    sets = {i: shingles(w) for i, w in rows.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = []
    for i in range(60):
        own = [i, *(1000 * k + i for k in range(1, 5))]
        for n, a in enumerate(own):
            for b in own[:n]:
                s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                seen.append(s)
                if s >= 0.8:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert sum(0.8 <= s < 0.9 for s in seen) > 20 and sum(0.7 <= s < 0.8 for s in seen) > 20
    monkeypatch.setattr(S, "SMALL", small)  # 0: by the search alone
    table = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, table, "").collect()}
    assert kept == {find(i) for i in rows}


def test_simhash_alone_finds_near_copies(spark, monkeypatch):
    """The SimHash index gives candidates of its own: without any band in common, copies within four bits still go, if they are at 0.8."""
    import corpus_pipeline as P
    from quillon.llm import similar as S
    from quillon.llm._text import Places
    from quillon.llm.simhash import _lanes, fingerprint

    rng = np.random.default_rng(5)
    rows = {}
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 50_000, 400)]
        rows[i] = " ".join(w)
        w[int(rng.integers(400))] = "edited"
        rows[100 + i] = " ".join(w)

    def own(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return fingerprint(S.shingle_sets(data, np.array([0, len(data)]), Places())[0], _lanes())

    near = {i for i in range(40) if (own(rows[i]) ^ own(rows[100 + i])).bit_count() <= 4}
    assert 20 < len(near)
    monkeypatch.setattr(S, "band_keys", lambda hashes, at: (hashes[at[:-1]] * np.uint64(3) + S.set_ids(hashes, at))[:, None] + np.arange(S.BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, table, "").collect()}
    assert kept == set(rows) - {100 + i for i in near}


def test_search_of_a_large_group():
    """Chained and separate members of one group, against all pairs."""
    from quillon.llm.similar import link_group

    rng = np.random.default_rng(8)
    base = rng.choice(1 << 40, 400, replace=False)
    sets = [np.unique(np.concatenate([base[k : k + 100], rng.integers(1 << 50, 1 << 60, int(rng.integers(0, 4)))])).astype(np.uint64) for k in (*range(0, 60, 5), *range(150, 300, 15))]
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                want[want == want[a]] = want[b]
    got = np.arange(len(sets))
    for a, b in link_group(sets, np.arange(len(sets))):
        assert alike(sets[a], sets[b])
        got[got == got[a]] = got[b]
    groups = lambda x: {tuple(np.flatnonzero(x == v)) for v in x}
    assert groups(got) == groups(want) and 5 < len(groups(want)) < len(sets)

"""Operators with fixed results against plain brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def test_bpe_agrees_with_the_tokenizer(docs, empty, clashing, texts):
    from tokenizers import Tokenizer

    import public_tokenizers
    from quillon.llm.bpe_codec import bpe_codec

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe_codec(docs).select("doc_id", "n_tokens", "ids", "decoded").where("doc_id is not null").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids), np.array(ids, "<u4").tobytes(), tk.decode(ids, skip_special_tokens=False))
    assert bpe_codec(empty).count() == 0
    assert bpe_codec(clashing).agg(F.sum("n_tokens")).first()[0] == bpe_codec(docs).agg(F.sum("n_tokens")).first()[0]


def test_bpe_chunk_borders_inside_words(texts, monkeypatch):
    """Borders fall inside words; joins are repaired and repeated chunks reused, whatever the chunk size."""
    from quillon.llm import bpe_codec as B

    codec = B.Codec(None)
    raw = [(t or "").encode() for t in texts] * 2 + [" ".join(t or "" for t in texts).encode()]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    want = [codec.tokenizer.encode(r.decode(), add_special_tokens=False).ids for r in raw]
    for size in (2, 8, 128, 4096):
        monkeypatch.setattr(B, "CHUNK", size)
        ids, rows, _, _ = codec.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == want
        begin, end = codec.borders(data, offsets)
        chunks = [data[i:j].tobytes() for i, j in zip(end, begin[1:], strict=False)]
        assert len(set(chunks)) < len(chunks) and (size > 128 or (end > begin).sum() > 100)


THUE = [0]
while len(THUE) < 2048:
    THUE += [1 - x for x in THUE]


def thue_morse(n, flip=0):
    """A word whose polynomial hash mod 2**64 equals that of its complement, for any base."""
    return "".join("ab"[x ^ flip] for x in THUE[:n])


def test_bpe_tells_words_apart_that_polynomial_hashes_do_not(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from quillon.llm.bpe_codec import bpe_codec

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(n, f"{thue_morse(n)} {thue_morse(n, 1)} tail {thue_morse(n)}") for n in (1024, 2048)]
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in bpe_codec(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: tk.encode(t, add_special_tokens=False).ids for n, t in rows}


def test_bpe_stores_are_empty_after_a_task():
    import pyarrow as pa

    from quillon.llm import bpe_codec as B

    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text", "some words", None]})
    assert sum(x.num_rows for x in B._encoder("text", None)(iter([batch]))) == 3
    codec = B._codec(None)
    assert not any((codec.words.now, codec.words.old, codec.chunks.now, codec.chunks.old))


def test_bpe_with_tokens_that_span_white_space(texts):
    """Such a tokenizer is found out from its file and texts are encoded whole."""
    import public_tokenizers
    from quillon.llm import bpe_codec as B

    codec = B.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not codec.parted and B.Codec(None).parted
    raw = [(t or "").encode() for t in texts[:30]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = codec.columns(data, offsets)
    for k, r in enumerate(raw):
        ids = codec.tokenizer.encode(r.decode(), add_special_tokens=False).ids
        assert np.frombuffer(got["ids"][k].as_py(), "<u4").tolist() == ids and got["decoded"][k].as_py() == codec.tokenizer.decode(ids, skip_special_tokens=False)


def test_word_hashes_hold_no_structure():
    """Words and windows of two letters or two words, in orders that cancel in polynomials mod 2**64."""
    from quillon.llm._text import Places, hashed_words, windows_hash

    kept = Places()
    text = " ".join(thue_morse(n, f) for n in (8, 64, 256, 1024, 2048) for f in (0, 1)).encode()
    words, _ = hashed_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), kept)
    assert len(set(words.tolist())) == 10
    two = words[np.array([[x, 1 - x] for x in THUE[:64]]).T.ravel()]
    for n in (5, 8, 35):
        seen = {}
        for k, h in enumerate(windows_hash(two, n).tolist()):
            assert seen.setdefault(h, two[k : k + n].tolist()) == two[k : k + n].tolist()
    # a run's hash does not depend on where it stands, nor on what is around it
    for a, b in ((b"abc", b"abc"), (b"x" * 200, b"x" * 200)):
        data = np.frombuffer(b"zz " + a + b" q " + b, np.uint8)
        h, _ = hashed_words(data, np.array([0, len(data)]), kept)
        assert h[1] == h[3] != h[0]


def brute_fingerprint(t):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(docs, empty, clashing, texts):
    from quillon.llm.simhash import near_duplicates

    got = near_duplicates(docs).collect()
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    component = brute_components(prints)
    assert len(got) == len(texts) + 4
    for r in got:
        i = r.doc_id
        if i is None:
            continue
        assert r.simhash & (2**64 - 1) == prints[i]
        assert r.component_id == component[i]
    assert len(set(component.values())) < len(component)
    assert near_duplicates(empty).count() == 0
    assert sorted(map(str, near_duplicates(clashing).collect())) == sorted(map(str, got))


def test_simhash_of_one_document_with_several_texts(spark):
    """A doc_id does not join what its texts do not join."""
    from quillon.llm.simhash import fingerprints, near_duplicates

    rng = random.Random(1)
    a, b, c = (" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)) for _ in range(3))
    near = a.replace(a.split()[200], "changed", 1)
    rows = [(5, a), (5, b), (3, near), (7, b), (3, c), (None, c), (None, "alone " + c[:300])]
    got = sorted((r.doc_id or 0, r.simhash, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = sorted({t for _, t in rows})
    prints = {t: r.simhash for t, r in zip(texts, fingerprints(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).orderBy("i").collect(), strict=True)}
    assert bin((prints[a] ^ prints[near]) & (2**64 - 1)).count("1") <= 4
    lead = {a: 3, near: 3, b: 5, c: 3}
    assert got == sorted((d or 0, prints[t], lead.get(t)) for d, t in rows)


def test_simhash_dense_and_chained_groups():
    """A dense group and a chain of steps of four bits, as one posting and through the whole index."""
    from quillon.llm.simhash import link_posting, masks

    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    near = [base ^ sum(1 << int(b) for b in rng.choice(32, 2, replace=False)) for _ in range(500)]
    prints = np.array(sorted(set(near)), np.uint64)
    links = link_posting(prints, np.arange(len(prints)), 4)
    assert len(links) == len(prints) - 1
    assert len(masks()) == 70
    for _ in range(200):
        a = int(rng.integers(1 << 63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, 4, replace=False))
        assert any((a & m) == (b & m) for m in masks())


def test_components_of_chains_and_stars(spark):
    from quillon.llm._graph import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substring(rows, window=35):
    count, all_words = Counter(), [words(t) for t in rows]
    for w in all_words:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("task_words", [1 << 19, 500])
def test_substring(spark, docs, empty, clashing, texts, task_words, monkeypatch):
    from quillon.llm import substring as S

    monkeypatch.setattr(S, "TASK_WORDS", task_words)  # small: entries of one task meet only in their files
    rows = [*texts, texts[20], texts[20], texts[25], None]
    want = brute_substring(rows)
    got = S.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter((r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(want)
    assert {r.doc_id: r.kept_text for r in got if r.doc_id is not None} == {i: want[i][2] for i in range(len(texts))}
    assert sum(w[1] for w in want) > 1000
    assert S.substring_dedup(empty).count() == 0
    assert S.substring_dedup(clashing).agg(F.sum("n_removed")).first()[0] == sum(w[1] for w in want)


def test_substring_splits_hot_files(spark, monkeypatch):
    """A line in every document: its file is split, windows keep all 64 bits, and results stay exact."""
    from quillon.llm import substring as S

    rng = np.random.default_rng(4)
    monkeypatch.setattr(S, "FILE_WINDOWS", 200)
    monkeypatch.setattr(S, "COUNTED", 8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))
    line, passage = say(30), say(50)
    rows = [f"{say(40)} {line} {say(40)}" for _ in range(200)] + [f"{say(9)} {line} {passage} {say(5)}" for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    hot = S.hot_files(docs, "text", S.WINDOW, S.GRAM)
    assert len(hot[0])
    filed = docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("rk"), "text").mapInArrow(S._file(S.WINDOW, S.GRAM, hot), "key long, id long, rk long, place long, data binary").where("place & 1 = 0").withColumn("n", F.expr("(place & 4294967295) >> 2"))
    assert filed.where(F.length("data") != 8 * F.col("n")).count() == 0
    assert filed.groupBy("key").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 200
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(docs).collect()}
    assert got == dict(enumerate(brute_substring(rows))) and sum(x[1] for x in got.values()) >= 150


def test_substring_counts_files_spread_thinly(spark, monkeypatch):
    """A file with a few windows in each of very many pieces is found and split all the same."""
    from quillon.llm import substring as S

    rng = np.random.default_rng(5)
    for name, value in {"FILE_WINDOWS": 200, "COUNTED": 1 << 30, "THIN": 4, "TASK_WORDS": 64}.items():
        monkeypatch.setattr(S, name, value)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))
    line = say(30)
    rows = [f"{say(40)} {line} {say(40)}" for _ in range(200)] + [say(90)] * 2
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(16)
    hot = S.hot_files(docs, "text", S.WINDOW, S.GRAM)
    assert len(hot[0])
    filed = docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("rk"), "text").mapInArrow(S._file(S.WINDOW, S.GRAM, hot), "key long, id long, rk long, place long, data binary").where("place & 1 = 0").withColumn("n", F.expr("(place & 4294967295) >> 2"))
    assert filed.groupBy("key").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 400
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(docs).collect()}
    assert got == dict(enumerate(brute_substring(rows)))


def test_substring_judges_words_exactly(spark):
    """34 shared words and a 35th that a polynomial hash takes for the same: nothing goes. With the same 35th all 35 go."""
    from quillon.llm.substring import substring_dedup

    head = " ".join(f"w{i}" for i in range(34))
    rows = [(0, f"{head} {thue_morse(1024)}"), (1, f"{head} {thue_morse(1024, 1)}"), (2, f"x {head} y"), (3, f"q {head} y r")]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 35, 3: 35}


def brute_longest(entries):
    """{(entry, place): longest match with any other place}"""
    places = [(e, p) for e, x in enumerate(entries) for p in range(len(x))]

    def same(a, b):
        n = 0
        while a[1] + n < len(entries[a[0]]) and b[1] + n < len(entries[b[0]]) and entries[a[0]][a[1] + n] == entries[b[0]][b[1] + n]:
            n += 1
        return n

    return {a: max((same(a, b) for b in places if b != a), default=0) for a in places}


def test_substring_factors_are_greedy_and_longest():
    import random

    from quillon.llm.substring import block_factors

    rng = random.Random(3)
    for _ in range(60):
        entries = [[rng.randint(1, 4 if rng.random() < 0.5 else 30) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 7))]
        want, best = [], brute_longest(entries)
        for e, x in enumerate(entries):
            p = 0
            while p < len(x):
                if best[e, p]:
                    want.append((e, p, best[e, p]))
                p += max(1, best[e, p])
        n = np.array([len(x) for x in entries])
        flat = np.array([h for x in entries for h in x], np.uint64)
        got = block_factors(np.full(len(entries), 7, np.int64), n, np.zeros(len(entries), bool), flat, np.arange(len(entries), dtype=np.uint64))
        assert [f[:3] for f in got] == want
        for e, p, size, of, there in got:
            assert (of, there) != (e, p) and entries[of][there : there + size] == entries[e][p : p + size]


def test_substring_sources_hold_the_factor(spark, texts):
    from quillon.llm.substring import substring_dedup

    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sourced = 0
    for r in substring_dedup(docs).where("size(factors) > 0").collect():
        own = words(texts[r.doc_id])
        for f in r.factors:
            assert f.words >= 35
            if f.source_start is not None:
                sourced += 1
                assert (f.source, f.source_start) != (r.doc_id, f.start)
                assert words(texts[f.source])[f.source_start : f.source_start + f.words] == own[f.start : f.start + f.words]
    assert sourced >= 6


def test_substring_keeps_layout(spark):
    from quillon.llm.substring import substring_dedup

    p = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"Title\n\nfirst  {p}\nend  here\n"), (2, f"{p} b"), (3, "un\n touched "), (4, None)]
    got = {r.doc_id: r.kept_text for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), layout="original").collect()}
    assert got == {1: "Title\n\nfirst\nend  here", 2: "b", 3: "un\n touched ", 4: None}


def test_rule_statistics(docs, empty, clashing, labels, texts):
    from quillon.llm.rules import quality_rules, statistics

    got = [r for r in statistics(docs).collect() if r.doc_id is not None]
    for r in got:
        t = texts[r.doc_id] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    judged = quality_rules(docs, labels)
    assert judged.where("base_failed and kept").count() == 0 and judged.count() == len(texts) + 4
    assert quality_rules(empty, labels.limit(0)).count() == 0
    assert quality_rules(clashing, labels).count() == len(texts) + 4


def test_forest_parts_outliers():
    from quillon.llm.rules import _expected, grow, threshold

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(9, 1, (100, 3))])
    low, high = x.min(axis=0), x.max(axis=0)
    forest, good = grow(x[:900], low, high), np.arange(1000) < 900
    scores = forest.score(x)
    cut = threshold(scores, good, 0.02)
    assert (scores[~good] >= cut).mean() > 0.95 and (scores[good] >= cut).mean() <= 0.02

    def path(tree, row):  # one row and one tree at a time
        column, split, left, length = tree
        at = steps = 0
        while length[at] < 0:
            at = left[at] + int(row[column[at]] >= split[at])
            steps += 1
        assert any(np.isclose(length[at] - steps, float(_expected(n))) for n in range(257))
        return length[at]

    for k in range(0, 1000, 90):
        mean = np.mean([path(t, x[k]) for t in forest.trees])
        assert np.isclose(scores[k], 2.0 ** (-mean / float(_expected(256))))
    # rows of a tree at each leaf give its length
    column, split, left, length = grow(x[:900], low, high, trees=1, rows=900, depth=6).trees[0]
    at = np.zeros(900, int)
    for _ in range(6):
        inner = length[at] < 0
        at = np.where(inner, left[at] + (x[np.arange(900), column[at]] >= split[at]), at)
    for leaf in set(at.tolist()):
        depth = next(d for d in range(7) if np.isclose(length[leaf], d + float(_expected((at == leaf).sum()))))
        assert depth <= 6


def test_rules_follow_path_lengths(spark, labels):
    """Far from where good rows are: rejected; without labels nothing but the base rules rejects."""
    from quillon.llm.rules import quality_rules

    rng = np.random.default_rng(1)
    say = lambda n, tail="": " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) + tail for _ in range(n))
    rows = [(i, say(40, "$$$") if i % 10 == 0 else say(int(rng.integers(20, 90)))) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 500)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules(table, marks).collect()}
    assert sum(got[i] for i in got if i % 10 == 0) == 0 and sum(got[i] for i in got if i % 10) >= 445
    assert quality_rules(table, marks.limit(0)).where("not kept").count() == 0


def test_threshold_comes_from_all_labelled_rows(spark):
    """Trees hold rows of the whole table, none of them twice; the threshold is that of all labelled rows, which were 20,000 at most."""
    from pyspark.sql import functions as F

    from quillon.llm import rules as Q

    rnd = lambda k, n: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(n))
    bad = F.col("doc_id") % 50 == 0
    rows = spark.range(60_000).withColumnRenamed("id", "doc_id")
    rows = rows.withColumns({"n_words": 200 + rnd(1, 100), "n_lines": F.lit(10), "n_dup_lines": rnd(2, 3), "n_repeat_words": rnd(3, 20), "n_symbols": F.when(bad, 20 + rnd(4, 200)).otherwise(rnd(5, 40)), "base_failed": F.lit(False)})
    measured = rows.withColumn("word_chars", F.col("n_words") * 4 + rnd(6, 200))
    labels = rows.select("doc_id", (~bad).cast("int").alias("quality"))
    forest = Q.fit(measured, labels)
    got = measured.select("doc_id", *Q.STATISTICS, *Q.EXTRA).toPandas()
    scores = forest.score(Q.features({c: got[c].to_numpy(float) for c in [*Q.STATISTICS, *Q.EXTRA]}))
    good = got["doc_id"].to_numpy() % 50 != 0
    want = Q.threshold(scores, good)
    assert abs(forest.threshold - want) < 1e-12
    assert 0 < (scores[good] >= want).mean() <= Q.MOST_GOOD_REJECTED and (scores[~good] >= want).mean() > 0.3
    # rows enough for all trees: each its own
    x = np.arange(40, dtype=float)[:, None]
    one = Q.grow(x, x.min(axis=0), x.max(axis=0), trees=2, rows=20, depth=40, seed=1)
    two = Q.grow(x[:20], x.min(axis=0), x.max(axis=0), trees=1, rows=20, depth=40, seed=1)
    assert all((a == b).all() for a, b in zip(one.trees[0], two.trees[0], strict=True))
    # one good row gives every row the same path: nothing is rejected
    alone = measured.where("doc_id in (0, 1)")
    assert Q.fit(alone, labels).threshold == np.inf


# Notices as they are published, with their own line breaks.
NOTICES = {
    "Apache-2.0": """   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.

    This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    Lesser General Public License for more details.

    You should have received a copy of the GNU Lesser General Public
    License along with this library; if not, write to the Free Software
    Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
""",
    "AGPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU Affero General Public License for more details.
""",
    "ISC": """Copyright <YEAR> <OWNER>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
""",
    "GPL-2.0-or-later": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
""",
    "0BSD": "// SPDX-License-Identifier: 0BSD",
}


def test_published_notices(spark):
    """Each as it is, and as the comment of a source file."""
    from quillon.llm import licenses as L

    commented = lambda t, mark: "\n".join([f"/*{mark}", *(f" {mark} {x}" for x in t.split("\n")), " */", "package x;"])
    rows = [(name, form) for name, t in NOTICES.items() for form in (t, commented(t, "*"), "intro\n\n" + t.replace("\n", "\n# ") + "\n#\n# end")]
    got = L.scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [r for r in got if r.licenses != [r.name]] == []
    ids = {r.name: r.sentence_ids for r in got}
    assert set(ids["Apache-2.0"]) == {"apache2_under", "apache2_at", "apache2_url", "apache2_unless", "apache2_see"} and set(ids["MPL-2.0"]) == {"mpl2_form", "mpl2_copy"}


def test_every_rule_can_match(spark):
    from quillon.llm import licenses as L

    every = {k: s if isinstance(s, str) else s[0] for k, s in L.SENTENCES.items()} | {f"notice_{n}": f"Licensed under the {said[0]}." for n, said in L.NOTICES.items()} | {"?": "You may not use it on a Sunday."}
    said = every.__getitem__
    rows = [(i, "\n\n".join(said(k) for k in want)) for i, (_, want) in enumerate(L.RULES)]
    got = {r.i: r.licenses for r in L.scan_licenses(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got == {i: [name] for i, (name, _) in enumerate(L.RULES)}


def test_licenses(spark, docs, empty, clashing):
    from quillon.llm import licenses as L

    every = [s for said in L.SENTENCES.values() for s in ((said,) if isinstance(said, str) else said)]
    assert all(any(w in s.lower() for w in L.WORDS) for s in every)
    assert all(len([x for x in re.split(L.BREAK, s.lower()) if re.search("[a-z]", x)]) == 1 for s in every)
    bsd = "\n1. ".join(L.SENTENCES[k] for k in ("bsd_use", "bsd_source", "bsd_binary"))
    full = "\n".join(L.SENTENCES[k] for k in ("mit_grant", "mit_notice", "mit_warranty"))
    wrapped = "Head line\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nmore"
    rows = [(1, "Intro.\nReleased under the MIT License.\nBody"), (2, full), (3, wrapped), (4, "The license is here"), (5, "All rights reserved.\nLICENSED UNDER CC BY-NC 4.0."), (6, None), (7, ""), (8, bsd)]
    got = {r.doc_id: r.licenses for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["GPL-3.0-or-later"], 4: [], 5: ["CC-BY-NC-4.0", "All-rights-reserved"], 6: [], 7: [], 8: ["BSD-2-Clause"]}
    assert L.scan_licenses(docs).count() == docs.count() and L.scan_licenses(empty).count() == 0
    assert L.scan_licenses(clashing).count() == docs.count()
    plan = L.scan_licenses(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ArrayType", ""))


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
NAMES = """3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
   This product includes software developed by {holder}.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def test_licenses_with_names_expressions_and_notices(spark):
    from quillon.llm import licenses as L

    notices = []
    for holder in ("Google Inc.", "the University of California, Berkeley", "the copyright holder", "Acme Corp. Ltd."):
        who = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS" if holder.startswith("the c") else holder.upper()
        notices += [
            (["BSD-3-Clause"], BSD.format(more=NAMES.format(holder=holder), who=who)),
            (["BSD-4-Clause"], BSD.format(more=ADVERT.format(holder=holder) + NAMES.replace("3.", "4.").format(holder=holder), who=who)),
            (["BSD-2-Clause"], BSD.format(more="", who=who)),
            (["BSD-custom"], BSD.format(more="3. You may not use this software on a Sunday.\n", who=who)),
            (["CC0-1.0"], f"To the extent possible under law, {holder.rstrip('.')} has waived all copyright and related or neighboring rights to Tables."),
        ]
    notices += [(["Zlib"], ZLIB), (["Zlib"], "\n".join(f" * {x}" for x in ZLIB.split("\n")))]
    notices += [
        (["Apache-2.0", "MIT"], "// SPDX-License-Identifier: (MIT OR Apache-2.0)"), (["GPL-2.0-only"], "/* SPDX-License-Identifier: GPL-2.0 */"), (["GPL-2.0-or-later"], "# SPDX-License-Identifier: GPL-2.0+"),
        (["GPL-2.0-only"], "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"), (["MIT", "BSD-3-Clause"], "SPDX-License-Identifier: BSD-3-Clause AND MIT"),
        (["MIT"], "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details."), (["Apache-2.0"], "Licensed under the Apache License 2.0."), (["MPL-2.0"], "The library is distributed under the terms of the Mozilla Public License, version 2.0."),
        (["MIT", "Apache-2.0"], "Licensed under either the MIT license or the Apache License, Version 2.0 at your option."), (["BSD-3-Clause"], "requests is released under the 3-clause BSD license."), (["GPL-3.0-only"], "This software is available under the GNU GPLv3."),
        ([], "This project is not licensed under the MIT License."), ([], "We met under the MIT dome, licensed guides said."), ([], "A licence for fishing is issued under the Apache tribe's law."), ([], "This is licensed under the terms of a private agreement."),
    ]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices)], "i int, text string")
    got = {r.i: sorted(r.licenses) for r in L.scan_licenses(rows).collect()}
    assert [(t, got[i]) for i, (want, t) in enumerate(notices) if got[i] != sorted(want)] == []

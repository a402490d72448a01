"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillon.llm.queries import op13_spelling_variants
from quillon.llm.spelling import near_words, variants, word_counts

SCHEMA = "doc_id long, text string, word string, n int, key string, run string, id string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_pairs(words):
    """{word: words one edit apart}, by what is left when a letter is taken out."""
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out = {w: set() for w in words}
    for k, ws in holes.items():
        for a in ws | ({k} & set(words)):
            out.setdefault(a, set()).update(b for b in ws | ({k} & set(words)) if one_apart(a, b))
    return {a: bs for a, bs in out.items() if a in set(words)}


def texts():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcéñÿ×") for _ in range(rng.randint(6, 14))) for _ in range(120)] + ["abababababab", "aaaaaaaaaa", "ababababcab"]

    def edited(w):
        i, c = rng.randrange(len(w)), rng.choice("abcéz")
        return rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]])

    out = [None, "", "  ", "short w÷rds only", "x" * 5000]
    for w in base:
        n, word = 1500, w
        for _ in range(rng.randint(1, 4)):
            out.append(f"{word.upper() if rng.random() < 0.3 else word} " * n + f"{edited(word)}-{edited(word)}'" * 2)
            n, word = max(n // rng.choice([5, 11, 12]), 1), edited(word)
    return out


ROWS = [(i, t, "w", 1, "k", "r", "i") for i, t in enumerate(texts())] + [(7, "abcabcabc " * 40, None, None, None, None, None)] * 2 + [(None, "abcabcabc abcabcab", "", 0, "", "", "")] * 3


def want():
    counts = Counter()
    for doc, t, *_ in ROWS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = near_pairs(n)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), c, len(near[w]), n.get(form[w])) for w, c in n.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spelling"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_variants_agree_with_all_pairs(spark, folder):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op13_spelling_variants(spark, folder).collect()}
    assert got == want()
    assert max(v[3] for v in got.values()) > 3 and any(v[1] not in (w, v[0]) for w, v in got.items())


def test_no_near_pair_is_lost(spark):
    """Dense words over few letters: every bigram is common and repeated."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(600)} | {"".join(rng.choice("aé🙂z") for _ in range(rng.randint(4, 6))) for _ in range(500)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: {x.word for x in r.near} for r in near_words(df).collect()}
    assert got == {a: bs for a, bs in near_pairs(words).items() if bs}


def test_words_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants(word_counts(empty)).count() == 0
    assert word_counts(spark.createDataFrame([(1, "Aéb")], "doc_id long, text string").withColumn("n", F.lit(1)), least=3).count() == 0

"""The prefix trie against a trie built turn by turn."""

import hashlib
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillon.llm import _order
from quillon.llm.prefix_trie import ordered_turns, prefix_trie, spliced
from quillon.llm.queries import op12_conversation_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, conv int, at string, one string"


def rows():
    rng, out = random.Random(3), []
    texts = ["", None, "a b", "a  b", "one", "x y z\t", "é 🙂", "user"]
    for c in [*range(70), 1000, 1001, 1003, 1025, 2**40 + 7]:
        n = rng.choice([1, 2, 3, 5, 8, 9]) if c != 40 else 150
        out += [(c, t, rng.choice(["user", None, ""]), rng.choice(texts[: 3 + c % 6])) for t in range(n)]
    same = [(0, "user", "hello there"), (1, "bot", "hi"), (2, "user", "bye now then")]
    out += [(c, *t) for c in range(100, 160) for t in same]  # copies, of different heads
    out += [(200, t, "user", f"w {t % 2}") for t in range(150)] + [(220, t, "user", f"w {t % 2}") for t in range(140)]
    out += [(300, None, "user", "first"), (300, -5, "user", "second"), (300, 7, "a", "b"), (300, 7, "a", "b"), (None, 0, "user", "lost")]
    return [(*r, "n", 1, "a", "o") for r in out]


def want(turns):
    convs = {}
    for c, turn, role, text, *_ in turns:
        if c is not None:
            both = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(both).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {c: own.get(c - c % 20, [])[: crc32(str(c).encode()) % 4] + ts[crc32(str(c).encode()) % 4 :] for c, ts in own.items()}
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out, below = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own_saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        kids, leaves, saved = below.get(k, (0, 0, 0))
        leaves, saved = leaves or 1, saved + own_saved
        if k:
            a, b, c = below.get(k[:-1], (0, 0, 0))
            below[k[:-1]] = a + 1, b + leaves, c + saved
        ends = ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trie"))
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(f"{path}/conversations.parquet")
    return path


def test_trie_agrees_with_one_built_turn_by_turn(spark, folder, monkeypatch):
    """Odd turns, long conversations, copies; hot names are dealt over tasks and long lists of ids made of pieces."""
    from quillon.llm import prefix_trie as P

    monkeypatch.setattr(_order, "HOT", 4)
    monkeypatch.setattr(P, "PIECE", 20)
    monkeypatch.setattr(_order, "FEW", 5)
    found = op12_conversation_prefix_trie(spark, folder)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == want(rows())
    assert all(kind == "bigint" for n, kind in found.dtypes if n != "ends_sha256")


def test_trie_of_nothing(spark):
    turns = ordered_turns(spark.createDataFrame([], SCHEMA))
    assert prefix_trie(spliced(turns, F.lit(2), F.col("conv"), 3), turns.select("conv").distinct()).count() == 0


def test_running_sums_over_borders(spark):
    """A key over many parts, of rows in any order, and sums over all rows."""
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randint(0, 5)) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k long, o long, v long")
    got = {(r.k, r.o): (r.s, r.c) for r in _order.running(df.withColumn("one", F.lit(1).cast("long")), "k", ["o"], {"s": "v", "c": "one"}).collect()}
    sums, counts, total = {}, {}, 0
    for k, o, v in sorted(data):
        assert got[k, o] == (sums.get(k, 0), counts.get(k, 0))
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
    every = {(r.k, r.o): r.s for r in _order.running(df, None, ["k", "o"], {"s": "v"}).collect()}
    for k, o, v in sorted(data):
        assert every[k, o] == total
        total += v

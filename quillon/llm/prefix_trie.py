"""The trie of conversation prefixes, by prefix doubling.

Turns get dense names: equal (role, text), told apart by SHA-256, have equal
names. In each join round the names of neighbouring blocks of 2**k turns make
those of blocks of twice as many, so rounds grow with the logarithm of the
longest conversation and blocks, aligned ones only, are twice the turns in all.
The prefix of d turns is the prefix without the lowest set bit of d and one
block of that many turns: prefixes are named in rounds of as many set bits.
Equal prefixes of equal depth have equal names, and a name's rows are a node.

No conversation, node or group of copies is gathered: positions and sums along
a conversation come from ranges of rows, names that many rows share meet their
rows in many tasks, node counts are partial sums. A subtree's sums are sums over
its members: each node counts once, in the path of its smallest member.

Null role and text are empty. Turns are in the order of turn, nulls first, ties
by the SHA-256 of role and text; a repeated row is one more turn. Rows without
a conversation are left out. No rows: no nodes, not even a root. Other columns
are ignored.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._order import dense_names, running
from quillon.llm._store import discard, scratch, spread_join, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters of joined ids that are made into a piece before a node's pieces meet.
PIECE = 1 << 16
ROOT = 0


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, name, words), written: each turn's place from 0, dense name and words in its text."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.sha2(both, 256)).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    with scratch() as kept:
        placed = running(rows, "conv", ["turn", "digest"], {"at": "one"}).select("conv", "at", "digest", "words")
        kept.append(dense_names(placed, ["digest"], "name")[0])
        return kept[0]


def spliced(turns: DataFrame, head: Column, source: Column, most: int) -> DataFrame:
    """Ordered turns in which every conversation begins with the first `head` (at most `most`) turns of conversation `source` in place of its own; both columns are made of conv.

    Places may have gaps. What `source` has not is not replaced.
    """
    convs = turns.groupBy("conv").count().select("conv", head.alias("head"), source.alias("source")).where("head > 0")
    heads = turns.where(F.col("at") < most).withColumnRenamed("conv", "source")
    own = turns.where(F.col("at") >= head).select("conv", "at", "name", "words")
    return own.union(convs.join(heads, "source").where("at < head").select("conv", "at", "name", "words"))


def _blocks(turns: DataFrame) -> Iterator[DataFrame]:
    """(conv, d, block, before) for every place d: the aligned block that ends there, of as many turns as the lowest set bit of d, and the place before it."""
    level, blocks, first = 0, turns.select("conv", F.col("at").alias("j"), "name"), 0
    while True:
        even = blocks.where("j % 2 = 0")
        yield even.select("conv", F.shiftleft(F.col("j") + 1, level).alias("d"), F.col("name").alias("block"), F.lit(level).alias("level"), F.shiftleft("j", level).alias("before"))
        side = lambda i: F.max(F.when(F.col("j") % 2 == i, F.col("name")))
        pairs = written(blocks.groupBy("conv", F.expr("j div 2").alias("j2")).agg(side(0).alias("left"), side(1).alias("right")).where("left is not null and right is not null").withColumnRenamed("j2", "j"))
        named, after = dense_names(pairs, ["left", "right"], "name", first)
        discard(pairs)
        if after == first:
            return
        level, blocks, first = level + 1, named.select("conv", "j", "name"), after


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, d, name): the name of every prefix, ROOT for the empty one left out."""
    steps = reduce(DataFrame.union, _blocks(turns)).withColumn("bits", F.bit_count("d"))
    steps = written(steps)
    rounds, free, found = steps.agg(F.max("bits")).first()[0] or 0, ROOT + 1, []
    for i in range(1, rounds + 1):
        rows = steps.where(F.col("bits") == i)
        if i == 1:
            rows = rows.withColumn("prefix", F.lit(ROOT).cast("long"))
        else:
            rows = rows.join(found[-1].select("conv", F.col("d").alias("before"), F.col("name").alias("prefix")), ["conv", "before"])
        rows = written(rows.select("conv", "d", "level", "prefix", "block"))
        named, free = dense_names(rows, ["prefix", "level", "block"], "name", free)
        discard(rows)
        found.append(named.select("conv", "d", "name"))
    return reduce(DataFrame.union, found) if found else steps.select("conv", "d", F.col("block").alias("name"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (name, conv) to rows (name, first, piece): ids joined by commas, in pieces of bounded size."""
    now, ids, size, out = None, [], 0, []

    def close() -> None:
        if ids:
            out.append((now, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for name, conv in zip(batch.column("name").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if name != now or size >= PIECE:
                close()
                now, size = name, 0
            ids.append(conv)
            size += len(str(conv)) + 1
        if out:
            yield _rows(out, (pa.int64(), pa.int64(), pa.string()), ("name", "first", "piece"))
            out = []
    close()
    if out:
        yield _rows(out, (pa.int64(), pa.int64(), pa.string()), ("name", "first", "piece"))


def _rows(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by (name, first) to (name, SHA-256 of the pieces joined by commas)."""
    now, state, out = None, None, []
    for batch in batches:
        for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if name != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if out:
            yield _rows(out, (pa.int64(), pa.string()), ("name", "ends_sha256"))
            out = []
    if state:
        yield _rows([(now, state.hexdigest())], (pa.int64(), pa.string()), ("name", "ends_sha256"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix (node) of ordered turns, written; convs: (conv) distinct, all conversations, those without a turn too.

    node, depth, conv_id (the smallest member), parent (node, null for the
    root), parent_conv_id, n_convs (members), n_children, n_leaves (childless
    nodes of the subtree), saved_tokens ((n_convs - 1) times the words of the
    last turn, summed over the subtree), ends_sha256 (of the ascending ids, joined
    by commas, of the conversations that end here). Places in turns may have gaps.
    """
    with scratch() as kept:
        one = F.lit(1).cast("long")
        seqs = written(running(turns.withColumn("one", one).withColumnRenamed("at", "place"), "conv", ["place"], {"at": "one"}).select("conv", "at", "name", "words"))
        paths = written(_prefixes(seqs).union(convs.select("conv", F.lit(0).cast("long"), F.lit(ROOT).cast("long"))))
        nodes = written(paths.groupBy("name").agg(F.first("d").alias("depth"), F.min("conv").alias("conv"), F.count(one).alias("n_convs")))
        above = paths.select("conv", (F.col("d") + 1).alias("depth"), F.col("name").alias("parent"))
        last = seqs.select("conv", (F.col("at") + 1).alias("depth"), "words")
        nodes = written(nodes.join(above, ["conv", "depth"], "left").join(last, ["conv", "depth"], "left"))
        children = nodes.where("parent is not null").groupBy("parent").agg(F.count(one).alias("n_children"))
        nodes = written(nodes.join(children.withColumnRenamed("parent", "name"), "name", "left").fillna(0, ["n_children", "words"]))
        own = nodes.select("conv", F.col("depth").alias("d"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
        marked = paths.join(own, ["conv", "d"], "left").fillna(0, ["saved", "leaf"]).withColumn("up", -F.col("d")).withColumn("one", one)
        summed = running(marked, "conv", ["up"], {"saved_below": "saved", "leaves_below": "leaf", "below": "one"})
        sums = summed.groupBy("name").agg(F.sum(F.col("saved") + F.col("saved_below")).alias("saved_tokens"), F.sum(F.col("leaf") + F.col("leaves_below")).alias("n_leaves"))
        ends = summed.where("below = 0").select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
        pieces = ends.mapInArrow(_pieces, "name long, first long, piece string").repartition("name").sortWithinPartitions("name", "first")
        hashes = pieces.mapInArrow(_hashes, "name long, ends_sha256 string")
        full = nodes.join(sums, "name").join(hashes, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
        full = written(full)
        parents = full.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
        below = spread_join(full.where("parent is not null"), parents, "parent", "n_children")
        columns = [F.col("name").alias("node"), F.col("conv").alias("conv_id"), "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        out = written(below.select(*columns).union(full.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)))
        kept.append(out)
        return out

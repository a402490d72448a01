"""Groups of documents whose sets of word shingles are alike.

Two documents are near copies if the exact Jaccard similarity of their sets of
five-word shingles is 0.8 or more. Candidates come from a SimHash index first:
64-bit fingerprints of the sets, linked within four bits by their positional
bytes. It cannot find every pair: those at 0.8 differ in ten bits on average and
in up to 24, where a multi-index no longer parts anything. So min-hash bands give
candidates as well: a pair at 0.8 shares none of the 32 bands of four once in
twenty million times, and more similar pairs less often. Every candidate of
either is verified on the whole sets of shingle hashes.

Each band's group is first compared with one of its members, so a large group
of near copies costs about one pass over it; then what is not yet connected is
compared: pair by pair in small groups, and in larger ones by a search that
leaves out what it has reached. Equal sets are one entry; a
null, empty or blank text has the empty set; repeated rows are one entry. A
very long text is taken whole, in arrays of about a hundred bytes a word. Words are what white space parts,
in lower case; a text shorter than a shingle is one shingle.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._graph import connected_components
from quillon.llm._store import shuffles, spread_join, written
from quillon.llm.simhash import _lanes, fingerprint, print_links
from quillon.llm._text import LOWER, Places, hashed_words, lowered_slices, mix, sequence_hash, windows_hash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND = 32, 4
#: Pairs of one document that meet in a task; members of a group whose pairs are sent one by one.
SALT, SMALL = 256, 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, kept: Places) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in turn, ascending, and where each row's begin among them."""
    words, at = hashed_words(LOWER[data], offsets, kept)
    rows = len(offsets) - 1
    whole = windows_hash(words, SHINGLE)
    row = np.repeat(np.arange(rows), np.diff(at))[: len(whole)]
    inside = np.arange(SHINGLE, SHINGLE + len(whole)) <= at[row + 1]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SHINGLE))
    code = np.concatenate([whole[inside], sequence_hash(words, at[short], at[short + 1])])
    row = np.concatenate([row[inside], short])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], np.searchsorted(row[new], np.arange(rows + 1))


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def band_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each row; rows must have shingles."""
    rng = np.random.default_rng(5)
    times, plus = (rng.integers(1 << 32, size=BANDS * BAND, dtype=np.uint32) for _ in range(2))
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at) - 1, b, np.uint64)
        for k in range(b * BAND, (b + 1) * BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((low ^ plus[k]) * (times[k] | np.uint32(1)), at[:-1]))
        out[:, b] = key
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, lanes = Places(), _lanes()
    for batch in batches:
        for i, j, data, offsets in lowered_slices(batch.column(1)):
            hashes, at = shingle_sets(data, offsets, kept)
            n = np.diff(at)
            some = np.flatnonzero(n)
            keys = band_keys(hashes, np.append(at[some], len(hashes))) if len(some) else np.empty((0, BANDS), np.uint64)
            off = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel().view(np.int64)))
            prints = np.fromiter((fingerprint(hashes[a:b], lanes) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, len(n)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(set_ids(hashes, at).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(prints), bands], names=["doc_id", "node", "n", "simhash", "bands"])


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's shingle hashes, once a task."""
    kept, seen = Places(), set()
    for batch in batches:
        for _, _, data, offsets in lowered_slices(batch.column(0)):
            hashes, at = shingle_sets(data, offsets, kept)
            ids = set_ids(hashes, at).view(np.int64)
            new = []
            for k, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    new.append(k)
            if new:
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), lists.take(pa.array(new))], names=["node", "hashes"])


def link_group(sets: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Links at the similarity that connect the components of one group: a search from each over those not reached yet."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    flag = np.zeros(int(flat.max()) + 1, bool)
    links, left = [], np.arange(len(sets))
    others, starts = flat, ends - sizes

    def take(some: np.ndarray) -> list[int]:
        nonlocal left, others, starts
        gone = np.isin(component[left], component[some])
        out = left[gone].tolist()
        others, left = others[np.repeat(~gone, sizes[left])], left[~gone]
        starts = np.cumsum(sizes[left]) - sizes[left]
        return out

    while len(left):
        queue = take(left[:1])
        while queue and len(left):
            at = queue.pop()
            own = flat[ends[at] - sizes[at] : ends[at]]
            flag[own] = True
            both = np.add.reduceat(flag[others], starts, dtype=np.int64)
            flag[own] = False
            near = left[both >= SIMILARITY * (sizes[at] + sizes[left] - both) - 1e-9]
            if len(near):
                links += [(at, int(x)) for x in near]
                queue += take(near)
    return links


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group: rows (key, node, c, hashes) in the order of keys."""
    key, nodes, comps, sets = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if links := link_group(sets, np.array(comps)) if sets else []:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        lists = batch.column(3)
        flat, at = lists.flatten().to_numpy().view(np.uint64).copy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for i, (k, node, c) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True)):
            if k != key:
                yield from done()
                key, nodes, comps, sets = k, [], [], []
            nodes.append(node)
            comps.append(c)
            sets.append(flat[at[i] : at[i + 1]])
    yield from done()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) at the similarity, by intersections in the JVM. A document of many pairs goes to many tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    salted = salted.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "salt", "b", "y")
    lead = parts.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "x")
    both = salted.join(lead, ["a", "salt"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), F.size("x").alias("n"), F.size("y").alias("m"))
    return written(both.where(f"both >= {SIMILARITY} * (n + m - both) - 1e-9").select("a", "b"))


def _able(n: str, m: str) -> str:
    """Sets of these sizes can be at the similarity."""
    return f"least({n}, {m}) >= {SIMILARITY} * greatest({n}, {m}) - 1e-9"


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), written: pairs of sets (node, n, simhash) that the SimHash index links: those of one fingerprint with one of them, and that one with those of fingerprints within four bits."""
    prints = written(nodes.where("n > 0").groupBy("simhash").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("rows")))
    same = spread_join(nodes.select("simhash", "node", "n"), prints.where("rows > 1"), "simhash", "rows").where(f"node != lead.node and {_able('n', 'lead.n')}")
    side = lambda c: prints.select(F.col("simhash").alias(c), F.col("lead").alias(f"lead_{c}"))
    near = print_links(prints).join(side("a"), "a").join(side("b"), "b").where(_able("lead_a.n", "lead_b.n"))
    return written(same.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).union(near.select("lead_a.node", "lead_b.node")))


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, least, component): one row per distinct shingle set, the smallest doc_id that has it, and its group."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes = written(own.mapInArrow(_sketches, "doc_id long, node long, n int, simhash long, bands array<long>").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands")))
    printed = print_pairs(nodes)
    entries = nodes.select(F.explode("bands").alias("key"), "node", "n")
    # another member leads in each band, so an odd one does not lead in all of them
    leads = entries.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "n")).alias("lead")).where("many > 1")
    met = written(entries.join(leads.select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "key"))
    led = met.where(f"node != lead and {_able('n', 'lead_n')}").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    first = written(printed.union(led).distinct())
    sets = written(own.select("text").mapInArrow(_hash_sets, "node long, hashes array<long>").join(met.select("node").union(printed.select("a")).union(printed.select("b")).distinct(), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    links = _verified(first, sets)
    component = written(connected_components(links))
    grouped = met.join(component, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    several = grouped.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("many")).where("low != high").select("key", "many")
    mixed = written(grouped.join(several, "key"))
    small = mixed.where(F.col("many") <= SMALL)
    x, y = small.select("key", "node", "n", "c").alias("x"), small.select("key", "node", "n", "c").alias("y")
    rest = x.join(y, F.expr(f"x.key = y.key and x.node < y.node and x.c != y.c and {_able('x.n', 'y.n')}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(written(rest.join(done, ["a", "b"], "left_anti")), sets)
    large = mixed.where(F.col("many") > SMALL).join(sets, "node").select("key", "node", "c", "hashes").repartition(shuffles(docs.sparkSession), "key").sortWithinPartitions("key")
    more = more.union(written(large.mapInArrow(_search, "a long, b long").distinct()))
    component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return nodes.select("node", "least").join(component, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node long, least long, component_id long): one row per distinct shingle set, the smallest doc_id that has it, and the smallest of its group (nulls where there is none)."""
    labelled = written(_labelled(docs, doc_id, text))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    return spread_join(labelled, smallest, "component", "rows").select("node", "least", "component_id")


def group_leaders(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long): the smallest doc_id of each group that has one. Minima are combined before they are shuffled."""
    return _labelled(docs, doc_id, text).groupBy("component").agg(F.min("least").alias("doc_id")).where("doc_id is not null").select("doc_id")

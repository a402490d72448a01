"""SimHash near-duplicates by a byte-position inverted index.

Two 64-bit fingerprints that differ in at most four bits share at least four of
their eight bytes, at the same positions. The index holds each distinct
fingerprint under every choice of that guaranteed minimum of positional bytes
(70 entries), so a pair that reaches the count meets in at least one posting,
and a posting needs 32 equal bits: postings stay short as the corpus grows.
Each posting tallies shared bytes, keeps pairs with the minimum, and verifies
the differing bits. Postings give spanning links, not all pairs: a search from
one fingerprint compares only those not reached yet, so a large group of near
copies costs about one pass over it. What meets in a posting is distinct
fingerprints of 16 bytes that agree in 32 bits, not documents: copies of a
text are one of them, and near copies within six differing bits that also
share those 32 can be about a million at most.

Rows with equal fingerprints are one entry, and the fingerprint is the node of
the graph: a doc_id with several texts is in the component of each. A null,
empty or blank text has fingerprint zero. component_id is the smallest non-null
doc_id of the component (null if there is none). Repeated rows each get their
own result row; those of a very common fingerprint are dealt over many tasks. A
very long text is hashed whole, in about twenty bytes a word.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._graph import connected_components
from quillon.llm._store import shuffles, spread_join, written
from quillon.llm._text import batch_bytes, with_columns

BITS, RADIUS, SEED = 64, 4, 42
BYTES = BITS // 8


def _lanes() -> np.ndarray:
    """For each byte value, eight bytes that hold its bits, the highest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def fingerprint(hashes: np.ndarray, lanes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    each = lanes[hashes.astype(">u8").view(np.uint8)].reshape(-1, BYTES)
    sums = np.add.reduceat(each, np.arange(0, len(each), 255), axis=0)  # a byte-wide count of 255 cannot overflow
    counts = sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - n + 1].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def _fingerprints(text: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes()
        for batch in batches:
            texts = batch_bytes(batch.column(batch.schema.get_field_index(text)))
            got = np.fromiter((fingerprint(shingle_hashes(t, n), lanes) for t in texts), np.uint64, len(texts))
            yield with_columns(batch, {text}, {"simhash": pa.array(got.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """docs without text, with simhash long (the 64 bits as a signed number)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "simhash")]
    return docs.select(*(f.name for f in keep), text).mapInArrow(_fingerprints(text, shingle), T.StructType([*keep, T.StructField("simhash", T.LongType())]))


def masks(radius: int = RADIUS) -> list[int]:
    """Signed masks of each choice of the bytes that a pair within radius must share."""
    least = BYTES - radius
    out = [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(BYTES), least)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def link_posting(prints: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one posting: a search from each fingerprint over those not reached yet."""
    links, left = [], np.arange(len(prints))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            apart = prints[left] ^ prints[at]
            shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)  # the tally of positional bytes
            near = np.flatnonzero(shared >= BYTES - radius)
            near = near[np.bitwise_count(apart[near]) <= radius]
            if len(near):
                found = left[near]
                links += [(int(nodes[at]), int(nodes[x])) for x in found]
                queue += found.tolist()
                left = np.delete(left, near)
    return links


def _postings(radius: int):
    def solve(keys: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        many = ~(new & np.concatenate([new[1:], [True]]))
        keys, prints = keys[many], prints[many]
        if not len(keys):
            return []
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
        return [x for a, b in zip(at, [*at[1:], len(keys)], strict=True) for x in link_posting(prints[a:b], prints[a:b].view(np.int64), radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if last is not None and now[0][-1] == last:  # one posting fills the batch
                held.append(now)
                continue
            keys, prints = (np.concatenate([*(h[k] for h in held), now[k]]) for k in range(2))
            last = keys[-1]
            cut_at = int(np.searchsorted(keys != last, False)) if keys[0] == last else int(np.flatnonzero(keys != last)[-1]) + 1
            held = [(keys[cut_at:], prints[cut_at:])]
            if cut_at and (links := solve(keys[:cut_at], prints[:cut_at])):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])
        if held and (links := solve(*(np.concatenate([h[k] for h in held]) for k in range(2)))):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return run


def print_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a long, b long), written: links between distinct fingerprints (simhash long) that connect all within radius."""
    entries = prints.select(F.explode(F.array(*(F.lit(m).cast("long") for m in masks(radius)))).alias("mask"), "simhash").select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("simhash"))).alias("posting"), "simhash")
    return written(entries.repartition(shuffles(prints.sparkSession), "posting").sortWithinPartitions("posting", "simhash").mapInArrow(_postings(radius), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, simhash long, component_id, n_links): one row per row of docs.

    n_links counts the links that join the row's fingerprint to others in the
    spanning index links (0: no other fingerprint within radius).
    """
    prints = written(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", shingle))
    nodes = written(prints.groupBy("simhash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    links = print_links(nodes, radius)
    component = connected_components(links).withColumnRenamed("node", "simhash")
    degree = links.select(F.col("a").alias("simhash")).union(links.select("b")).groupBy("simhash").agg(F.count(F.lit(1)).alias("n_links"))
    found = written(nodes.join(component, "simhash", "left").join(degree, "simhash", "left").fillna(0, ["n_links"]))
    linked = found.where("component is not null")
    # The least identifier of a component is taken at the end: a document with several texts is several fingerprints, each in its own.
    leads = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    alone = found.where("component is null").select("simhash", "rows", F.col("least").alias("component_id"), "n_links")
    labelled = alone.union(spread_join(linked, written(leads), "component", "n").select("simhash", "rows", "component_id", "n_links"))
    return spread_join(prints, written(labelled), "simhash", "rows").select("doc_id", "simhash", "component_id", "n_links")

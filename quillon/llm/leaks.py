"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-case runs of letters, digits and non-ASCII characters. For
every length among the items, the windows of a document with as many words
are judged by 256-bit fingerprints of their shingles. A window within the
similarity must hold most shingles of some item, so only windows with enough
shingles of items of their length get a fingerprint (no match is lost by that).
A multi-index finds items: fingerprints within the radius of 63 bits differ in
at most three bits of one of sixteen blocks of 16 bits, and the index holds
each item under every block value one bit away, which a window probes with
every value two bits away, so all within the radius are found. A random item
meets a window in one block of sixteen with a chance of one in six. Pairs
within the radius are verified by the exact weighted similarity: the sum of
least over the sum of largest counts of each shingle.

The radius covers a similarity of 0.8 but for about one pair in fifty thousand.
Items with fewer words than a shingle are one shingle; null and empty items
match nothing. The benchmark is taken in blocks of bounded size, one scan
each. Null and empty texts have no windows; of windows as similar to an item
the first is reported. Repeated rows are judged alike. A very long text is taken
whole, its fingerprints piece by piece. Rows and other columns pass
through; a column named like the output is replaced.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._text import LETTER, LOWER, ODD, Lookup, Places, hash_runs, lowered, lowered_slices, mix, runs, windows_hash, with_columns

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS = 256, 63, 16
#: Bits of a block that index and probe may each be off: together as many as the best block of a pair within the radius can differ in.
INDEXED, PROBED = 1, 2
#: Items a scan; their index is what goes to every executor.
ITEMS = 20_000
#: Windows whose candidates are looked up at once.
AT_ONCE = 64
MATCH = "array<struct<item_id: bigint, similarity: double, start: int, words: int>>"


def words_of(data: np.ndarray, offsets: np.ndarray, kept: Places) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = runs(LETTER[data], offsets)
    return hash_runs(LOWER[data], starts, ends, kept), np.searchsorted(starts, offsets)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each hash."""
    wide = np.stack([mix(hashes + np.uint64(k * int(ODD) & 0xFFFFFFFFFFFFFFFF)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS block values."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.uint16)


def near_values(off: int) -> np.ndarray:
    """Differences of up to so many bits in a block."""
    size = BITS // BLOCKS
    return np.array([sum(1 << b for b in bits) for k in range(off + 1) for bits in combinations(range(size), k)], np.int64)


@dataclass
class Items:
    """Items of one length, and their blocks' inverted index: (block, value) codes in order and the item of each."""

    words: int
    gram: int
    ids: list[int] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    codes: np.ndarray | None = None
    items: np.ndarray | None = None

    def close(self, prints: list[np.ndarray]) -> None:
        self.prints = np.array(prints, np.uint16)
        codes = block_codes(self.prints, near_values(INDEXED))
        order = np.argsort(codes.ravel(), kind="stable")
        self.codes, self.items = codes.ravel()[order].astype(np.int32), (order // codes[0].size).astype(np.int32)

    def candidates(self, prints: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs that agree in a block up to the bits that index and probe allow."""
        codes = block_codes(prints, near).reshape(len(prints), -1).astype(np.int32)
        first, last = (np.searchsorted(self.codes, codes.ravel(), side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.unique(np.repeat(np.arange(codes.size) // codes.shape[1], n) * len(self.ids) + self.items[at])
        return pair // len(self.ids), pair % len(self.ids)


def block_codes(prints: np.ndarray, near: np.ndarray) -> np.ndarray:
    size = BITS // BLOCKS
    return (np.arange(BLOCKS)[:, None] << size) | (prints.astype(np.int64)[:, :, None] ^ near)


@dataclass
class Shingles:
    """All shingles of one size in order, and the groups that have each."""

    hashes: np.ndarray
    first: np.ndarray
    groups: np.ndarray

    def groups_of(self, places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, place) in order, for shingles found at the places."""
        first, n = self.first[found], self.first[found + 1] - self.first[found]
        group = self.groups[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        place = np.repeat(places, n)
        order = np.lexsort((place, group))
        return group[order], place[order]


@dataclass
class Benchmark:
    """Items by length, and all shingles by shingle size."""

    groups: list[Items]
    shingles: dict[int, Shingles]


def build(items: list[tuple[int, str]]) -> Benchmark:
    kept, groups, prints, shingles = Places(), {}, defaultdict(list), defaultdict(set)
    for item, text in items:
        data = np.frombuffer((lowered(pa.array([text or ""]))[0].as_py()).encode(), np.uint8)
        words, _ = words_of(data, np.array([0, len(data)]), kept)
        if not len(words) or item is None:
            continue
        gram = min(SHINGLE, len(words))
        hashes = windows_hash(words, gram)
        group = groups.setdefault(len(words), Items(len(words), gram))
        group.ids.append(item)
        group.counts.append(Counter(hashes.tolist()))
        prints[len(words)].append(pack(signs(hashes).sum(axis=0, keepdims=True))[0])
        shingles[gram].update((h, len(words)) for h in hashes.tolist())
    for n, group in groups.items():
        group.close(prints[n])
    lengths = sorted(groups)
    by_size = {}
    for gram, pairs in shingles.items():
        ordered = sorted(pairs)
        flat = np.array([h for h, _ in ordered], np.uint64)
        hashes, first = np.unique(flat, return_index=True)
        by_size[gram] = Shingles(hashes, np.append(first, len(flat)), np.searchsorted(lengths, [n for _, n in ordered]))
    return Benchmark([groups[n] for n in lengths], by_size)


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return both / (a.total() + b.total() - both)


def least_shared(m: int) -> int:
    """Least shared shingles of two windows of m shingles at the similarity."""
    return int(np.ceil(2 * m * SIMILARITY / (1 + SIMILARITY) - 1e-9))


def row_matches(words: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]], bench: Benchmark, near: np.ndarray) -> list[dict]:
    """The best window of each item in one document. hits: by shingle size, the places that have one of the benchmark's shingles, and which."""
    best: dict[int, tuple[float, int, int]] = {}
    hashes: dict[int, np.ndarray] = {}
    able = []
    for gram, (places, found) in hits.items():
        of, place = bench.shingles[gram].groups_of(places, found)
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
        able += [(int(of[a]), place[a:b]) for a, b in zip(begin, [*begin[1:], len(of)], strict=False)]
    for k, own in sorted(able, key=lambda x: x[0]):
        group = bench.groups[k]
        m = group.words - group.gram + 1
        last = len(words) - group.words
        if last < 0 or len(own) < least_shared(m):
            continue
        counts = np.zeros(len(words) - group.gram + 2, np.int64)
        counts[own + 1] = 1
        np.cumsum(counts, out=counts)
        starts = np.flatnonzero(counts[m:] - counts[:-m] >= least_shared(m))
        if not len(starts):
            continue
        if group.gram not in hashes:
            hashes[group.gram] = windows_hash(words, group.gram)
        h = hashes[group.gram]
        for s0 in range(0, len(starts), AT_ONCE):
            some = starts[s0 : s0 + AT_ONCE]
            a, b = int(some[0]), int(some[-1]) + m
            if b - a <= AT_ONCE + m:
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(h[a:b]), axis=0, dtype=np.int32)])
                prints = pack(sums[some - a + m] - sums[some - a])
            else:
                prints = np.concatenate([pack(signs(h[s : s + m]).sum(axis=0, keepdims=True)) for s in some.tolist()])
            window, item = group.candidates(prints, near)
            close = np.bitwise_count(group.prints[item] ^ prints[window]).sum(axis=1) <= RADIUS
            shingles: dict[int, Counter] = {}
            for w, k in zip(window[close].tolist(), item[close].tolist(), strict=True):
                s = int(some[w])
                if s not in shingles:
                    shingles = {s: Counter(h[s : s + m].tolist())}
                score = similarity(shingles[s], group.counts[k])
                if score >= SIMILARITY and score > best.get(group.ids[k], (0.0,))[0]:
                    best[group.ids[k]] = score, s, group.words
    return [{"item_id": i, "similarity": x[0], "start": x[1], "words": x[2]} for i, x in sorted(best.items())]


def _flag(text: str, bench: Benchmark, more: bool):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))
    least = {g: min((least_shared(i.words - g + 1) for i in bench.groups if i.gram == g), default=1) for g in bench.shingles}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, near, lookups = Places(), near_values(PROBED), {g: Lookup(s.hashes) for g, s in bench.shingles.items()}
        for batch in batches:
            found: list[list[dict]] = []
            for i, j, data, offsets in lowered_slices(batch.column(batch.schema.get_field_index(text))):
                words, at = words_of(data, offsets, kept)
                rows: list[list[dict]] = [[] for _ in range(j - i)]
                hits, enough = {}, set()
                for g, lookup in lookups.items():
                    where, which = lookup(windows_hash(words, g))
                    row = np.searchsorted(at, where, "right") - 1
                    inside = where + g <= at[row + 1] if len(where) else np.empty(0, bool)
                    hits[g] = where[inside], which[inside]
                    enough.update(np.flatnonzero(np.bincount(row[inside], minlength=j - i) >= least[g]).tolist())
                for k in sorted(enough):
                    a, b = int(at[k]), int(at[k + 1])
                    own = {}
                    for g, (where, which) in hits.items():
                        mine = slice(np.searchsorted(where, a), np.searchsorted(where, b))
                        own[g] = where[mine] - a, which[mine]
                    rows[k] = row_matches(words[a:b], own, bench, near)
                found += rows
            if more:
                found = [[*old, *new] for old, new in zip(batch.column(batch.schema.get_field_index("leaks")).to_pylist(), found, strict=True)]
            yield with_columns(batch, {"leaks"}, {"leaks": pa.array(found, kind)})

    return run


def flag_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", items: int = ITEMS) -> DataFrame:
    """docs with leaks, an array of (item_id, similarity, start word, words): the best window of each item found."""
    total = benchmark.count()
    scans = max(1, -(-total // items))
    keep = [f for f in docs.schema.fields if f.name != "leaks"]
    out = docs.select(*(f.name for f in keep))
    schema = T.StructType([*keep, *T.StructType.fromDDL(f"leaks {MATCH}").fields])
    own = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    for k in range(scans):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == k) if scans > 1 else own
        bench = build(sorted(((r["item_id"], r["text"]) for r in part.collect() if r["item_id"] is not None), key=lambda x: (x[0], x[1] or "")))
        out = out.mapInArrow(_flag(text, bench, k > 0), schema)
    return out

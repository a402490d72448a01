"""Vectorised tokenisation and hashing over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, found in the UTF-8
bytes of whole Arrow columns. A word's hash adds up pseudo-random values of its
(place, byte) pairs, a window's is mixed from those of its halves: nothing in
either cancels on regular texts, as powers of a base do mod 2**64. Equal
sequences have equal hashes on every executor, different ones by chance only
(two in 2**64).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII letters, digits and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text that are turned into arrays at once; the arrays take about a hundred times as much.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)
LENGTH = np.uint64(0xD6E8FEB86659FD93)


class Places:
    """A pseudo-random 64-bit value for each (place in a run, byte); those of the first places are kept."""

    KEPT = 64

    def __init__(self) -> None:
        self.table = mix(np.arange(self.KEPT * 256, dtype=np.uint64) * ODD + ODD)

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The value of every byte; starts: where runs begin, ascending from 0."""
        at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        code = (at << 8) | data
        out = self.table[np.minimum(code, len(self.table) - 1)]
        far = np.flatnonzero(at >= self.KEPT)
        out[far] = mix(code[far].astype(np.uint64) * ODD + ODD)
        return out


def sums_of(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] of each run; runs do not overlap."""
    n = ends - starts
    at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    terms = sums_of(mix(values[at] + (at - np.repeat(starts, n)).astype(np.uint64) * ODD))
    last = np.cumsum(n)
    return mix(terms[last] - terms[last - n] + n.astype(np.uint64) * LENGTH)


def windows_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, from those of half as many."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    done, size = mix(values + np.uint64(n)), 1
    while 2 * size <= n:
        done = mix(done[:-size] * ODD + done[size:])
        size *= 2
    return mix(done[:count] * ODD + done[n - size :]) if n > size else done


def slices(column: pa.Array, limit: int = SLICE):
    """(first row, past last row, bytes, offsets of the rows in the bytes) of runs of rows of about limit bytes. A null is an empty text."""
    yield from _cut_rows(column, limit)
    release()


def _cut_rows(column: pa.Array, limit: int):
    if len(column) == 0:
        return
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def release() -> None:
    """Give memory that is free back to the system; a worker is kept between tasks, with what it holds."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross a row's border."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: Places, limit: int = SLICE) -> np.ndarray:
    """Hash of the bytes of each run; starts ascend. Long inputs go in pieces."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        sums = sums_of(kept(data[starts[i] : ends[j - 1]], s))
        out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64) * LENGTH)
        i = j
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, kept: Places) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in turn, and where each row's words begin among them."""
    starts, ends = runs(~SPACE[data], offsets)
    return hash_runs(data, starts, ends, kept), np.searchsorted(starts, offsets)


def batch_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: set[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch without the columns in drop and with the new ones at its end."""
    names = [n for n in batch.schema.names if n not in drop and n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Lookup:
    """Places of 64-bit hashes in a sorted vocabulary, most misses settled by a small table."""

    BITS = 20

    def __init__(self, sorted_hashes: np.ndarray) -> None:
        self.sorted = sorted_hashes
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(sorted_hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among hashes, places in the vocabulary) of those found."""
        at = np.flatnonzero(self.table[(hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[found] == hashes[at]
        return at[hit], found[hit]


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case; unchanged where they are not valid UTF-8 (A-Z is then lowered by LOWER alone)."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return column


def lowered_slices(column: pa.Array, limit: int = SLICE):
    """slices() of the texts in lower case, lowered slice by slice."""
    for i, j, _, _ in slices(column, limit):
        for a, b, data, offsets in _cut_rows(lowered(column.slice(i, j - i)), 1 << 62):
            yield i + a, i + b, data, offsets


def free_names(df, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out

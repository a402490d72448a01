"""Substring dedup by relative Lempel-Ziv parsing against blocks of windows.

The corpus is its own reference, indexed in blocks: each window of `window`
words is filed under the least hash of its k-word grams, so equal windows are
in one block wherever they stand, and consecutive windows mostly share one. A
document sends one entry to each block that has windows of it. There every
entry is parsed greedily against the block: from its first window that also
starts elsewhere it takes the longest factor, the most consecutive windows
that another place of the block holds too, and goes on after it. At a border of
blocks a factor whose source goes on in the next one is continued. All factors
are at least one window long, and a window is in a factor if and only if its
words also start elsewhere, so the duplicate spans are exact. Windows are
judged on the input, not on what is left after other removals.

Equal entries of one task are settled there: one is sent on and is the source
of the others, so a passage in a third of all documents reaches its block once
a task and not once a document. A factor that has no other copy in its block
than such settled ones has no source of its own.

Null, empty and short texts have no windows. Repeated rows count as places of
their own. Of several longest sources the one with the least row hash is taken.
A very long text is cut into entries like any other; it is held whole by the
task that reads it, in arrays of about a hundred bytes a word. Window identity
is a 64-bit hash that is mixed anew at every doubling, within a block: ten
million different windows of one block have a false match once in hundreds of
thousands of times. Blocks that a very common line fills are counted first and split by
the windows' own hashes, so that each part stays bounded (factors there are
single windows, joined again at the end).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._store import shuffles
from quillon.llm._text import SPACE, Places, free_names, hashed_words, mix, release, runs, slices, windows_hash, with_columns

WINDOW, GRAM, TASK_WORDS = 35, 8, 1 << 19
#: A file with more windows is split. Those of files with fewer than COUNTED in TASK_WORDS words are counted by one in THIN, chosen by hash: a file that is spread thinly over many tasks still shows.
FILE_WINDOWS, COUNTED, THIN = 1 << 17, 64, 1 << 10


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    done, size = x, 1
    while 2 * size <= n:
        done = np.minimum(done[:-size], done[size:])
        size *= 2
    return np.minimum(done[: len(done) - (n - size)], done[n - size :]) if n > size else done


Hot = tuple[np.ndarray, np.ndarray]
NONE: Hot = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def split_keys(key: np.ndarray, whole: np.ndarray, hot: Hot) -> np.ndarray:
    """The files' keys, those of hot files (keys ascending, parts) with the part that the window's own hash gives."""
    keys, parts = hot
    if not len(keys):
        return key
    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[found] == key, mix(key + whole % parts[found] * np.uint64(0xD6E8FEB86659FD93)), key)


def file_windows(words: np.ndarray, offsets: np.ndarray, window: int, gram: int, kept: Places, hot: Hot = NONE):
    """(row, first window, number, file key, first window among all, window hashes) of each run of windows of a row with one key."""
    n = len(words)
    if n < window:
        return None
    grams, whole = windows_hash(words, gram), windows_hash(words, window)
    key = sliding_min(grams, window - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(whole)]
    valid = np.arange(window, window + len(whole)) <= offsets[row + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    row, whole = row[at], whole[at]
    key = split_keys(key[at], whole, hot)
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    return row[begin], at[begin] - offsets[row[begin]], np.diff(np.append(begin, len(at))), key[begin], begin, whole


def _count(window: int, gram: int, counted: int, task_words: int, thin: int):
    """(key, different windows) of the files that have at least `counted` in one piece of the input; of others `thin` for each window that stands for so many."""

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        words, offsets = np.concatenate([h[0] for h in held]), np.concatenate([[0], np.cumsum(np.concatenate([h[1] for h in held]))])
        if (filed := file_windows(words, offsets, window, gram, Places())) is None:
            return
        _, _, n, key, _, whole = filed
        different, lead = np.unique(whole, return_index=True)
        own = np.repeat(key, n)[lead]
        keys, times = np.unique(own, return_counts=True)
        some, few = np.unique(own[mix(different) % np.uint64(thin) == 0], return_counts=True)
        rare = times[np.searchsorted(keys, some)] < counted
        found, many = np.concatenate([keys[times >= counted], some[rare]]), np.concatenate([times[times >= counted], few[rare] * thin])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many.astype(np.int64))], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = Places(), [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words, at = hashed_words(data, offsets, kept)
                held.append((words, np.diff(at)))
                size += len(words)
                if size >= task_words:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def hot_files(docs: DataFrame, text: str, window: int, gram: int) -> Hot:
    """Files with over FILE_WINDOWS windows and the parts that each is split into: at most one for so many windows of the corpus."""
    counts = docs.select(text).mapInArrow(_count(window, gram, COUNTED, TASK_WORDS, THIN), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > FILE_WINDOWS).collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    parts = np.array([-(-2 * r["n"] // FILE_WINDOWS) for r in rows], np.uint64)
    order = np.argsort(keys)
    return keys[order], parts[order]


#: How a settled entry names its source.
SOURCE = np.dtype([("known", "?"), ("id", "<i8"), ("first", "<i4")])


def _file(window: int, gram: int, hot: Hot = NONE):
    """Entries (key, id, rk, place, data). place: first window, number of windows, whether it has settled copies, whether it is one; data: its windows' hashes, or its source."""

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        kept = Places()
        words, ids, nulls, rks = (np.concatenate([h[k] for h in held]) for k in range(4))
        sizes = np.concatenate([h[4] for h in held])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if (filed := file_windows(words, offsets, window, gram, kept, hot)) is None:
            return
        row, first, n, key, begin, whole = filed
        same = mix(np.add.reduceat(mix(whole), begin) + key) + n.astype(np.uint64)
        _, lead, which, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        leads = np.zeros(len(same), bool)
        leads[lead] = True
        many = times[which] > 1
        sent, done = np.flatnonzero(leads), np.flatnonzero(many & ~leads)
        every = np.concatenate([sent, done])
        settled = np.arange(len(every)) >= len(sent)
        copy = lead[which[done]]  # the one that was sent is their source
        sources = np.zeros(len(done), SOURCE)
        sources["known"], sources["id"], sources["first"] = ~nulls[row[copy]], ids[row[copy]], first[copy]
        lengths = np.where(settled, SOURCE.itemsize, n[every] * 8)
        off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        blob = whole[np.repeat(leads, n)].astype("<u8").tobytes() + sources.tobytes()
        # A settled entry goes with its own row, spread evenly; an open one to its block.
        to = np.concatenate([key[sent], mix(rks.view(np.uint64)[row[done]] + first[done].astype(np.uint64))]).view(np.int64)
        place = first[every] << 32 | n[every] << 2 | many[every] << 1 | settled
        out = pa.RecordBatch.from_arrays(
            [pa.array(to), pa.array(ids[row[every]], mask=nulls[row[every]]), pa.array(rks[row[every]]), pa.array(place), pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(blob)])],
            names=["key", "id", "rk", "place", "data"],
        )
        for i in range(0, len(every), 20_000):
            yield out.slice(i, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = Places(), [], 0
        for batch in batches:
            ids = batch.column(0)
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            rks = batch.column(1).to_numpy()
            for i, j, data, offsets in slices(batch.column(2)):
                words, at = hashed_words(data, offsets, kept)
                held.append((words, ids[i:j], nulls[i:j], rks[i:j], np.diff(at)))
                size += len(words)
                if size >= TASK_WORDS:
                    yield from emit(held)
                    held, size = [], 0
                    release()
        if held:
            yield from emit(held)

    return run


def longest_matches(code: np.ndarray, reach: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest match of what starts at each place.

    code: windows in runs, in turn; reach: how many are left of its run from
    each on. Suffixes are ranked by prefix doubling; the longest match of one
    is beside it in that order. Of equal suffixes the source is that with the
    least tie. Length 0: no other place has the window.
    """
    n = len(code)
    _, rank = np.unique(code, return_inverse=True)
    levels, step = [rank.astype(np.int64) + 1], 1
    while step < reach.max(initial=0):
        last = levels[-1]
        then = np.where(reach > step, last[np.minimum(np.arange(n) + step, n - 1)], 0)
        _, rank = np.unique(last * (int(last.max()) + 1) + then, return_inverse=True)
        levels.append(rank.astype(np.int64) + 1)
        step *= 2
    order = np.lexsort((tie, levels[-1]))
    a, b = order[:-1], order[1:]
    same = np.zeros(n - 1, np.int64) if n else np.empty(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
        left = np.minimum(reach[a], reach[b]) - same
        same += np.where((left >= 1 << k) & (levels[k][x] == levels[k][y]), 1 << k, 0)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    length[b], source[b] = same, a
    more = same > length[a]
    length[a[more]], source[a[more]] = same[more], b[more]
    # equal suffixes all take the first of them
    top = levels[-1][order]
    lead = order[np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))[np.cumsum(np.concatenate([[True], top[1:] != top[:-1]])) - 1]] if n else order
    equal = (lead != order) & (length[order] == reach[order])
    source[order[equal]] = lead[equal]
    source[length == 0] = -1
    return length, source


def block_factors(keys: np.ndarray, n: np.ndarray, many: np.ndarray, hashes: np.ndarray, tie: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(entry, first window in it, windows, source entry or -1, first window there) of the greedy factors of entries that may be of several blocks.

    hashes: of the windows of all entries in turn; many: the entry has settled copies.
    """
    entry = np.repeat(np.arange(len(keys)), n)
    code = mix(keys.view(np.uint64)[entry] ^ mix(hashes))
    _, which = np.unique(code, return_inverse=True)
    at = np.flatnonzero(np.bincount(which, weights=1 + many[entry])[which] >= 2)
    if not len(at):
        return []
    last = np.concatenate([(at[1:] != at[:-1] + 1) | (entry[at[1:]] != entry[at[:-1]]), [True]])
    ends = np.flatnonzero(last) + 1
    reach = ends[np.searchsorted(ends, np.arange(len(at)), "right")] - np.arange(len(at))
    length, source = longest_matches(code[at], reach, tie[entry[at]])
    starts = np.cumsum(n) - n
    own, place = entry[at], at - starts[entry[at]]
    owns, places, lengths, sources, lefts = own.tolist(), place.tolist(), length.tolist(), source.tolist(), reach.tolist()
    out, i = [], 0
    while i < len(lengths):
        if size := lengths[i]:
            out.append((owns[i], places[i], size, owns[sources[i]], places[sources[i]]))
        else:
            size = 1
            while size < lefts[i] and not lengths[i + size]:
                size += 1
            out.append((owns[i], places[i], size, -1, -1))
        i += size
    return out


def _match():
    names = ["id", "rk", "first", "n", "source", "source_first"]

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, rk, place = (batch.column(k).to_numpy() for k in (0, 2, 3))
        ids, data = batch.column(1), batch.column(4)
        nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        first, n, many = place >> 32, (place & 0xFFFFFFFF) >> 2, place & 2 > 0
        done, open_ = np.flatnonzero(place & 1), np.flatnonzero(~place & 1)
        sources = np.frombuffer(b"".join(data.take(pa.array(done)).to_pylist()), SOURCE)
        # Also entries alone in their block: a passage that repeats at once has equal windows in one entry.
        hashes = np.frombuffer(b"".join(data.take(pa.array(open_)).to_pylist()), "<u8")
        found = block_factors(key[open_], n[open_], many[open_], hashes, rk.view(np.uint64)[open_])
        at, offset, number, source, there = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 5
        at, of = open_[at], open_[np.maximum(source, 0)]
        every = np.concatenate([at, done])
        if not len(every):
            return None
        columns = [
            pa.array(ids[every], mask=nulls[every]),
            pa.array(rk[every]),
            pa.array(np.concatenate([first[at] + offset, first[done]]).astype(np.int32)),
            pa.array(np.concatenate([number, n[done]]).astype(np.int32)),
            pa.array(np.concatenate([ids[of], sources["id"]]), mask=np.concatenate([(source < 0) | nulls[of], ~sources["known"]])),
            pa.array(np.concatenate([first[of] + there, sources["first"]]).astype(np.int32), mask=np.concatenate([source < 0, np.zeros(len(done), bool)])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and batch.column(0)[-1].as_py() == last:
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            keys = whole.column(0).to_numpy()
            last = int(keys[-1])
            other = np.flatnonzero(keys != last)
            border = int(other[-1]) + 1 if len(other) else 0
            held = [whole.slice(border)]
            if border and (out := solve(whole.slice(0, border))) is not None:
                yield out
                release()
        if held and (out := solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
            yield out

    return run


Factor = tuple[int, int, int | None, int | None]


def parse(found: list[Factor], window: int) -> list[Factor]:
    """Factors (first word, words, source's doc_id, first word there) of a document from those of blocks (in windows): continued over borders where the source goes on."""
    out: list[list] = []
    one = {f[:2]: f for f in sorted(found, key=lambda f: (f[2] or 0, f[3] or 0), reverse=True)}  # equal rows may name several sources
    for first, n, source, there in (one[k] for k in sorted(one)):
        if out and there is not None and out[-1][3] is not None and out[-1][2] == source and there - out[-1][3] == first - out[-1][0] == out[-1][1]:
            out[-1][1] += n
        elif out and there is None and out[-1][3] is None and first == out[-1][0] + out[-1][1]:
            out[-1][1] += n
        else:
            out.append([first, n, source, there])
    return [(a, n + window - 1, source, there) for a, n, source, there in out]


def covered(factors: list[Factor]) -> list[tuple[int, int]]:
    """(first word, words) of the spans that the factors cover; overlapping ones are one."""
    out: list[list[int]] = []
    for a, n, _, _ in factors:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b - a) for a, b in out]


def cut_text(text: bytes, spans: list[tuple[int, int]], layout: str) -> tuple[bytes, int, int]:
    """(what is kept, words, words removed)."""
    words = text.split()
    if not spans:
        return (b" ".join(words) if layout == "words" else text), len(words), 0
    removed = sum(n for _, n in spans)
    if layout == "words":
        kept, at = [], 0
        for a, n in spans:
            kept += words[at:a]
            at = a + n
        return b" ".join(kept + words[at:]), len(words), removed
    data = np.frombuffer(text, np.uint8)
    starts, ends = runs(~SPACE[data], np.array([0, len(data)]))
    parts, at = [], 0
    for a, n in spans:  # with the white space before it
        parts.append(text[at : ends[a - 1] if a else 0])
        at = ends[a + n - 1]
    return b"".join([*parts, text[at:]]).strip(), len(words), removed


FACTOR = "array<struct<start: int, words: int, source: bigint, source_start: int>>"


def _cutter(text: str, window: int, layout: str, found: str):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                of = batch.column(batch.schema.get_field_index(found)).to_pylist()
                factors = [parse([(f["first"], f["n"], f["source"], f["source_first"]) for f in x], window) if x else [] for x in of]
                got = [cut_text(t or b"", covered(f), layout) for t, f in zip(texts, factors, strict=True)]
                yield with_columns(
                    batch,
                    {text, found},
                    {
                        "kept_text": pa.array([None if t is None and layout != "words" else g[0].decode() for t, g in zip(texts, got, strict=True)], pa.string()),
                        "n_words": pa.array([g[1] for g in got], pa.int64()),
                        "n_removed": pa.array([g[2] for g in got], pa.int64()),
                        "factors": pa.array([[{"start": a, "words": n, "source": s, "source_start": t} for a, n, s, t in f] for f in factors], kind),
                    },
                )

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, layout: str = "words") -> DataFrame:
    """docs without text, with kept_text, n_words, n_removed and factors array<struct<start, words, source, source_start>>.

    Every word covered by a window of `window` words whose sequence also starts
    elsewhere is removed. layout "words": the kept words joined by one space;
    "original": the text as it is, without the factors and the white space
    before them (a null text stays null). source is the doc_id of another
    place of the factor's words and source_start its first word there.
    """
    spark = docs.sparkSession
    own, rk, found, sid, srk = free_names(docs, "__id", "__rk", "__found", "__sid", "__srk")
    rows = docs.withColumns({own: F.col(doc_id).cast("long"), rk: F.xxhash64(doc_id, text)})
    filed = rows.select(own, rk, text).mapInArrow(_file(window, gram, hot_files(docs, text, window, gram)), "key long, id long, rk long, place long, data binary")
    factor = T.StructType.fromDDL("id long, rk long, first int, n int, source long, source_first int")
    matched = filed.repartition(shuffles(spark), "key").sortWithinPartitions("key").mapInArrow(_match(), factor)
    spans = matched.groupBy(F.col("id").alias(sid), F.col("rk").alias(srk)).agg(F.collect_set(F.struct("first", "n", "source", "source_first")).alias(found))
    new = ["kept_text", "n_words", "n_removed", "factors"]
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in new]
    joined = rows.join(spans, F.col(own).eqNullSafe(F.col(sid)) & (F.col(rk) == F.col(srk)), "left").select(*(f.name for f in keep), text, found)
    schema = T.StructType([*keep, *T.StructType.fromDDL(f"kept_text string, n_words long, n_removed long, factors {FACTOR}").fields])
    return joined.mapInArrow(_cutter(text, window, layout, found), schema)

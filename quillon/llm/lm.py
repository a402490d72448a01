"""Masked pseudo-likelihood from a bidirectional window network.

Words are lower-case runs of letters, digits and non-ASCII characters. Word
counts run over all documents. The most frequent words have an output of their
own; each other word falls into one of BUCKETS hashed buckets. The network sees
two words on either side of a masked one (embeddings, one tanh layer) and
predicts it in two steps, a class of outputs and the output in its class; a
word of a bucket takes a third one, its share of the bucket's words in the
whole corpus. Those shares are kept by cells of the bucket, of which there are
twice as many as different words (at most 2**MOST_CELLS in all; beyond that the
words of a cell share its count evenly), so every word is predicted as a word
and what is gathered grows with the corpus.

The network starts from the counts and learns, in numpy on the executors, from
every position of the corpus once: documents are dealt into ROUNDS by a hash;
in each round every partition trains from the shared weights, and the results are
averaged by the positions they saw, in whole numbers, so the order of arrival
does not matter. Weights depend on how the input is partitioned. A document's
score is the sum of the log-probabilities of all its words, each given both
sides.

Null, empty and word-free texts have no words and a sum of 0 (mean null).
Repeated rows and equal texts are scored alike. A very long text is scored
whole; its windows are built piece by piece.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._store import reduced, written
from quillon.llm._text import LETTER, LOWER, Lookup, Places, hash_runs, lowered_slices, mix, runs, slices, with_columns

CLASSES, IN_CLASS = 32, 32
WORDS, BUCKETS = CLASSES * IN_CLASS - 64, 64
SIZE = CLASSES * IN_CLASS
SIDE, DIMS, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE = 4, 2048, 0.01
#: Words counted at once, positions scored at once, positions shuffled at once, bytes of ids read at once.
COUNT_WORDS, SCORE, SHUFFLED, READ = 1 << 22, 1 << 15, 1 << 17, 1 << 18
MOST_CELLS, CELL_UNIT = 24, 256
#: Weights are added up in units of one in so many.
UNIT = 1 << 12
SHAPES = {"emb": (SIZE + 1, DIMS), "w": (2 * SIDE * DIMS, HIDDEN), "b": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, HIDDEN, IN_CLASS), "bw": (CLASSES, IN_CLASS)}


def _word_hashes(column: pa.Array, kept: Places) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in lowered_slices(column):
        starts, ends = runs(LETTER[data], offsets)
        yield i, j, hash_runs(LOWER[data], starts, ends, kept), np.searchsorted(starts, offsets)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, held, size = Places(), [], 0

    def out() -> Iterator[pa.RecordBatch]:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(hashes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], names=["word", "n"])

    for batch in batches:
        for _, _, words, _ in _word_hashes(batch.column(0), kept):
            held.append(words)
            size += len(words)
            if size >= COUNT_WORDS:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


@dataclass
class Words:
    """Outputs of frequent words, and how the others share their buckets."""

    vocabulary: np.ndarray  # hashes, ascending
    output: np.ndarray  # of each
    cells: np.ndarray  # log of the count of each of a cell's words, in units of one in CELL_UNIT
    buckets: np.ndarray  # log of each bucket's count

    def rest(self, words: np.ndarray) -> np.ndarray:
        """Log share of its bucket, of words without an output of their own."""
        cell = (words & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return self.cells[cell] / CELL_UNIT - self.buckets[cell % BUCKETS]


def _encode(text: str, table: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, lookup = Places(), Lookup(table.vocabulary)
        for batch in batches:
            for i, j, words, at in _word_hashes(batch.column(batch.schema.get_field_index(text)), kept):
                ids = (WORDS + (words % np.uint64(BUCKETS)).astype(np.int64)).astype("<u2")
                where, found = lookup(words)
                ids[where] = table.output[found]
                rest = table.rest(words)
                rest[where] = 0
                sums = np.bincount(np.repeat(np.arange(j - i), np.diff(at)), rest, minlength=j - i)
                raw = ids.tobytes()
                cuts = (2 * at).tolist()
                yield with_columns(batch.slice(i, j - i), {text}, {"ids": pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "rest": pa.array(sums)})

    return run


def windows(ids: np.ndarray, row: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
    """SIDE ids before and after each position from a to b of the same row; SIZE where there is none."""
    b = len(ids) if b is None else min(b, len(ids))
    out = np.full((b - a, 2 * SIDE), SIZE, np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        first, last = max(a, -step), min(b, len(ids) - step)
        if first < last:
            same = row[first:last] == row[first + step : last + step]
            out[first - a : last - a, k] = np.where(same, ids[first + step : last + step], SIZE)
    return out


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the words' shares among all words."""
    rng = np.random.default_rng(0)
    net = {k: rng.normal(0, 0.1, s) for k, s in SHAPES.items()}
    by_class = counts.reshape(CLASSES, IN_CLASS) + 0.5
    net["b"][:] = 0
    net["bc"] = np.log(by_class.sum(axis=1) / by_class.sum())
    net["bw"] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return net


def _exp_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exponentials, their sums, what was taken off before) of each row; one maximum serves all rows unless some row is far below it."""
    top = x.max()
    out = np.exp(x - top)
    sums = out @ np.ones(x.shape[1], x.dtype)
    if sums.min() < 1e-25:
        top = x.max(axis=1)
        out = np.exp(x - top[:, None])
        sums = out.sum(axis=1)
    return out, sums, top


def _softmax(x: np.ndarray) -> np.ndarray:
    out, sums, _ = _exp_rows(x)
    out /= sums[:, None]
    return out


def _log_sums(x: np.ndarray) -> np.ndarray:
    _, sums, top = _exp_rows(x)
    return np.log(sums) + top


def _sums_by(c: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by the id beside each."""
    order = np.argsort(c.astype(np.uint16), kind="stable")
    c = c[order]
    begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    out = np.zeros((SIZE + 1, rows.shape[1]), rows.dtype)
    out[c[begin]] = np.add.reduceat(rows[order], begin, axis=0)
    return out


def steps(net: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, moments: dict | None = None) -> None:
    """Adam over the positions in batches, in place. moments: kept between calls."""
    moments = {} if moments is None else moments
    if not moments:
        moments |= {"t": 0, **{k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}}
    for a in range(0, len(target), BATCH):
        c, y = context[a : a + BATCH], target[a : a + BATCH]
        order = np.argsort((y // IN_CLASS).astype(np.uint8), kind="stable")
        c, y = c[order], y[order]
        own, word, every = y // IN_CLASS, y % IN_CLASS, np.arange(len(y))
        w = net["w"].reshape(2 * SIDE, DIMS, HIDDEN)
        h = net["b"] + sum((net["emb"] @ w[k])[c[:, k]] for k in range(2 * SIDE))
        np.tanh(h, out=h)
        d_class = _softmax(h @ net["wc"] + net["bc"])
        d_class[every, own] -= 1
        d_class /= len(y)
        dh = d_class @ net["wc"].T
        g = {k: np.zeros_like(v) for k, v in net.items()}
        cuts = np.searchsorted(own, np.arange(CLASSES + 1)).tolist()
        for k in range(CLASSES):
            i, j = cuts[k], cuts[k + 1]
            if i == j:
                continue
            d = _softmax(h[i:j] @ net["ww"][k] + net["bw"][k])
            d[every[: j - i], word[i:j]] -= 1
            d /= len(y)
            dh[i:j] += d @ net["ww"][k].T
            g["ww"][k], g["bw"][k] = h[i:j].T @ d, d.sum(axis=0)
        g["wc"], g["bc"] = h.T @ d_class, d_class.sum(axis=0)
        dh *= 1 - h * h
        g["b"] = dh.sum(axis=0)
        at = g["w"].reshape(2 * SIDE, DIMS, HIDDEN)
        for k in range(2 * SIDE):
            sums = _sums_by(c[:, k], dh)
            at[k] = net["emb"].T @ sums
            g["emb"] += sums @ w[k].T
        moments["t"] += 1
        t = moments["t"]
        for k, v in net.items():
            m, s = moments[k]
            m += np.float32(0.1) * (g[k] - m)
            s += np.float32(0.01) * (g[k] * g[k] - s)
            v -= np.float32(RATE / (1 - 0.9**t)) * m / (np.sqrt(s / np.float32(1 - 0.99**t)) + np.float32(1e-6))


def log_probabilities(net: dict[str, np.ndarray], ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each word given both sides."""
    net = {k: v.astype(np.float32) for k, v in net.items()}
    tables = [net["emb"] @ net["w"][k * DIMS : (k + 1) * DIMS] for k in range(2 * SIDE)]
    out = np.empty(len(ids))
    for a in range(0, len(ids), SCORE):
        c, y = windows(ids, row, a, a + SCORE), ids[a : a + SCORE].astype(np.int64)
        h = tables[0][c[:, 0]] + net["b"]
        for k in range(1, 2 * SIDE):
            h += tables[k][c[:, k]]
        np.tanh(h, out=h)
        own = y // IN_CLASS
        got = h @ net["wc"] + net["bc"]
        p = got[np.arange(len(y)), own] - _log_sums(got)
        order = np.argsort(own.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(own[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                got = h[at] @ net["ww"][k] + net["bw"][k]
                p[at] += got[np.arange(len(at)), y[at] % IN_CLASS] - _log_sums(got)
        out[a : a + SCORE] = p
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, past last row, ids, row of each, sizes) of runs of rows of about READ bytes."""
    for i, j, data, offsets in slices(column, READ):
        sizes = np.diff(offsets) // 2
        yield i, j, data.view("<u2").astype(np.int64), np.repeat(np.arange(j - i), sizes), sizes


def _train(net: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, moments = {k: v.astype(np.float32) for k, v in net.items()}, {}
        context, target, n, seen = [], [], 0, 0

        def learn() -> None:
            nonlocal context, target, n
            if n:
                c, y = np.concatenate(context), np.concatenate(target)
                order = np.argsort(mix(np.arange(len(y), dtype=np.uint64) + np.uint64(seen)))
                steps(own, c[order], y[order], moments)
            context, target, n = [], [], 0

        for batch in batches:
            for _, _, ids, row, _ in _pieces(batch.column(0)):
                for a in range(0, len(ids), SHUFFLED):
                    context.append(windows(ids, row, a, a + SHUFFLED).astype(np.uint16))
                    target.append(ids[a : a + SHUFFLED])
                    n += len(target[-1])
                    seen += len(target[-1])
                    if n >= SHUFFLED:
                        learn()
        learn()
        if seen:
            names = list(own)
            whole = [np.rint(own[k].astype(float) * (seen * UNIT)).astype(np.int64).tobytes() for k in names]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(whole, pa.binary()), pa.array([seen] * len(names), pa.int64())], names=["part", "sums", "n"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    n: dict[str, int] = {}
    for batch in batches:
        for part, sums, seen in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            now = np.frombuffer(sums, np.int64)
            total[part] = total[part] + now if part in total else now
            n[part] = n.get(part, 0) + seen
    if not total:
        return
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary()), pa.array(list(n.values()), pa.int64())], names=["part", "sums", "n"])


def encode(docs: DataFrame, text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """docs with ids (16-bit little-endian) and rest (the log shares of words in their buckets, added up) in place of text, written once; how often each id occurs in all documents."""
    counted = written(docs.select(text).mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    # Below a millionth of all words none is worth a place of its own; so at most a million compete for them.
    top = counted.where(F.col("n") >= (total["n"] or 0) / 1e6).orderBy(F.desc("n"), "word").limit(WORDS).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    rare = counted.where(~F.col("word").isin([r["word"] for r in top])) if top else counted
    counts = np.zeros(SIZE)
    counts[: len(top)] = [r["n"] for r in top]
    for r in rare.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        counts[WORDS + r["bucket"]] = r["n"]
    size = 1 << min(MOST_CELLS, max(BUCKETS.bit_length(), (2 * total["words"]).bit_length()))
    by_cell = rare.groupBy(F.col("word").bitwiseAND(size - 1).cast("int").alias("cell")).agg(F.round(CELL_UNIT * F.log(F.sum("n") / F.count(F.lit(1)))).cast("short").alias("log"))
    got = by_cell.toArrow()
    cells = np.zeros(size, np.int16)
    cells[got.column(0).to_numpy()] = got.column(1).to_numpy()
    table = Words(words[order], order.astype(np.uint16), cells, np.log(np.maximum(counts[WORDS:], 1)))
    keep = [f for f in docs.schema.fields if f.name not in (text, "ids", "rest")]
    schema = T.StructType([*keep, T.StructField("ids", T.BinaryType()), T.StructField("rest", T.DoubleType())])
    return written(docs.select(*(f.name for f in keep), text).mapInArrow(_encode(text, table), schema)), counts


def fit(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after every document has been learnt from in one of the rounds."""
    net, kind = start(counts), "part string, sums binary, n long"
    for k in range(rounds):
        own = encoded.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == k).select("ids")
        # local results are added up part by part as they stream in; the driver gets one set of weights
        for r in reduced(own.mapInArrow(_train(net), kind), _average, "part", len(SHAPES)).collect():
            net[r["part"]] = np.frombuffer(r["sums"], np.int64).reshape(SHAPES[r["part"]]) / (r["n"] * UNIT)
    return net


def _scorer(net: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j, ids, row, sizes in _pieces(whole.column(whole.schema.get_field_index("ids"))):
                batch = whole.slice(i, j - i)
                sums = np.bincount(row, weights=log_probabilities(net, ids, row), minlength=j - i) if len(ids) else np.zeros(j - i)
                sums = sums + batch.column(batch.schema.get_field_index("rest")).to_numpy()
                mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
                yield with_columns(batch, {"ids", "rest"}, {"n_words": pa.array(sizes), "log_likelihood": pa.array(sums), "mean_log_likelihood": mean})

    return run


def score(encoded: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    keep = [f for f in encoded.schema.fields if f.name not in ("ids", "rest", "n_words", "log_likelihood", "mean_log_likelihood")]
    new = T.StructType.fromDDL("n_words long, log_likelihood double, mean_log_likelihood double").fields
    return encoded.select(*(f.name for f in keep), "ids", "rest").mapInArrow(_scorer(net), T.StructType([*keep, *new]))


def pseudo_likelihood(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_words, log_likelihood (sum over all words) and mean_log_likelihood."""
    encoded, counts = encode(docs, text)
    return score(encoded, fit(encoded, counts))

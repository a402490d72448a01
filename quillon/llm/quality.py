"""Quality classifier: random-indexing word vectors and a two-layer network.

Tokens are runs of letters, digits and non-ASCII characters, runs of other
visible characters, and two marks (a word equal to the one before it; a word
in capitals). Each hashed token has a sparse random index vector; its word
vector adds, over all documents, the index vectors of its neighbours. A
document is the mean of its tokens' vectors and its length. A two-layer numpy
network learns from a bounded sample of labelled rows; a temperature fitted
on rows the network has not seen calibrates its probabilities.

A null, empty or blank text has the zero vector. Rows and other columns pass
through; a column named like an output is replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._labels import fit_rows
from quillon.llm._store import reduced
from quillon.llm._text import LETTER, SPACE, Places, hash_runs, mix, slices, with_columns

BUCKETS, DIMS, MARKS, PART = 8192, 32, 2, 256
#: At most so many labelled rows of each class.
PER_CLASS = 3000
KIND = np.where(SPACE, 0, np.where(LETTER, 1, 2)).astype(np.uint8)
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def tokens(data: np.ndarray, offsets: np.ndarray, kept: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of each token in order, and the rows of the two marks."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none, none
    kind = KIND[data]
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    visible = kind[starts] > 0
    starts, ends = starts[visible], ends[visible]
    hashes = hash_runs(data, starts, ends, kept)
    row = np.searchsorted(offsets, starts, "right") - 1
    word = np.flatnonzero(kind[starts] == 1)
    again = word[1:][(hashes[word[1:]] == hashes[word[:-1]]) & (row[word[1:]] == row[word[:-1]])]
    capital = word[(ends[word] - starts[word] > 1) & UPPER[data[starts[word]]] & UPPER[data[ends[word] - 1]]]
    return (hashes % np.uint64(BUCKETS - MARKS)).astype(np.int64) + MARKS, row, row[again], row[capital]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is +1 and where it is -1."""
    h = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    plus = h % np.uint64(DIMS)
    return plus.astype(np.int64), ((plus + np.uint64(1) + (h >> np.uint64(32)) % np.uint64(DIMS - 1)) % np.uint64(DIMS)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, (plus, minus) = Places(), index_vectors()
    total = np.zeros(BUCKETS * DIMS, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            bucket, row, _, _ = tokens(data, offsets, kept)
            near = np.flatnonzero(row[1:] == row[:-1])
            left, right = bucket[near], bucket[near + 1]
            for a, b in ((left, right), (right, left)):
                total += np.bincount(a * DIMS + plus[b], minlength=len(total))
                total -= np.bincount(a * DIMS + minus[b], minlength=len(total))
    parts = total.reshape(-1, PART * DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = np.frombuffer(sums, np.int64)
            total[part] = total[part] + now if part in total else now
    if not total:
        return
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIMS word vectors; neighbour sums over all documents, added up where they are made."""
    kind = "part int, sums binary"
    parts = reduced(docs.select(text).mapInArrow(_contexts, kind), _add, "part", BUCKETS // PART).collect()
    context = np.zeros((BUCKETS // PART, PART * DIMS))
    for r in parts:
        context[r["part"]] += np.frombuffer(r["sums"], np.int64)
    context = context.reshape(BUCKETS, DIMS)
    own = np.zeros((BUCKETS, DIMS))
    plus, minus = index_vectors()
    own[np.arange(BUCKETS), plus] = 1
    own[np.arange(BUCKETS), minus] = -1
    length = np.sqrt((context * context).sum(axis=1, keepdims=True))
    return (own / np.sqrt(2) + 0.5 * context / np.maximum(length, 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, kept: Places) -> np.ndarray:
    """Each row's features: mean vector, shares of the marks, log length."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIMS + MARKS + 1), np.float32)
    bucket, row, again, capital = tokens(data, offsets, kept)
    if not len(bucket):
        return out
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = np.bincount(row, minlength=rows).astype(np.float32)
    out[row[begin], :DIMS] = np.add.reduceat(vectors[bucket], begin, axis=0)
    out[:, DIMS] = np.bincount(again, minlength=rows)
    out[:, DIMS + 1] = np.bincount(capital, minlength=rows)
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n) / 4
    return out


@dataclass
class Network:
    """mean, scale: of the inputs; two layers; the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, hidden: int = 24, steps: int = 600, decay: float = 1e-3) -> Network:
    """Adam over all rows, then the temperature on every fifth row, which the steps leave out."""
    rng = np.random.default_rng(0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-2)
    net = Network(vectors, mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    seen = np.arange(len(x)) % 5 != 4
    z, t, w = ((x - mean) / scale)[seen], y[seen], weight[seen] / weight[seen].sum()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    for step in range(1, steps + 1):
        h = np.tanh(z @ net.w1 + net.b1)
        p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40)))
        d = w * (p - t)
        back = d[:, None] * net.w2 * (1 - h * h)
        grads = (z.T @ back + decay * net.w1, back.sum(axis=0), h.T @ d + decay * net.w2, np.array([d.sum()]))
        moves = []
        for g, s in zip(grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            moves.append(0.02 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    if (~seen).any():
        out, t, w = net.logits(x[~seen]), y[~seen], weight[~seen]
        loss = lambda k: float((w * np.logaddexp(0, np.where(t == 1, -out, out) / k)).sum())
        net.temperature = min(np.geomspace(0.5, 8, 41).tolist(), key=loss)
    return net


def _pool_rows(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Places()
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                x = pooled(data, offsets, vectors, kept)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Network:
    """Learn from labels, at most per_class rows of each class, weighted to the classes' shares; word vectors come from all docs."""
    vectors = word_vectors(docs, text)
    sample, counts = fit_rows(labels, label, per_class, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    found = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in rows.mapInArrow(_pool_rows(vectors), "doc_id long, label int, x binary").dropDuplicates(["doc_id"]).toLocalIterator())
    if not found:
        x = np.zeros((1, DIMS + MARKS + 1), np.float32)
        return Network(vectors, x[0], x[0] + 1, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), 0.0)
    x = np.array([np.frombuffer(f[2], np.float32) for f in found])
    y = np.array([f[1] for f in found], float)
    share = np.array([counts[c] / max(1, (y == c).sum()) for c in (0, 1)])
    return train(x, y, share[y.astype(int)], vectors)


def _scorer(text: str, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Places()
        for batch in batches:
            got = [net.score(pooled(data, offsets, net.vectors, kept)) for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index(text)))]
            yield with_columns(batch, set(), {"score": pa.array(np.concatenate(got) if got else np.empty(0))})

    return run


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with score double, the probability of label 1."""
    keep = [f for f in docs.schema.fields if f.name != "score"]
    return docs.select(*(f.name for f in keep)).mapInArrow(_scorer(text, net), T.StructType([*keep, T.StructField("score", T.DoubleType())]))

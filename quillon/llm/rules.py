"""Quality rules with an isolation forest on rule statistics.

Base statistics of a text's words (maximal runs outside 0x20 and 0x09-0x0D):
word_chars, n_symbols, n_dup_lines, n_repeat_words; a text with fewer than ten
words, or over a fifth of its words in repeated 5-word windows, fails outright.
The others are judged by path lengths in random trees over the statistics as
they are, as shares (symbols and repeats) and as a mean (word length), at the
scale of their square roots. Each tree holds a few good rows; its splits are
drawn at random over the whole range that the statistics have among all
documents, so what lies outside of where good rows are is parted early and has
a short path. A tree's rows are drawn from all good labelled rows; where there
are enough, no two trees share a row. The anomaly threshold is calibrated on all
labelled rows: the one that separates best among those that reject at most a
given share of the good ones. Ranges come from all documents.

A null text has no words. Without good labelled rows the trees' rows are drawn
from all rows and nothing beyond the base rules is rejected. Equal statistics have
equal path lengths, so ties and repeated rows are judged alike. A very long
text is taken whole, in arrays of about a hundred bytes a word. Rows and other
columns pass through; columns named like an output are replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._labels import hash_sample
from quillon.llm._order import running
from quillon.llm._store import scratch, written
from quillon.llm._text import SPACE, Places, batch_bytes, hash_runs, mix, runs, slices, windows_hash, with_columns

SYMBOLS = b"#*$%&|<>"
REPEAT, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: The forest: trees, rows a tree, their depth at most.
TREES, TREE_ROWS, DEPTH = 128, 256, 12
MOST_GOOD_REJECTED = 0.002
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines"]


def repeated_words(words: np.ndarray, offsets: np.ndarray, kept: Places, n: int = REPEAT) -> np.ndarray:
    """Per row: words in n-word windows found twice or more in it."""
    rows = len(offsets) - 1
    whole = windows_hash(words, n)
    if not len(whole):
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    valid = np.arange(n, n + len(whole)) <= offsets[row[: len(whole)] + 1]
    at = np.flatnonzero(valid)
    code = mix(whole[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)


def dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _statistics(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Places()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j, data, offsets in slices(column):
                space = SPACE[data]
                starts, ends = runs(~space, offsets)
                at = np.searchsorted(starts, offsets)
                texts = batch_bytes(column.slice(i, j - i))
                lines = [dup_lines(t) for t in texts]
                words = hash_runs(data, starts, ends, kept)
                got = {
                    "n_words": np.diff(at),
                    "word_chars": _row_sums(~space & ((data & 0xC0) != 0x80), offsets),
                    "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts]),
                    "n_dup_lines": np.array([x[1] for x in lines]),
                    "n_repeat_words": repeated_words(words, at, kept),
                    "n_lines": np.array([x[0] for x in lines]),
                }
                yield with_columns(batch.slice(i, j - i), {text}, {k: pa.array(v.astype(np.int64)) for k, v in got.items()})

    return run


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with the rule statistics and base_failed."""
    new = [*STATISTICS, *EXTRA, "base_failed"]
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in new]
    schema = T.StructType([*keep, *(T.StructField(c, T.LongType()) for c in [*STATISTICS, *EXTRA])])
    out = docs.select(*(f.name for f in keep), text).mapInArrow(_statistics(text), schema)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


#: Each rule's statistic and what it is a share of.
SHARES = {"n_symbols": "word_chars", "n_dup_lines": "n_lines", "n_repeat_words": "n_words", "word_chars": "n_words"}


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of the statistics' shares; a text's length does not matter."""
    return np.sqrt(np.stack([x[of] / np.maximum(x[total], 1) for of, total in SHARES.items()], axis=1))


def feature_columns() -> list:
    """The same as Spark columns."""
    return [F.sqrt(F.col(of) / F.greatest(F.col(total), F.lit(1))) for of, total in SHARES.items()]


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: column, split, left child (the right one is next to it), path length at a leaf (else -1)."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more anomalous."""
        total = np.zeros(len(x))
        for column, split, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            live = np.flatnonzero(length[at] < 0)
            while len(live):
                a = at[live]
                at[live] = left[a] + (x[live, column[a]] >= split[a])
                live = live[length[at[live]] < 0]
            total += length[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(float(_expected(self.rows)), 1e-9))


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 0) -> Forest:
    """Trees over rows of x, dealt out if there are enough for all; low, high: the box that splits are drawn in, narrowed by each."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    dealt = len(x) >= trees * rows
    out = []
    for t in range(trees if rows else 0):
        nodes: list[list[float]] = [[0, 0, 0, -1]]
        todo = [(0, np.arange(t * rows, (t + 1) * rows) if dealt else rng.choice(len(x), rows, replace=False), 0, low, high)]
        while todo:
            node, own, deep, least, most = todo.pop()
            free = np.flatnonzero(most > least)
            if deep >= depth or len(own) < 2 or not len(free):
                nodes[node][3] = deep + float(_expected(len(own)))
                continue
            c = int(rng.choice(free))
            s = float(rng.uniform(least[c], most[c]))
            right = x[own, c] >= s
            nodes[node][:3] = [c, s, len(nodes)]
            place = np.arange(len(least)) == c
            todo += [(len(nodes), own[~right], deep + 1, least, np.where(place, s, most)), (len(nodes) + 1, own[right], deep + 1, np.where(place, s, least), most)]
            nodes += [[0, 0, 0, -1], [0, 0, 0, -1]]
        n = np.array(nodes, float)
        out.append((n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3]))
    return Forest(out, rows)


def threshold(scores: np.ndarray, good: np.ndarray, most: float = MOST_GOOD_REJECTED) -> float:
    """The score that separates best (share of bad rejected less share of good rejected) and rejects at most `most` of the good."""
    if good.all() or not len(scores):
        return 1.0
    steps = np.append(np.unique(scores), 1.0)
    bad = 1 - np.searchsorted(np.sort(scores[~good]), steps, "left") / max(1, (~good).sum())
    lost = 1 - np.searchsorted(np.sort(scores[good]), steps, "left") / max(1, good.sum())
    fit = np.where(lost <= most, bad - lost, -1)
    best = int(np.argmax(fit))
    below = scores[scores < steps[best]]
    return float((steps[best] + below.max()) / 2) if len(below) else float(steps[best])


def calibrated(scored: DataFrame, most: float = MOST_GOOD_REJECTED) -> float:
    """threshold over rows (anomaly, good boolean), as many as there are: counts at each score and their running sums from the highest. Infinite where no score will do."""
    counts = written(scored.groupBy((-F.col("anomaly")).alias("low")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    total = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return np.inf
    sums = running(counts, None, ["low"], {"good_before": "good", "bad_before": "bad"})
    good, bad = F.col("good_before") + F.col("good"), F.col("bad_before") + F.col("bad")
    gain = (bad * F.lit(total["good"]) - good * F.lit(total["bad"])).alias("gain")
    best = sums.where(good <= most * total["good"]).agg(F.max(F.struct(gain, "low")).alias("best")).first()["best"]
    if best is None or best["gain"] < 0:
        return np.inf
    below = counts.where(F.col("low") > best["low"]).agg(F.min("low").alias("low")).first()["low"]
    return -best["low"] if below is None else -(best["low"] + below) / 2


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in [*STATISTICS, *EXTRA]}
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(features(x))), batch.column(batch.schema.get_field_index("good"))], names=["anomaly", "good"])

    return run


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> Forest:
    """Grow the forest on rows drawn from all good ones that pass the base rules, over the ranges of all documents that do; set its threshold on all labelled ones."""
    names = [*STATISTICS, *EXTRA]
    passing = measured.where(~F.col("base_failed")).select(F.col(doc_id).cast("long").alias("doc_id"), *names)
    ranges = passing.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate(feature_columns()) for k, f in (("low", F.min), ("high", F.max)))).first()
    if not ranges["n"]:
        return Forest([], 0)
    low, high = (np.array([ranges[f"{k}{i}"] for i in range(len(SHARES))]) for k in ("low", "high"))
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg((F.max(F.col(label)) == 1).alias("good"))
    with scratch():
        labelled = written(passing.join(known, "doc_id"))
        n = labelled.agg(F.count_if("good").alias("good")).first()["good"]
        drawn = hash_sample(labelled.where("good") if n else passing, TREES * TREE_ROWS, n or ranges["n"], "doc_id", *names).collect()
        forest = grow(features({c: np.array([r[c] for r in drawn], float) for c in names}), low, high)
        if n:
            forest.threshold = calibrated(labelled.mapInArrow(_scored(forest), "anomaly double, good boolean"))
    return forest


def _judge(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in [*STATISTICS, *EXTRA]}
            failed = batch.column(batch.schema.get_field_index("base_failed")).to_numpy(zero_copy_only=False)
            scores = np.zeros(len(failed))
            if forest.trees and (~failed).any():
                scores[~failed] = forest.score(features({k: v[~failed] for k, v in x.items()}))
            yield with_columns(batch, set(), {"anomaly": pa.array(scores), "kept": pa.array(~failed & (scores < forest.threshold))})

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id") -> DataFrame:
    """docs without text, with the statistics, base_failed, anomaly double and kept boolean. Texts are read once; the statistics are written to the shared folder."""
    measured = written(statistics(docs, text))
    forest = fit(measured, labels, label, doc_id)
    keep = [f for f in measured.schema.fields if f.name not in ("anomaly", "kept")]
    schema = T.StructType([*keep, T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return measured.select(*(f.name for f in keep)).mapInArrow(_judge(forest), schema)

"""Toxicity from the nearest labelled examples.

Terms are lower-case words. A bounded sample of labelled rows gives the
examples, and all their terms are the vocabulary: none is left out. Examples
and documents are TF-IDF vectors over it; document counts for the idf run over
all documents, and a term's weight is scaled by how strongly it goes with the
label among the examples (log-likelihood ratio, near copies counted once), on
top of a floor that every term has. The inverted index holds the examples'
weights by term and block and the largest weight of each term in each block (terms that a tenth of the examples
have are rows of a matrix instead, and add what they give themselves to a block's
bound): blocks are visited by falling upper bound until no bound can reach the
k-th similarity, so the k nearest by cosine are exact (ties, which are
similarities within a millionth: the smaller example number). Votes are weighted by distance and mapped to probabilities by isotonic
regression on leave-one-out votes, weighted to the classes' shares among all
rows to learn from.

A null, empty or blank text, and any text without a vocabulary term, gets the
toxic share of such examples. Of several rows with one labelled doc_id the text
that is least in order is the example; repeated rows are scored alike. A very
long text is taken whole, in arrays of about a hundred bytes a word. Rows and
other columns pass through; columns named like an output are replaced.
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
from quillon.llm._text import LETTER, LOWER, Lookup, Places, hash_runs, lowered_slices, runs, windows_hash, with_columns

#: At most so many labelled rows of each class; neighbours that vote; examples a block; blocks visited at first.
PER_CLASS, NEIGHBOURS, BLOCK, FIRST = 1500, 15, 64, 8
#: Share of the strongest term's weight that a term without any bond with the label keeps.
FLOOR = 0.01
#: Terms in one of so many examples or more are rows of a matrix. Similarities this close are ties: sums of rounded numbers differ.
FREQUENT, CLOSE = 10, 1e-6
#: Documents whose frequent terms are taken at once.
ROWS = 256
#: Scored vectors that are kept for copies.
KNOWN = 2000
#: Terms whose document counts are added up together.
PART = 1 << 14


def terms(data: np.ndarray, offsets: np.ndarray, kept: Places) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends = runs(LETTER[data], offsets)
    return hash_runs(LOWER[data], starts, ends, kept), np.searchsorted(offsets, starts, "right") - 1


def expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each range of n in turn."""
    ends = np.cumsum(n)
    out = np.repeat((first - (ends - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def least_shingle(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Least hash of a row's five-word shingles (0: none): near copies mostly share it."""
    out = np.zeros(rows, np.uint64)
    whole = windows_hash(words, 5)
    at = np.flatnonzero(row[: len(whole)] == row[4 : 4 + len(whole)])
    if len(at):
        own = row[at]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[begin]] = np.minimum.reduceat(whole[at], begin)
    return out


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each comes."""
    code = np.sort(code)
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    return code[at], np.diff(np.append(at, len(code)))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = Places()
    for batch in batches:
        for i, j, data, offsets in lowered_slices(batch.column(2)):
            words, row = terms(data, offsets, kept)
            known, word = np.unique(words, return_inverse=True)
            code, n = counted(row * max(1, len(known)) + word)
            off = np.searchsorted(code // max(1, len(known)), np.arange(j - i + 1))
            term = known[code % max(1, len(known))].astype("<u8").tobytes()
            count = n.astype("<i4").tobytes()
            packed = [[raw[a * w : b * w] for a, b in zip(off, off[1:], strict=False)] for raw, w in ((term, 8), (count, 4))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(x, pa.binary()) for x in packed), pa.array(least_shingle(words, row, j - i).view(np.int64))], names=["doc_id", "label", "terms", "counts", "copy"])


def vectors(data: np.ndarray, offsets: np.ndarray, lookup: Lookup, kept: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the vocabulary terms in each row, in order."""
    words, row = terms(data, offsets, kept)
    at, term = lookup(words)
    size = max(1, len(lookup.sorted))
    code, n = counted(row[at] * size + term)
    return code // size, code % size, n


def _document_counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, lookup, total = Places(), Lookup(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, data, offsets in lowered_slices(batch.column(0)):
                _, term, _ = vectors(data, offsets, lookup, kept)
                total[: len(vocabulary)] += np.bincount(term, minlength=len(vocabulary))
        parts = range(0, len(total), PART)
        yield pa.RecordBatch.from_arrays([pa.array([k // PART for k in parts], pa.int32()), pa.array([total[k : k + PART].tobytes() for k in parts], pa.binary())], names=["part", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = np.frombuffer(sums, np.int64)
            total[part] = total[part] + now if part in total else now
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])


@dataclass
class Index:
    """Examples by term, in blocks, and the calibration of votes. scale: each term's weight in all, idf and bond with the label."""

    vocabulary: np.ndarray
    scale: np.ndarray
    begin: np.ndarray  # where each term's postings begin
    example: np.ndarray  # postings: examples, ascending in each term
    weight: np.ndarray  # and their weights in unit vectors
    labels: np.ndarray
    doc_ids: np.ndarray
    share: np.ndarray  # of the classes: weight of an example
    votes: np.ndarray | None = None
    scores: np.ndarray | None = None
    none: float = 0.0

    def open(self) -> "Index":
        """Lay the postings out where they are used: frequent terms as rows of a matrix, for others the blocks that each is in, its largest weight in each and where their postings begin."""
        n, size = len(self.labels), np.diff(self.begin)
        self.blocks = max(1, -(-n // BLOCK))
        often = np.flatnonzero(size * FREQUENT >= max(n, 1))
        self.row = np.full(len(self.vocabulary), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        term = np.repeat(np.arange(len(self.vocabulary)), size)
        common = self.row[term] >= 0
        self.rows[self.row[term[common]], self.example[common]] = self.weight[common]
        term, self.rare_example, self.rare_weight = term[~common], self.example[~common], self.weight[~common]
        cell = term * self.blocks + self.rare_example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        self.block = (cell[first] % self.blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.rare_weight, first) if len(cell) else self.rare_weight
        self.cells = np.searchsorted(cell[first], np.arange(len(self.vocabulary) + 1) * self.blocks)
        self.first = np.append(first, len(cell)).astype(np.int32)
        return self

    def close(self) -> None:
        del self.row, self.rows, self.rare_example, self.rare_weight, self.block, self.top, self.cells, self.first

    def common(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """What the frequent terms of each row add to its similarity to every example."""
        at = self.row[term]
        asked = np.zeros((rows, len(self.rows)), np.float32)
        asked[row[at >= 0], at[at >= 0]] = weight[at >= 0]
        return asked @ self.rows

    def similarities(self, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """To all examples, of which those in the cells' blocks are right; weight: of the asked text's term in each cell."""
        first = self.first[cells]
        n = self.first[cells + 1] - first
        at = expand(first, n)
        return np.bincount(self.rare_example[at], np.repeat(weight, n) * self.rare_weight[at], minlength=self.blocks * BLOCK)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a positive cosine and their cosines, exactly: first the blocks of the largest bounds, then the others, those whose bound does not reach the k-th so far left out.

        A block's bound is the largest sum over its frequent terms (common) and the rare terms' largest weights in it.
        """
        if common is None:
            common = self.common(np.zeros(len(term), np.int64), term, weight, 1)[0]
        rare = self.row[term] < 0
        n = self.cells[term[rare] + 1] - self.cells[term[rare]]
        cells, weight = expand(self.cells[term[rare]], n), np.repeat(weight[rare], n)
        block = self.block[cells]
        bound = np.bincount(block, weight * self.top[cells], minlength=self.blocks) + common.reshape(-1, BLOCK).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        best, sims, least = np.empty(0, np.int64), np.empty(0), 0.0
        for some in (order[:FIRST], order[FIRST:]):
            some = some[bound[some] > least]
            if not len(some):
                break
            inside = np.zeros(self.blocks, bool)
            inside[some] = True
            mine = inside[block]
            s = self.similarities(cells[mine], weight[mine]) + common
            s = np.where(np.repeat(inside, BLOCK), s, 0)
            if without >= 0:
                s[without] = 0
            at = np.flatnonzero(s > least)
            if len(at) > k:  # only those that can be among the k, ties included
                at = at[s[at] >= np.partition(s[at], -k)[-k] - CLOSE]
            best, sims = np.concatenate([best, at]), np.concatenate([sims, s[at]])
            top = np.lexsort((best, -np.round(sims / CLOSE)))[:k]
            best, sims = best[top], sims[top]
            least = max(0.0, sims[k - 1] - CLOSE) if len(sims) >= k else 0.0
        return best, sims

    def weigh(self, term: np.ndarray, n: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """Weights of the terms of one text, or of each row's."""
        w = (1 + np.log(n)) * self.scale[term]
        squares = (w * w).sum() if row is None else np.bincount(row, w * w)[row]
        return w / np.sqrt(squares)

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(sims, 1)) * self.share[self.labels[best]]
        return float((w * self.labels[best]).sum() / w.sum())

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.scores))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step heights by pooling adjacent violators, at the mean x of each pool."""
    pools: list[list[float]] = []
    for a in np.argsort(x, kind="stable").tolist():
        pools.append([x[a] * w[a], y[a] * w[a], w[a]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] - 1e-12:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def evidence(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of terms' counts against no bond with the label."""
    t, c = t.astype(float), c.astype(float)
    total, n = toxic + clean, t + c
    out = np.zeros(len(t))
    for seen, expected in ((t, n * toxic), (c, n * clean), (toxic - t, (total - n) * toxic), (clean - c, (total - n) * clean)):
        at = (seen > 0) & (expected > 0)
        out[at] += 2 * seen[at] * np.log(seen[at] * total / expected[at])
    return np.maximum(out, 0)


def build(examples: list[tuple[int, int, np.ndarray, np.ndarray, int]], counts: dict[int, int], documents) -> Index:
    """The index of (doc_id, label, term hashes, counts, copy) in order. documents: vocabulary to (documents, documents with each term)."""
    vocabulary, flat = np.unique(np.concatenate([e[2] for e in examples]) if examples else np.empty(0, np.uint64), return_inverse=True)
    total, having = documents(vocabulary)
    size = np.array([len(e[2]) for e in examples], np.int64)
    label, copy = np.array([e[1] for e in examples], np.int64), np.array([e[4] or e[0] for e in examples], np.int64)
    # Near copies are one piece of evidence: count distinct copies of each class by term.
    _, kind = np.unique(np.stack([label, copy], axis=1), axis=0, return_inverse=True) if examples else (None, copy)
    first = np.unique(kind.ravel(), return_index=True)[1]
    kinds = max(1, len(first))
    pair = np.unique(flat.astype(np.int64) * kinds + np.repeat(kind.ravel(), size))
    by = [np.bincount(pair[label[first][pair % kinds] == y] // kinds, minlength=len(vocabulary)) for y in (0, 1)]
    strength = evidence(by[1], by[0], int((label[first] == 1).sum()), int((label[first] == 0).sum()))
    scale = (np.log((1 + total) / (1 + having)) + 1) * (FLOOR + strength / max(strength.max(initial=0), 1e-9))
    known = [(e[0], e[1], flat[b - n : b], e[3]) for e, n, b in zip(examples, size, np.cumsum(size), strict=True)]
    sizes = np.array([(label == y).sum() for y in (0, 1)])
    share = np.array([counts[y] / max(1, sizes[y]) for y in (0, 1)])
    blank = [e for e in known if not len(e[2])]
    # Examples with the same strongest term stand together, so that few blocks have a large top for it.
    known = sorted((e for e in known if len(e[2])), key=lambda e: (int(e[2][np.argmax((1 + np.log(e[3])) * scale[e[2]])]), e[0]))
    index = Index(vocabulary, scale, None, None, None, np.array([e[1] for e in known], np.int64), np.array([e[0] for e in known], np.int64), share)
    weighed = [index.weigh(e[2], e[3]) for e in known]
    own = np.repeat(np.arange(len(known)), [len(e[2]) for e in known])
    term = np.concatenate([e[2] for e in known]) if known else np.empty(0, np.int64)
    order = np.lexsort((own, term))
    index.example, index.weight = own[order].astype(np.int32), (np.concatenate(weighed) if known else np.empty(0)).astype(np.float32)[order]
    index.begin = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    base = counts[1] / max(1, counts[0] + counts[1])
    index.none = (sum(share[1] for e in blank if e[1]) + base) / (sum(share[e[1]] for e in blank) + 1)
    votes, weight, right = [0.0, 1.0], [1e-3, 1e-3], [base, max(base, 0.5)]
    opened = index.open()
    for k, (e, w) in enumerate(zip(known, weighed, strict=True)):
        best, sims = opened.nearest(e[2], w, without=k)
        if len(best):
            votes.append(index.vote(best, sims))
            weight.append(share[e[1]])
            right.append(float(e[1]))
    index.votes, index.scores = isotonic(np.array(votes), np.array(right), np.array(weight))
    index.close()
    return index


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Index:
    """Learn from labels, at most per_class rows of each class; document counts run over all docs."""
    sample, counts = fit_rows(labels, label, per_class, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text")
    found = rows.mapInArrow(_term_lists, "doc_id long, label int, terms binary, counts binary, copy long").collect()
    examples = [(r["doc_id"], r["label"], np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["counts"], "<i4"), r["copy"]) for r in sorted(found, key=lambda r: r["doc_id"])]

    def documents(vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
        parts = -(-(len(vocabulary) + 1) // PART)
        got = reduced(docs.select(text).mapInArrow(_document_counts(vocabulary), "part int, sums binary"), _add, "part", parts).collect()
        n = np.zeros(parts * PART, np.int64)
        for r in got:
            own = np.frombuffer(r["sums"], np.int64)
            n[r["part"] * PART : r["part"] * PART + len(own)] += own
        return int(n[len(vocabulary)]), n[: len(vocabulary)]

    return build(examples, counts, documents)


def _scorer(text: str, index: Index, evidence: int):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, lookup = Places(), Lookup(index.vocabulary)
        index.open()
        known: dict[tuple, tuple] = {}
        for batch in batches:
            for i, j, data, offsets in lowered_slices(batch.column(batch.schema.get_field_index(text))):
                row, term, n = vectors(data, offsets, lookup, kept)
                at = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                scores, why, done = np.full(j - i, index.none), [[]] * (j - i), 0
                weight = index.weigh(term, n, row)
                for k in np.unique(row).tolist():
                    a, b = at[k], at[k + 1]
                    if k >= done:  # the frequent terms of the next rows at once
                        begin, done = k, min(k + ROWS, j - i)
                        own = slice(at[begin], at[done])
                        common = index.common(row[own] - begin, term[own], weight[own], done - begin)
                    key = term[a:b].tobytes(), n[a:b].tobytes()
                    if key not in known:
                        best, sims = index.nearest(term[a:b], weight[a:b], common=common[k - begin])
                        if len(known) > KNOWN:
                            known.clear()
                        known[key] = (index.score(index.vote(best, sims)), [{"doc_id": int(index.doc_ids[x]), "label": int(index.labels[x]), "similarity": float(s)} for x, s in zip(best[:evidence], sims, strict=False)]) if len(best) else (index.none, [])
                    scores[k], why[k] = known[key]
                yield with_columns(batch.slice(i, j - i), set(), {"score": pa.array(np.clip(scores, 0, 1)), "evidence": pa.array(why, kind)})

    return run


def score(docs: DataFrame, index: Index, text: str = "text", evidence: int = 3) -> DataFrame:
    """docs with score double and evidence array<struct<doc_id, label, similarity>> (the nearest examples)."""
    new = T.StructType.fromDDL("score double, evidence array<struct<doc_id: bigint, label: int, similarity: double>>")
    keep = [f for f in docs.schema.fields if f.name not in ("score", "evidence")]
    return docs.select(*(f.name for f in keep)).mapInArrow(_scorer(text, index, evidence), T.StructType([*keep, *new.fields]))

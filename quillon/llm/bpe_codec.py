"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text into chunks whose borders
depend on content alone, so passages shared by documents give equal chunks. A
chunk is encoded once and its ids are kept for the other documents that a
task meets. A border may fall inside a word: such a join is repaired
by encoding the whole word anew, from the white space before the border to
that after it. No merge, normalisation or special token of the tokenizer
reaches over ASCII white space, so what the join and the chunks beside it give
then agrees exactly with encoding the whole text. Inside a new chunk words are
encoded once and kept, too.

Whether a tokenizer splits at white space is read from its file; with one that
is not known to, texts are encoded whole.

The two stores are bounded per Python worker, emptied at the end of a task, hold
the bytes themselves as keys and only save time; results never depend on them. Null and empty texts
give no ids and an empty decoded text. A very long text is one run of chunks
and held whole, in about ten times its bytes. Rows and their other columns
pass through; columns named like an output are replaced.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm._text import SPACE, mix, release, runs, slices, with_columns

ROLL, CHUNK = 16, 128
#: Kept in each of the two generations of a store; words encoded at once; bytes of text taken at once.
MAX_WORDS, MAX_CHUNKS, TOGETHER, RUN_BYTES = 150_000, 50_000, 256, 1 << 18
#: Normalisers and splitters that never join what white space parts.
PLAIN = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
SPLITTERS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
SPLIT_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: Words with characters beyond U+02FF, or with what may be a special token, are encoded alone.
ODD = re.compile(rb"[\xcc-\xff]|<\|").search


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each range in turn."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer (its file's content) is known to encode what white space parts apart."""
    parts = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    normal = parts(spec.get("normalizer"), "normalizers")
    split = parts(spec.get("pre_tokenizer"), "pretokenizers")[:1]
    return (
        all(x["type"] in PLAIN or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal)
        and all(x["type"] in SPLITTERS or x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed" and x["pattern"].get("Regex") in SPLIT_PATTERNS for x in split)
        and bool(split)
        and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    )


class Store:
    """Ids by bytes, in two generations: what is not met while one fills is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """Those of keys not kept; the others are in now afterwards."""
        out = []
        for k in keys.difference(self.now):
            if (found := self.old.get(k)) is None:
                out.append(k)
            else:
                self.now[k] = found
        return out

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.old, self.now = self.now, {}

    def clear(self) -> None:
        self.now, self.old = {}, {}


class Codec:
    """One tokenizer and its stores of chunks and words in one Python worker."""

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pieces = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(size)]
        self.pieces, self.lengths = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.joined = self.tokenizer.decoder is None
        self.words, self.chunks = Store(MAX_WORDS), Store(MAX_CHUNKS)
        self.gear = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
        with open(path, encoding="utf-8") as f:
            self.parted = splits_at_space(json.load(f))

    def forget(self) -> None:
        """Empty the stores: a worker is kept after a task, for steps that need its memory."""
        self.words.clear()
        self.chunks.clear()
        release()

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has): plain words many at a time, offsets telling whose an id is."""
        odd = [k for k, w in enumerate(words) if ODD(w)]
        alone = {k: self.tokenizer.encode(words[k].decode(), add_special_tokens=False).ids for k in odd}
        plain = np.delete(np.arange(len(words)), odd)
        parts, n = [], np.zeros(len(words), np.int64)
        for a in range(0, len(plain), TOGETHER):
            own = plain[a : a + TOGETHER]
            text = b" ".join([words[k] for k in own.tolist()]).decode()
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32) + 1])
            begin = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0]
            n[own] = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))
            parts.append(np.array(encoded.ids, "<u4"))
        ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
        if odd:
            ends = np.cumsum(n)
            ids = np.insert(ids, np.repeat(ends[odd], [len(alone[k]) for k in odd]), [i for k in odd for i in alone[k]])
            n[odd] = [len(alone[k]) for k in odd]
        return ids, n

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chunk borders: where the rolling hash of the ROLL bytes before says so inside a row, and the rows' own."""
        roll, size, times = self.gear[data], 1, 0x9E3779B1
        while size < ROLL and len(roll) > size:
            roll = roll[:-size] * np.uint32(times) + roll[size:]
            size, times = 2 * size, times * times & 0xFFFFFFFF
        at = np.flatnonzero(roll < np.uint32((1 << 32) // CHUNK)) if len(data) >= ROLL else np.empty(0, np.int64)
        inside = at + ROLL <= offsets[np.searchsorted(offsets, at, "right")] if len(at) else np.empty(0, bool)
        return np.unique(np.concatenate([at[inside] + ROLL, offsets]))

    def borders(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the joins: the word that a border cuts, or nothing where it cuts none. Chunks are what is between."""
        cuts = self.cuts(data, offsets)
        starts, ends = runs(~SPACE[data], offsets)
        if not len(starts):
            return cuts, cuts
        word = np.searchsorted(starts, cuts, "left") - 1
        cut = (word >= 0) & (ends[word] > cuts)
        begin, end = np.where(cut, starts[word], cuts), np.where(cut, ends[word], cuts)
        new = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])])
        return begin[new], end[new]

    def encode_runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's begin) of rows in one buffer."""
        begin, end = self.borders(data, offsets)
        raw, b, e = data.tobytes(), begin.tolist(), end.tolist()
        joins = [raw[i:j] for i, j in zip(b, e, strict=True)]
        chunks = [raw[i:j] for i, j in zip(e, b[1:], strict=False)]
        new = {c: c.split() for c in self.chunks.missing(set(chunks))}
        known, kept = self.words.now, self.chunks.now
        some = set(joins)
        for w in new.values():
            some.update(w)
        some.discard(b"")
        if lack := self.words.missing(some):
            ids, n = self.learn(lack)
            flat, at = ids.tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
            known.update((w, flat[i:j]) for w, i, j in zip(lack, at, at[1:], strict=False))
        kept.update((c, b"".join([known[w] for w in ws])) for c, ws in new.items())
        pieces = [b""] * (2 * len(joins) - 1)
        pieces[::2] = [known[w] if w else b"" for w in joins]
        pieces[1::2] = [kept[c] for c in chunks]
        before = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]) // 4
        self.words.turn()
        self.chunks.turn()
        return np.frombuffer(b"".join(pieces), "<u4"), before[2 * np.searchsorted(begin, offsets)]

    def encode_whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each row's begin, decoded bytes, where each row's begin) of rows in one buffer."""
        ids, id_rows = (self.encode_runs if self.parted else self.encode_whole)(data, offsets)
        text = self.pieces[expand(self.places[ids], self.lengths[ids])]
        text_rows = np.concatenate([[0], np.cumsum(self.lengths[ids])])[id_rows]
        some = text_rows[1:] > text_rows[:-1]
        keep = np.ones(len(text), bool)
        keep[text_rows[1:][some] - 1] = False  # the space after a row's last piece
        return ids, id_rows, text[keep], text_rows - np.concatenate([[0], np.cumsum(some)])

    def columns(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        ids, id_rows, text, text_rows = self.encode(data, offsets)
        n = len(offsets) - 1
        packed = lambda kind, at, values: pa.Array.from_buffers(kind, n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
        if self.joined:
            decoded = packed(pa.string(), text_rows, text)
        else:
            decoded = pa.array([self.tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(id_rows, id_rows[1:], strict=False)], pa.string())
        return {"n_tokens": pa.array(np.diff(id_rows)), "ids": packed(pa.binary(), 4 * id_rows, ids), "decoded": decoded}


def _codec(path: str | None) -> Codec:
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_quillon_codecs", {})  # for as long as the worker lives
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def _encoder(text: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        try:
            for batch in batches:
                for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text)), RUN_BYTES):
                    yield with_columns(batch.slice(i, j - i), {text}, codec.columns(data, offsets))
        finally:
            codec.forget()

    return run


def bpe_codec(docs: DataFrame, text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """docs without text, with n_tokens long, ids binary (little-endian unsigned 32-bit) and decoded string.

    tokenizer_path: a tokenizers JSON file readable on every executor (default:
    the public word_bpe_49k.json installed there).
    """
    out = ["n_tokens", "ids", "decoded"]
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in out]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(*(f.name for f in keep), text).mapInArrow(_encoder(text, tokenizer_path), schema)

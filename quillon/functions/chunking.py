"""Chunkers: one text to several passages."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = re.compile(r"(?<=[.!?;:])\s+")


def sliding_chunks(text: Column, words: int = 300, step: int = 250, least_chars: int = 50) -> Column:
    """Windows of `words` words every `step`; texts under least_chars give none, short ones a single chunk."""
    parts = F.split(F.trim(text), r"\s+")
    n = F.size(parts)
    many = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.array_join(F.slice(parts, i + 1, words), " "))
    none = F.array().cast("array<string>")
    return F.when(F.char_length(F.coalesce(text, F.lit(""))) < least_chars, none).when(n <= words, F.array(F.array_join(parts, " "))).otherwise(many)


def pack_sentences(text: str | None, target: int, overlap: int, strict: bool = False, cut: int = 0) -> list[str]:
    """Whole sentences up to target words a chunk; each chunk repeats the last ones of the one before.

    strict: what is repeated stays within overlap words and may be nothing;
    else at least one sentence is repeated. cut: longer sentences are cut.
    """
    units = []
    for s in MARK.split((text or "").strip()):
        w = s.split()
        units += [w[k : k + cut] for k in range(0, len(w), cut)] if cut and len(w) > cut else [w] if w else []
    out, now, size = [], [], 0
    for unit in units:
        if now and size + len(unit) > target:
            out.append(" ".join(" ".join(u) for u in now))
            back, n = [], 0
            for u in reversed(now):
                if n + len(u) > overlap and (back or strict):
                    break
                back.insert(0, u)
                n += len(u)
            now, size = back, n
        now.append(unit)
        size += len(unit)
    if now:
        out.append(" ".join(" ".join(u) for u in now))
    return out


#: The four sentence chunkers in use: statutes, records, record batches, rebuilt fragments.
PRESETS = {"statutes": (180, 45, False, 0), "records": (150, 40, False, 0), "batches": (150, 40, True, 0), "rebuilt": (200, 40, False, 200)}


#: Bytes of chunks that a worker holds before it passes them on; a single text may be longer.
HELD = 1 << 20


def _sentences(preset: str):
    """A mapInArrow step: the last column's texts to a row a chunk, passed on as they come, with the other columns repeated."""
    target, overlap, strict, cut = PRESETS[preset]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keep, texts = batch.columns
            names = [*batch.schema.names[:-1], "chunk_no", "chunk"]
            at, places, chunks, held = [], [], [], 0
            for i in range(batch.num_rows):
                own = pack_sentences(texts[i].as_py(), target, overlap, strict, cut)
                at += [i] * len(own)
                places += range(1, len(own) + 1)
                chunks += own
                held += sum(map(len, own))
                if chunks and (held >= HELD or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in keep), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], names=names)
                    at, places, chunks, held = [], [], [], 0
            if chunks:  # the last texts had none
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in keep), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], names=names)

    return run


def explode_sentences(df: DataFrame, preset: str, text: str, *keep: str) -> DataFrame:
    """One row per chunk of whole sentences with its place from 1. A worker holds a few chunks at a time, not those of a batch."""
    rows = df.select(*keep, text)
    kinds = [*rows.schema.fields[:-1], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())]
    return rows.mapInArrow(_sentences(preset), T.StructType(kinds))


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk with its place from 1."""
    return df.select(*keep, F.posexplode(chunks).alias("pos", "chunk")).select(*keep, (F.col("pos") + 1).alias("chunk_no"), "chunk")

"""Spelling variants: words one edit apart, found by their rarest bigrams, and the form each stands for.

Two words one insertion, deletion or replacement apart keep all but two of the
longer one's bigrams. With all bigrams ranked by frequency, rarest first, one of
the three rarest of either word is therefore among the three rarest of the
other, at the same place or one further (if the third's bigram is in a word
more than once, all its places count). Words meet on such a bigram only with
equal place, equal or next length, and all of the word that one edit cannot have
touched: the edit is on one side of the bigram, in one half of that side, so the
other side and the other half are in the join key, as a hash. What meets is
verified letter by letter, so the hash decides nothing, and no pair is lost.

A key holds the words that share a rare bigram with its place and at least half
of their letters, and large ones are split by adaptive execution; bigrams are
at most the square of the alphabet (90 letters as a default) and counted over
all words. Words of less than four letters have no three bigrams and are never near
one another here; the default takes words of seven or more.

Null texts have no words; a null identifier counts as an empty one; repeated
rows count as often as they occur; other columns are ignored; an empty table
has no words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._store import discard, scratch, written
from quillon.llm._text import ODD, mix, sums_of

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word's form is at least so many times as frequent.
TIMES = 10
KEYS = "key long, word string, n long, longer boolean"


def word_counts(docs: DataFrame, least: int = 7, spoil: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all whole texts: maximal runs of letters with A-Z in lower case, of `least` code points or more, found twice or more.

    spoil, over columns id (string) and run, gives another word in a run's place.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    words = runs.select((F.col("run") if spoil is None else spoil).alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def _ranks(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams as sorted numbers, and the rank of each by frequency over all words, rarest first."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, 2)))
    found = words.where(F.char_length("word") > 1).select(pair.alias("pair")).groupBy("pair").count().collect()
    found = sorted(((r["count"], r["pair"]) for r in found))
    codes = np.array([ord(p[0]) << 32 | ord(p[1]) for _, p in found], np.int64)
    order = np.argsort(codes)
    return codes[order], order.astype(np.int64)


def _anchors(cps: np.ndarray, offsets: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of the three rarest bigrams of each word, and of further ones like the third."""
    sizes = np.diff(offsets)
    pairs = np.maximum(sizes - 1, 0)
    word = np.repeat(np.arange(len(sizes)), pairs)
    starts = np.cumsum(pairs) - pairs
    place = np.arange(len(word)) - starts[word]
    at = offsets[:-1][word] + place
    rank = ranks[1][np.searchsorted(ranks[0], cps[at].astype(np.int64) << 32 | cps[at + 1])]
    order = np.lexsort((rank, word))
    third = np.full(len(sizes), -1)
    enough = pairs >= 3
    third[enough] = rank[order[starts[enough] + 2]]
    taken = rank <= third[word]
    return word[taken], place[taken]


def _keys(text: np.ndarray, offsets: np.ndarray, word: np.ndarray, place: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of each place's bigram: what one edit leaves of the word around it.

    longer: keys as of a word with a letter less, that letter being on either side of the bigram.
    """
    sizes = np.diff(offsets)
    own = np.repeat(np.arange(len(sizes)), sizes)
    index = np.arange(len(text))
    heads = sums_of(mix(text + (index - offsets[own]).astype(np.uint64) * ODD))
    tails = sums_of(mix(~text + (offsets[own + 1] - index).astype(np.uint64) * ODD))
    out = []
    for side in (0, 1):
        w, p, n = word, place - (longer and side), sizes[word] - longer
        fits = (p >= 0) & (p + 2 <= n)
        w, p, n = w[fits], p[fits], n[fits]
        a, z = offsets[w], offsets[w + 1]
        half = (p + 2 + n) // 2 if side == 0 else p // 2
        parts = ((half, 0 * n), (p + 2, n - half)) if side == 0 else ((half, n - p), (0 * n, n - half))
        for i, (head, tail) in enumerate(parts):
            kept = heads[a + head] - heads[a] + (tails[z] - tails[z - tail]) * ODD
            out.append((w, mix(kept + mix(((2 * side + i) << 40 | n << 20 | p).astype(np.uint64)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(ranks: tuple[np.ndarray, np.ndarray], both: bool):
    """A mapInArrow step: a row for each key of a word as it is and, if both, as a longer one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            word, place = _anchors(cps, offsets, ranks)
            for longer in (False, True)[: 1 + both]:
                w, key = _keys(cps.astype(np.uint64), offsets, word, place, longer)
                at = pa.array(w)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("word").take(at), batch.column("n").take(at), pa.array(np.full(len(w), longer))], names=["key", "word", "n", "longer"])

    return step


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): for each word with a near one, all of them, as a set of (n, word). words: (word, n), written."""
    ranks = _ranks(words)
    left = words.mapInArrow(_keyed(ranks, False), KEYS).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = words.mapInArrow(_keyed(ranks, True), KEYS).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    met = left.join(right, "key").where(F.col("longer") | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
    ways = F.array(F.struct(F.col("a").alias("word"), F.struct(F.col("n_b").alias("n"), F.col("b").alias("word")).alias("near")), F.struct(F.col("b").alias("word"), F.struct(F.col("n_a").alias("n"), F.col("a").alias("word")).alias("near")))
    return met.select(F.explode(ways).alias("way")).select("way.*").groupBy("word").agg(F.collect_set("near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), written, by doubling: each round reaches twice as far; n grows TIMES-fold a step, so rounds are few."""
    reach = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = written(reach.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        discard(reach)
        if not moved.where("moved").limit(1).count():
            return moved.drop("moved")
        reach = moved.drop("moved")
        reach.folder = moved.folder


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of words (word, n), written.

    n_near: the words one edit away. form: the most frequent of them (ties: the
    first in code-point order) if `times` as frequent as the word, else null.
    root: the last of the chain of forms; the word itself if it has none.
    """
    with scratch() as kept:
        words = written(words)
        best = F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("minus"), x["word"].alias("word"))))
        found = near_words(words).select("word", F.size("near").cast("long").alias("n_near"), best.alias("best"))
        chosen = -F.col("best.minus") >= times * F.col("n")
        judged = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n"))
        judged = written(judged)
        roots = _roots(judged.where("form is not null"))
        out = written(judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")))
        kept.append(out)
        return out

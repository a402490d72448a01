"""Exact and near duplicates among cleaned texts, and among vectors."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import clean_text, jaccard, near_key, shingle_hashes, tokens
from quillon.operators.components import components
from quillon.operators.search import QUERY_BLOCK
from quillon.operators.store import discard, written

MOST_IN_BUCKET, TOKEN_GAP, JACCARD = 40, 5, 0.90
#: Just under all similarities that round to JACCARD; texts of one shingle that are chained before they are compared, and texts of it in a task.
LEAST, CROWD, BLOCK = JACCARD - 1e-6, 64, 2048


def prepared(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, clean_hash, near_key, n_tokens, sh: the shingles by their hashes)."""
    toks = df.select(id_col, tokens(clean_text(F.col(text))).alias("toks"))
    return toks.select(id_col, F.sha1(F.array_join("toks", " ")).alias("clean_hash"), near_key(F.col("toks")).alias("near_key"), F.size("toks").alias("n_tokens"), shingle_hashes(F.col("toks")).alias("sh"))


def exact_groups(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, clean_hash, duplicate_of): the smallest id of the same cleaned text. df is read twice: give it written."""
    least = df.groupBy("clean_hash").agg(F.min(id_col).alias("duplicate_of"), F.count(F.lit(1)).alias("n_copies"))
    return df.select(id_col, "clean_hash").join(least, "clean_hash")


def near_pairs(df: DataFrame, id_col: str = "doc_id", most: int | None = MOST_IN_BUCKET) -> DataFrame:
    """(a, b, similarity) within a key's bucket: its first `most` rows by id (None: all), token counts close, shingles alike. df is read several times: give it written."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("near_key").orderBy(id_col))).where(F.col("n_tokens") > 0)
    ranked = ranked if most is None else ranked.where(F.col("rn") <= most)
    left = ranked.select("near_key", F.col(id_col).alias("a"), F.col("rn").alias("rn_a"), F.col("n_tokens").alias("n_a"), F.col("sh").alias("sh_a"))
    right = ranked.select("near_key", F.col(id_col).alias("b"), F.col("rn").alias("rn_b"), F.col("n_tokens").alias("n_b"), F.col("sh").alias("sh_b"))
    pairs = left.join(right, "near_key").where((F.col("rn_a") < F.col("rn_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= TOKEN_GAP))
    return pairs.select("a", "b", F.round(jaccard(F.col("sh_a"), F.col("sh_b")), 6).alias("similarity")).where(F.col("similarity") >= JACCARD)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, id_a, id_b) of the pairs of texts that are near."""
    for x in "ab":
        pairs = pairs.join(texts.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "near_key", "n_tokens", "sh")), F.col("t").alias(x)), x)
    alike = (F.col("near_key_a") == F.col("near_key_b")) & (F.abs(F.col("n_tokens_a") - F.col("n_tokens_b")) <= TOKEN_GAP)
    return pairs.where(alike).where(F.round(jaccard(F.col("sh_a"), F.col("sh_b")), 6) >= JACCARD).select("a", "b", "id_a", "id_b")


def filed(texts: DataFrame) -> DataFrame:
    """(g, t, n, n_tokens, at, next, tight): a text under those of its shingles, rarest of the bucket first, of which a near one has one.

    Of two near texts the smaller has a common shingle among its tight ones, the
    larger among all that are filed. Shingles of one text only hold their place
    (at) and are not filed.
    """
    words = texts.select("t", "n_tokens", F.size("sh").alias("n"), "near_key", F.explode("sh").alias("s")).select("t", "n_tokens", "n", F.xxhash64("near_key", "s").alias("g"))
    seen = words.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = words.join(seen, "g").groupBy("t", "n_tokens", "n").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("gs"))
    n, alone = F.col("n"), F.col("n") - F.size("gs")
    most = (n - F.ceil(n * LEAST) + 1).cast("int")
    placed = ranked.select("t", "n", "n_tokens", alone.alias("alone"), F.slice("gs", F.lit(1), F.greatest(most - alone, F.lit(0))).alias("gs"))
    out = placed.select("t", "n", "n_tokens", "alone", "gs", F.posexplode("gs.g").alias("pos", "g"))
    at = F.col("alone") + F.col("pos") + 1
    return out.select("g", "t", "n", "n_tokens", at.alias("at"), F.get("gs.g", F.col("pos") + 1).alias("next"), (at <= n - F.ceil(n * (2 * LEAST / (1 + LEAST))) + 1).alias("tight"))


def chained(crowds: DataFrame) -> DataFrame:
    """(a, b): neighbours among the texts of a shingle, by the shingle that comes next; dealt in pieces, the pieces' first ones chained too."""
    dealt = crowds.withColumn("piece", F.pmod(F.xxhash64("t"), F.ceil(F.col("members") / BLOCK)))
    last = F.lag("t").over(Window.partitionBy("g", "piece").orderBy("next", "t"))
    dealt = dealt.select("g", "piece", F.col("t").alias("a"), last.alias("b"))
    heads = dealt.where("b is null").select("a", F.lag("a").over(Window.partitionBy("g").orderBy("piece")).alias("b"))
    return dealt.select("a", "b").union(heads).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def met(entries: DataFrame) -> DataFrame:
    """(a, b): texts of different components that may be near, each smaller one with each larger; a shingle's smaller ones are dealt in blocks."""
    groups = entries.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("tight").alias("any"))
    rows = entries.join(groups.where("any and low < high").select("g", F.ceil(F.col("members") / BLOCK).alias("blocks")), "g")
    named = lambda x: (F.col(c).alias(f"{c}_{x}") for c in ("n", "n_tokens", "at", "component"))
    small = rows.where("tight").select("g", F.pmod(F.xxhash64("t"), "blocks").alias("block"), F.col("t").alias("a"), *named("a"))
    large = rows.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("t").alias("b"), *named("b"))
    ordered = "(n_a < n_b or n_a = n_b and a < b) and component_a != component_b"
    common = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # at most, if this is their first common one
    able = (F.abs(F.col("n_tokens_a") - F.col("n_tokens_b")) <= TOKEN_GAP) & (common >= (F.col("n_a") + F.col("n_b")) * (LEAST / (1 + LEAST)))
    return small.join(large, ["g", "block"]).where(ordered).where(able).select("a", "b").distinct()


def among(rows: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns are among those kept, and a few more: tested in 2**26 bits, a broadcast of 8 MB at any size, so that wide rows are not shuffled to be dropped."""
    at = F.pmod(F.xxhash64(*on), F.lit(2**26)) + 1
    bits = kept.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.expr("substring(__bits, __place div 8 + 1, 1)")), 16, 10).cast("int")
    tested = rows.withColumns({"__bucket": F.bitmap_bucket_number(at), "__place": place}).join(F.broadcast(bits), "__bucket")
    return tested.where(byte.bitwiseAND(F.expr("shiftleft(1, __place % 8)")) != 0).select(rows.columns)


def near_links(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(a, b): links that connect what near_pairs with no limit connects.

    Different texts of a bucket meet on their rarest shingles. A shingle of very
    many texts has its neighbours compared first, and then only those texts
    that these links leave in different components. df is read several times: give it written.
    """
    rows = df.where(F.col("n_tokens") > 0)
    first = rows.groupBy("near_key", "clean_hash").agg(F.min(id_col).alias(id_col))
    several = first.groupBy("near_key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("near_key")
    kept = written(first.join(several, "near_key").select("clean_hash", id_col))
    texts = among(rows, kept, ["clean_hash", id_col]).join(kept, ["clean_hash", id_col]).dropDuplicates(["clean_hash", id_col])
    texts = written(texts.select(F.xxhash64("clean_hash").alias("t"), F.col(id_col).alias("id"), "near_key", "n_tokens", "sh"))
    entries = written(filed(texts))
    crowds = entries.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > CROWD)
    chain = written(verified(chained(entries.join(crowds, "g")), texts))
    label = components(texts.select("t"), chain, "t").withColumnRenamed("node", "t") if chain.limit(1).count() else texts.select("t", F.col("t").alias("component"))
    links = written(chain.union(verified(met(entries.join(label, "t")), texts)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    for done in (kept, texts, entries, chain):
        discard(done)
    return links


def duplicate_components(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, component): exact and near links joined transitively, in buckets of any size; the representative is the smallest id. df is read several times: give it written."""
    exact = exact_groups(df, id_col).where(F.col(id_col) != F.col("duplicate_of")).select(F.col(id_col).alias("a"), F.col("duplicate_of").alias("b"))
    return components(df.select(id_col), exact.union(near_links(df, id_col)), id_col).withColumnRenamed("node", id_col)


def greedy(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, duplicate_of): in id order, an exact copy of a representative, else the first representative that is near; only rows without either represent.

    Exact copies are settled by aggregation first: one follows what its first
    row found, or is a copy of that row. So a key's task holds its different
    texts only, and blank ones are one of them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        leaders: list[tuple[int, int, set]] = []
        out = []
        for i, n, sh in zip(pdf["first"], pdf["n_tokens"], pdf["sh"], strict=True):
            own, of = set(sh.tolist()), None
            for j, m, other in leaders:
                union = len(own | other)
                if abs(n - m) <= TOKEN_GAP and (not union or len(own & other) / union >= JACCARD):
                    of = j
                    break
            if of is None and len(leaders) < MOST_IN_BUCKET:
                leaders.append((i, n, own))
            out.append(of)
        return pd.DataFrame({"clean_hash": pdf["clean_hash"], "first": pdf["first"], "near": pd.array(out, "Int64")})

    first = df.groupBy("near_key", "clean_hash").agg(F.min(id_col).alias("first"), F.first("n_tokens").alias("n_tokens"), F.first("sh").alias("sh"))
    first = first.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("near_key")))
    found = first.where("texts > 1").groupBy("near_key").applyInPandas(run, "clean_hash string, first long, near long")
    found = found.unionByName(first.where("texts = 1").select("clean_hash", "first", F.lit(None).cast("long").alias("near")))
    of = F.coalesce("near", F.when(F.col(id_col) != F.col("first"), F.col("first")))
    return df.select(id_col, "clean_hash").join(found, "clean_hash").select(id_col, of.alias("duplicate_of"))


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a block of near pairs (left x right) connects, one per row at most."""
    top = np.iinfo(np.int64).max
    low, other = left.copy(), np.where(near.any(axis=0), top, right)
    while True:
        other_new = np.minimum(other, np.where(near, low[:, None], top).min(axis=0, initial=top))
        other_new = np.where(near.any(axis=0), np.minimum(other_new, right), right)
        low_new = np.minimum(low, np.where(near, other_new[None, :], top).min(axis=1, initial=top))
        if (low_new == low).all() and (other_new == other).all():
            break
        low, other = low_new, other_new
    a, b = np.concatenate([left, right]), np.concatenate([low, other])
    return a[a != b], b[a != b]


def embedding_links(df: DataFrame, least: float, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b): links that connect all vectors joined by chains of cosines of at least `least`.

    Exact, so every block of vectors meets every other once, two blocks a
    task; a pair of blocks sends spanning links on, so large groups of equal
    vectors do not give all their pairs. Nothing is gathered on the driver.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(embedding).alias("v")).where(F.col(embedding).isNotNull())
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        left, ids = (pdf["block"] == pdf["low"]).to_numpy(), pdf["id"].to_numpy(np.int64)
        right = left if pdf["low"].iloc[0] == pdf["high"].iloc[0] else ~left
        a, b = spanning(np.round(x[left] @ x[right].T, 6) >= least, ids[left], ids[right])
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("low", "high").applyInPandas(link, "a long, b long").distinct()


def embedding_components(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """DBSCAN with two points as minimum is the components of the epsilon graph."""
    return components(df.select(id_col), embedding_links(df, least, id_col, embedding), id_col).withColumnRenamed("node", id_col)

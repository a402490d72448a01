"""Semantic, full-text and hybrid retrieval."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import lexical_overlap, tokens
from quillon.functions.vectors import cosine_to
from quillon.operators.relational import distinct_on

CORPORA = ("ambos", "jurisprudencia", "leyes")
#: Queries whose vectors go to every task at once; more are taken in blocks.
QUERY_BLOCK = 2048
#: Rows that a task compares with a block of queries at once.
SLICE = 512


def with_similarity(df: DataFrame, vector: list[float], embedding: str = "embedding") -> DataFrame:
    """df with sim, the cosine to the query rounded to six places; rows without a vector or with a zero one are left out."""
    return df.where(F.col(embedding).isNotNull()).withColumn("sim", F.round(cosine_to(F.col(embedding), vector), 6)).where("sim is not null")


def semantic_topk(df: DataFrame, vector: list[float], k: int, tie: str, embedding: str = "embedding") -> DataFrame:
    return with_similarity(df, vector, embedding).orderBy(F.desc("sim"), tie).limit(k)


def best_per_parent(df: DataFrame, vector: list[float], parent: str | Column, k: int, tie: str, embedding: str = "embedding") -> DataFrame:
    """The best row of each parent, then the k best parents."""
    return distinct_on(with_similarity(df, vector, embedding), [parent], [F.desc("sim"), F.col(tie)]).orderBy(F.desc("sim"), tie).limit(k)


def multi_corpus(parts: dict[str, DataFrame], vector: list[float], k: int, tie: str, corpus: str = "ambos") -> DataFrame:
    """Top k of one corpus, or of both merged."""
    if corpus not in CORPORA:
        raise ValueError(f"corpus must be one of {CORPORA}")
    chosen = [semantic_topk(df, vector, k, tie).withColumn("corpus", F.lit(name)) for name, df in parts.items() if corpus in ("ambos", name)]
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df)
    return out.orderBy(F.desc("sim"), tie, "corpus").limit(k)


class Best:
    """The k nearest rows of each query so far (ties: the smaller id), in k rows a query however many were seen."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.id, self.sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, some: np.ndarray, own: np.ndarray, sims: np.ndarray) -> None:
        """sims: a row for each of some queries, a column for each of own rows; -inf for pairs that do not count."""
        least = self.least[some]
        if sims.shape[1] > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
        if not len(q):
            return
        query, ids, sim = np.concatenate([self.query, some[q]]), np.concatenate([self.id, own[r]]), np.concatenate([self.sim, sims[q, r]])
        order = np.lexsort((ids, -sim, query))
        query, ids, sim = query[order], ids[order], sim[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[rank == self.k - 1]] = sim[rank == self.k - 1]
        self.query, self.id, self.sim = query[rank < self.k], ids[rank < self.k], sim[rank < self.k]


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, embedding: str, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """(query_id, id, sim, rank): the k nearest rows of corpus for each query, itself left out; with centres only those in the cells of the query's nearest centres.

    Queries are a stated, small set; they go out in blocks as one matrix. A task
    multiplies a slice of its rows at a time and holds k rows a query, so its
    memory does not grow with its rows.
    """
    rows = [(r[id_col], r[embedding]) for r in queries.select(id_col, embedding).where(F.col(embedding).isNotNull()).orderBy(id_col).toLocalIterator()]
    out = None
    for a in range(0, max(1, len(rows)), QUERY_BLOCK):
        block = rows[a : a + QUERY_BLOCK]
        ids = np.array([r[0] for r in block], np.int64)
        raw = np.array([r[1] for r in block], np.float64).reshape(len(block), -1 if block else 0)
        unit = raw / np.maximum(np.sqrt((raw * raw).sum(axis=1, keepdims=True)), 1e-300)
        visits = None if centres is None or not len(ids) else np.argsort(-(raw @ centres.T), axis=1)[:, :probes]

        def search(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, unit: np.ndarray = unit, visits: np.ndarray | None = visits) -> Iterator[pa.RecordBatch]:
            best, every = Best(len(ids), k), np.arange(len(ids))
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, SLICE):
                    part = batch.slice(at, SLICE)
                    own = part.column(0).to_numpy().astype(np.int64)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                    length = np.sqrt((x * x).sum(axis=1))
                    x, own, length = x[length > 0], own[length > 0], length[length > 0]
                    cell = np.zeros(len(own), np.int64) if visits is None else (x @ centres.T).argmax(axis=1)
                    for c in np.unique(cell):
                        some = every if visits is None else np.flatnonzero((visits == c).any(axis=1))
                        mine = own[cell == c]
                        sims = np.round(unit[some] @ (x[cell == c] / length[cell == c][:, None]).T, 6)
                        sims[ids[some][:, None] == mine[None, :]] = -np.inf
                        best.add(some, mine, sims)
            if len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.sim)], names=["query_id", "id", "sim"])

        part = corpus.select(id_col, embedding).where(F.col(embedding).isNotNull()).mapInArrow(search, "query_id long, id long, sim double")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, sim, rank): the k nearest rows of corpus for each query, itself left out."""
    return nearest(corpus, queries, k, id_col, embedding)


def bm25(df: DataFrame, query: list[str], k: int, id_col: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): Okapi BM25. Only the query's terms are kept from each text, so nothing but small rows is aggregated."""
    terms = sorted(set(query))
    toks = tokens(F.col(text))

    def count(term: str) -> Column:
        return F.size(F.filter(F.col("__t"), lambda x: x == term))

    counts = F.array(*map(count, terms))
    per = df.select(id_col, toks.alias("__t")).select(id_col, F.size("__t").alias("dl"), counts.alias("tf"))
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    return bm25_scores(per.where(F.exists("tf", lambda x: x > 0)), stats, terms, id_col, k1, b).orderBy(F.desc("score"), id_col).limit(k)


def bm25_scores(per: DataFrame, stats: DataFrame, terms: list[str], id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of (id, dl, tf: a count a term); stats: one row with n, avgdl and df0, df1, .. a term."""
    one = per.crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col("tf")[i].cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return one.select(id_col, F.round(score, 6).alias("score"))


def cover_density(df: DataFrame, query: list[str], id_col: str, text: str = "text", weight: float = 0.1) -> DataFrame:
    """(id, score) of texts that hold every query term: weight / (1 + noise words), summed over minimal covers."""
    terms = sorted(set(query))
    at = df.select(id_col, F.posexplode(tokens(F.col(text))).alias("pos", "tok")).where(F.col("tok").isin(terms))
    return covers(at, terms, id_col, weight)


def covers(at: DataFrame, terms: list[str], id_col: str, weight: float = 0.1) -> DataFrame:
    """cover_density of (id, pos, tok), the places of the query's terms."""
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.max(F.when(F.col("tok") == t, F.col("pos"))).over(upto) for t in terms]
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    seen = at.select(id_col, "pos", nth.alias("nth"), F.array(*latest).alias("latest")).where(~F.exists("latest", lambda x: x.isNull()))
    ends = seen.select(id_col, "pos", "nth", F.array_min("latest").alias("start"))
    first = ends.groupBy(id_col, "start").agg(F.min("pos").alias("end"), F.min("nth").alias("nth_end"))
    starts = at.select(id_col, F.col("pos").alias("start"), nth.alias("nth_start"))
    joined = first.join(starts, [id_col, "start"])
    noise = (F.col("end") - F.col("start")) - (F.col("nth_end") - F.col("nth_start"))
    return joined.groupBy(id_col).agg(F.round(F.sum(F.lit(weight) / (1 + noise)), 6).alias("score"))


def hybrid(df: DataFrame, vector: list[float], query: list[str], parent: str, id_col: str, pool: int = 100, k: int = 10, semantic: float = 0.7, lexical: float = 0.3) -> DataFrame:
    """Top of a semantic pool by semantic * sim + lexical * least(1, 10 * text rank), the best row of each parent."""
    near = semantic_topk(df, vector, pool, id_col)
    ranks = cover_density(near, query, id_col)
    scored = near.join(ranks, id_col, "left").withColumn("text_rank", F.coalesce("score", F.lit(0.0))).drop("score")
    scored = scored.withColumn("hybrid", F.round(semantic * F.col("sim") + lexical * F.least(F.lit(1.0), 10 * F.col("text_rank")), 6))
    return distinct_on(scored, [parent], [F.desc("hybrid"), F.col(id_col)]).orderBy(F.desc("hybrid"), id_col).limit(k)


def rerank_features(df: DataFrame, query: list[str], text: str = "text", bonuses: dict[str, tuple[Column, float]] | None = None) -> DataFrame:
    """df with overlap and rerank = .72 sim + .15 overlap + the weighted 0/1 bonuses."""
    overlap = lexical_overlap(query, tokens(F.col(text)))
    total = 0.72 * F.col("sim") + 0.15 * overlap
    for c, w in (bonuses or {}).values():
        total = total + w * F.coalesce(c, F.lit(False)).cast("double")
    return df.withColumn("overlap", F.round(overlap, 6)).withColumn("rerank", F.round(total, 6))


# Fixed value: a citation in running text, its article and the law's name.
CITED = r"(?i)art\w*\.?\s*(\d+)\s*(?:del|de la)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def with_basis(results: DataFrame, links: DataFrame, case: str, text: str = "text") -> DataFrame:
    """The few results with basis: the laws and articles linked to the case (links: case, law, article), each once; without links those that its text cites, in order; null if none."""
    said = F.concat("law", F.lit(" (Art. "), F.col("article").cast("string"), F.lit(")"))
    own = links.join(F.broadcast(results.select(case).distinct()), case).groupBy(case).agg(F.array_join(F.array_sort(F.collect_set(said)), ", ").alias("__linked"))
    numbers, names = (F.regexp_extract_all(F.col(text), F.lit(CITED), k) for k in (1, 2))
    cited = F.array_join(F.zip_with(numbers, names, lambda n, name: F.concat(F.lit("Art. "), n, F.lit(" "), name)), ", ")
    return results.join(own, case, "left").withColumn("basis", F.coalesce("__linked", F.nullif(cited, F.lit("")))).drop("__linked")


def with_norm(results: DataFrame, articles: DataFrame, most: int = 500) -> DataFrame:
    """results with norm_law and norm: the first article that basis names, looked up by its number in any law (articles: number, law, content; the first law, then the first content, so the choice is fixed)."""
    asked = results.withColumn("__number", F.nullif(F.regexp_extract(F.coalesce("basis", F.lit("")), r"Art\.?\s*(\d+)", 1), F.lit("")))
    wanted = asked.select(F.col("__number").alias("number")).distinct()
    found = articles.join(F.broadcast(wanted), "number").groupBy(F.col("number").alias("__number")).agg(F.min(F.struct("law", "content")).alias("__n"))
    return asked.join(found, "__number", "left").withColumns({"norm_law": F.col("__n.law"), "norm": F.substring("__n.content", 1, most)}).drop("__n", "__number")


def retrieval_report(near: DataFrame, texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, mean_sim, relevance) of (query_id, id, sim): the mean similarity and the share, in percent, of a query's results whose text (id, text) has one of its keywords (query_id, words)."""
    rows = near.join(texts, "id").join(F.broadcast(keywords), "query_id")  # queries are few
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.exists("words", lambda w: F.contains(low, F.lower(w))).cast("double")
    return rows.groupBy("query_id").agg(F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(100 * F.avg(hit), 4).alias("relevance"))


def report_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row a query of either report: both sides and after minus before; a query that one side lacks counts as 0 there."""
    sides = [df.withColumnsRenamed({c: f"{c}_{side}" for c in df.columns if c != "query_id"}) for df, side in ((before, "before"), (after, "after"))]
    both = sides[0].join(sides[1], "query_id", "full").na.fill(0)
    names = [c for c in before.columns if c != "query_id"]
    return both.select("query_id", *(f"{c}_{s}" for c in names for s in ("before", "after")), *(F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 6).alias(f"{c}_delta") for c in names))


def rerank(df: DataFrame, scorer: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """df with score from a batch scorer (a cross-encoder, say) run as a pandas UDF."""
    return df.withColumn("score", F.pandas_udf(scorer, "double")(F.col(text)))


def build_context(df: DataFrame, order: list[Column], text: str, source: str, limit: int = 220) -> DataFrame:
    """One row: numbered source blocks of the few chosen rows, parted by blank lines."""
    block = F.concat(F.lit("[Fuente "), F.col("n").cast("string"), F.lit("] "), F.col(source), F.lit("\n"), F.substring(F.col(text), 1, limit))
    ranked = df.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("n", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def ivf_topk(corpus: DataFrame, queries: DataFrame, k: int, cells: int = 16, probes: int = 13, sample: int = 20_000, id_col: str = "vec_id", embedding: str = "embedding", seed: int = 42) -> DataFrame:
    """Approximate knn: k-means cells fitted on a bounded hash sample index every row; a query searches its nearest cells only."""
    rows = corpus.select(id_col, embedding).where(F.col(embedding).isNotNull())
    fit = np.array([r[0] for r in rows.orderBy(F.xxhash64(id_col, F.lit(seed))).limit(sample).select(embedding).toLocalIterator()], np.float64)
    fit /= np.maximum(np.linalg.norm(fit, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    centres = fit[rng.choice(len(fit), min(cells, len(fit)), replace=False)]
    for _ in range(15):
        own = (fit @ centres.T).argmax(axis=1)
        centres = np.array([fit[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    return nearest(rows, queries, k, id_col, embedding, centres, probes)

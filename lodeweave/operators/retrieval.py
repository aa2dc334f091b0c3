"""Lexical and vector retrieval, fusion, boosts, reranking: one lazy plan per batch of queries.

Tables: chunks (tenant_id, chunk_id, document_id, chunk_index, section, text),
queries (query_id, tenant_id, terms array<string>, phrases array<string>,
numbers array<string>). Query tables are batches of questions, not corpora.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import kernels
from lodeweave.functions import text as tx
from lodeweave.functions.vectors import SIMILARITIES
from lodeweave.operators.tabular import scale_to_max

K1, B = 1.5, 0.75


# --- vectors ------------------------------------------------------------------


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int, metric: str = "cosine", key: str = "chunk_id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k most similar rows to a one-row query (column query_vector), filtered first; ties to the smaller key."""
    if where is not None:
        vectors = vectors.where(where)
    scored = vectors.crossJoin(F.broadcast(query.select("query_vector").limit(1))).withColumn("score", SIMILARITIES[metric](F.col(vector), F.col("query_vector"))).drop("query_vector")
    top = scored.orderBy(F.desc("score"), key).limit(max(1, k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def batch_vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "chunk_id", vector: str = "vector", by: str = "tenant_id") -> DataFrame:
    """Per query the k most similar rows of its tenant; queries: (query_id, tenant, query_vector)."""
    scored = queries.join(vectors, by).select("query_id", by, key, SIMILARITIES[metric](F.col(vector), F.col("query_vector")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


# --- BM25 ------------------------------------------------------------------------


def _body(section: str | None, text: str) -> Column:
    return F.concat_ws("\n", section, text) if section else F.col(text)


def postings(chunks: DataFrame, section: str | None = None, text: str = "text", asked: DataFrame | None = None, ranged: bool = False) -> DataFrame:
    """(tenant_id, chunk_id, term, tf, length): the index, counted row by row and then by (chunk, term).

    With asked, a batch of queries with terms (broadcast), only their postings are moved; ranged deals all by ranges of
    tenant and term, in the one shuffle there is."""
    rows = kernels.counted_terms(chunks, _body(section, text), ["tenant_id", "chunk_id"])
    if asked is not None:
        rows = rows.join(F.broadcast(asked_terms(asked).select("tenant_id", "term").distinct()), ["tenant_id", "term"], "left_semi")
    if ranged:  # sorted once, no table of all rows
        w = Window.partitionBy("tenant_id", "term", "chunk_id").orderBy("chunk_id")
        merged = rows.repartitionByRange("tenant_id", "term").withColumns({"__n": F.row_number().over(w), "tf": F.sum("tf").over(Window.partitionBy("tenant_id", "term", "chunk_id"))})
        return merged.where("__n = 1").select("tenant_id", "chunk_id", "term", "tf", "length")
    return rows.groupBy("tenant_id", "chunk_id", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "tenant_id", F.explode(F.array_distinct("terms")).alias("term"))


def corpus_stats(chunks: DataFrame, section: str | None = None, text: str = "text") -> DataFrame:
    """(tenant_id, docs, mean_length) over all chunks, those without terms included."""
    return chunks.select("tenant_id", kernels.term_length(_body(section, text)).alias("length")).groupBy("tenant_id").agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, tenant_id, chunk_id, score > 0). Query terms are distinct and reach the postings before any counting."""
    asked = asked_terms(queries)
    wanted = index.join(asked.select("tenant_id", "term").distinct(), ["tenant_id", "term"], "left_semi")
    df = wanted.groupBy("tenant_id", "term").agg(F.expr("count(tf, length)").alias("df"))  # all columns, so that both sides read one shuffle
    weighed = wanted.join(df, ["tenant_id", "term"]).join(stats, "tenant_id")
    tf = F.col("tf")
    part = idf(F.col("docs"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    parts = weighed.select("tenant_id", "term", "chunk_id", part.alias("part"))
    found = asked.join(parts, ["tenant_id", "term"]).groupBy("query_id", "tenant_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("p"))  # a query's terms
    # added in the order of the terms, so that equal texts score equal to the last bit and tie
    return found.select("query_id", "tenant_id", "chunk_id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("score")).where("score > 0")


def ranked(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "chunk_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_search(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25, scaled by each query's best, ranked."""
    top = ranked(bm25(index, stats, queries), k)
    return top.withColumn("raw_score", F.col("score")).withColumn("score", scale_to_max(F.col("score"), ["query_id"]))


# --- fusion ------------------------------------------------------------------------


def merge(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Full outer merge of two ranked lists by (query_id, chunk_id), with sources."""
    s = semantic.select("query_id", "chunk_id", F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    k = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    named = lambda c, n: F.when(F.col(c).isNotNull(), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    return s.join(k, ["query_id", "chunk_id"], "full").withColumn("sources", F.array_union(named("keyword_rank", "keyword"), named("semantic_rank", "semantic")))


def reciprocal_rank(merged: DataFrame, weights: tuple[float, float] = (0.6, 0.4), k: int = 60) -> DataFrame:
    one = lambda rank, w: F.coalesce(F.lit(w) / (k + F.col(rank)), F.lit(0.0))
    out = merged.withColumn("fused_score", one("semantic_rank", weights[0]) + one("keyword_rank", weights[1]))
    return out.withColumn("fused_score", scale_to_max(F.col("fused_score"), ["query_id"]))


def weighted(merged: DataFrame, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    total = sum(weights) or 1.0
    one = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)) * (w / total)
    return merged.withColumn("fused_score", one("semantic_score", weights[0]) + one("keyword_score", weights[1]))


FUSIONS = {"rrf": reciprocal_rank, "weighted": weighted}


def fuse(semantic: DataFrame, keyword: DataFrame, method: str = "rrf", **more) -> DataFrame:
    if method not in FUSIONS:
        raise ValueError(f"unknown fusion {method!r}; known: {sorted(FUSIONS)}")
    return FUSIONS[method](merge(semantic, keyword), **more)


def agreement(merged: DataFrame) -> DataFrame:
    """(query_id, agreement): share of candidates that both sides found, 4 decimals."""
    both = F.col("semantic_rank").isNotNull() & F.col("keyword_rank").isNotNull()
    return merged.groupBy("query_id").agg(F.round(F.avg(both.cast("int")), 4).alias("agreement"))


# --- boosts and reranking -------------------------------------------------------------

# What each kind of evidence adds.
BOOSTS = {"reference": 0.25, "phrase": 0.15, "agreement": 0.05, "heading": 0.05, "heading_only": -0.30}


def _mentions(text: Column, numbers: Column) -> Column:
    escaped = lambda n: F.regexp_replace(n, r"([^A-Za-z0-9])", r"\\$1")
    return F.exists(numbers, lambda n: F.regexp_like(text, F.concat(F.lit(r"(?<![\w.])"), escaped(n), F.lit(r"(?!\w)(?!\.\d)"))))


def boost(candidates: DataFrame, limit: int = 0, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """rank_score, pinned, boosts map and rank from fused_score; candidates carry chunk and query columns."""
    if "heading_only" not in candidates.columns:
        candidates = candidates.withColumn("heading_only", F.lit(False))
    section, lowered = F.trim(F.coalesce("section", F.lit(""))), F.lower("text")
    in_section, in_text = _mentions(section, F.col("numbers")), _mentions(lowered, F.col("numbers"))
    phrases = F.size(F.filter("phrases", lambda p: (p != "") & F.contains(lowered, p)))
    both = F.array_contains("sources", "semantic") & F.array_contains("sources", "keyword")
    heading = (section != "") & F.arrays_overlap(tx.terms(section), F.col("terms"))
    parts = {
        "reference": F.when(in_section, boosts["reference"]).when(in_text, boosts["reference"] / 2),
        "phrase": F.when(phrases > 0, boosts["phrase"] * F.least(phrases, F.lit(2))),
        "agreement": F.when(both, boosts["agreement"]), "heading": F.when(heading, boosts["heading"]),
        "heading_only": F.when(F.coalesce("heading_only", F.lit(False)), boosts["heading_only"]),
    }
    out = candidates.withColumns({f"__{k}": F.coalesce(v, F.lit(0.0)) for k, v in parts.items()} | {"pinned": in_section})
    total = reduce(lambda a, b: a + b, [F.col(f"__{k}") for k in parts], F.col("fused_score"))
    every = F.create_map(*[x for k in parts for x in (F.lit(k), F.col(f"__{k}"))])
    out = out.withColumn("rank_score", F.greatest(F.lit(0.0), total)).withColumn("boosts", F.map_filter(every, lambda _, v: v != 0)).drop(*[f"__{k}" for k in parts])
    w = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc("rank_score"), "chunk_id")
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= limit) if limit else out


def lexical_relevance(text: Column, terms: Column, phrases: Column, window: int = 60) -> Column:
    """0.65 coverage + 0.20 density of first positions + 0.15 phrase share, 6 decimals."""
    unique = F.array_distinct(terms)
    said = F.filter(phrases, lambda p: p != "")
    n = F.size(unique)
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluated once, however often f uses it
    firsts = bind(tx.terms(text), lambda tokens: F.filter(F.transform(unique, lambda t: F.array_position(tokens, t)), lambda p: p > 0))

    def score(found: Column) -> Column:
        gap = F.array_max(found) - F.array_min(found)
        density = F.when(F.size(found) == 0, 0.0).when((F.size(found) == 1) | (gap <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.lit(float(window)) / gap))
        phrase = F.when(F.size(said) > 0, F.size(F.filter(said, lambda p: F.contains(F.lower(text), p))) / F.size(said)).otherwise(0.0)
        coverage = F.when(n > 0, F.size(found) / n).otherwise(0.0)
        return F.when((n == 0) & (F.size(said) == 0), 0.0).otherwise(F.round(0.65 * coverage + 0.2 * density + 0.15 * phrase, 6))

    return bind(firsts, score)


RERANKERS = {"lexical": lexical_relevance}


def register_reranker(name: str, score) -> None:
    """score: Columns text, terms, phrases -> Column of relevance (a Pandas UDF over your own model, say)."""
    RERANKERS[name] = score


def rerank(candidates: DataFrame, k: int, weight: float = 0.85, by: str = "lexical") -> DataFrame:
    """final_score blends scaled rerank and rank scores; pinned first; k per query. by: a registered reranker."""
    if by not in RERANKERS:
        raise ValueError(f"unknown reranker {by!r}; known: {sorted(RERANKERS)}")
    weight = max(0.0, min(1.0, weight))
    out = candidates.withColumn("rerank_score", RERANKERS[by](F.col("text"), F.col("terms"), F.col("phrases")))
    blend = weight * scale_to_max(F.col("rerank_score"), ["query_id"]) + (1 - weight) * scale_to_max(F.col("rank_score"), ["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc(F.round("final_score", 9)), "chunk_id")  # sums in another order may differ in the last bits
    return out.withColumn("final_score", blend).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_floor(hits: DataFrame, floor: float, by: str = "query_id", score: str = "final_score") -> DataFrame:
    """Hits of at least floor (no floor at 0), renumbered."""
    kept = hits.where(F.col(score) >= floor) if floor > 0 else hits
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank")))


def simple_search(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.0, metric: str = "cosine", key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(query_id, tenant_id, key, score, rank): the k best of the query's own tenant that reach the floor, renumbered. A blank tenant raises."""
    named = queries.withColumn("tenant_id", F.when(F.trim("tenant_id") != "", F.col("tenant_id")).otherwise(F.raise_error(F.lit("a tenant is required"))))
    return score_floor(batch_vector_top_k(vectors, named, k, metric, key, vector), floor, score="score")


def as_candidates(hits: DataFrame) -> DataFrame:
    """Hits or bare chunks as candidates: a missing score is 0, ranks follow score and chunk_id, missing chunk columns are filled."""
    defaults = {"score": F.lit(0.0), "section": F.lit(""), "page_number": F.lit(0), "pinned": F.lit(False), "sources": F.array().cast("array<string>")}
    out = hits.withColumns({c: v for c, v in defaults.items() if c not in hits.columns}).withColumn("score", F.coalesce("score", F.lit(0.0)))
    by = ["query_id"] if "query_id" in hits.columns else []
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")))


EXPLAINED = ("semantic_score", "semantic_rank", "keyword_score", "keyword_rank", "fused_score", "rank_score", "rerank_score", "boosts", "sources")


def project(hits: DataFrame, include_text: bool = True, explain: bool = False, digits: int = 6) -> DataFrame:
    """The columns of a response: scores rounded, text and the parts of a score on demand."""
    names = [c for c in hits.columns if (include_text or c != "text") and (explain or c not in EXPLAINED)]
    return hits.select(*[F.round(c, digits).alias(c) if c.endswith("score") else F.col(c) for c in names])


# --- near-duplicate collapse of a candidate pool -------------------------------------------

KEPT = "query_id string, chunk_id string, rank int, duplicates array<string>"


def collapse(pool: DataFrame, threshold: float = 0.85, size: int = 5, across_documents: bool = True, keep_adjacent: bool = True) -> DataFrame:
    """Best-first greedy removal of repeats within each query's pool (a pool is a few rows).

    The order decides who survives, so it is a fold per query: equal compare forms
    first, then Jaccard of character shingles with survivors only; neighbouring
    chunks of one document are exempt from the second."""
    import pandas as pd

    def grams(t: str) -> set[str]:
        return {t[i : i + size] for i in range(len(t) - size + 1)} if len(t) > size else {t} if t else set()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        exact: dict[str, dict] = {}
        for r in rows.sort_values("rank").itertuples(index=False):
            mine = grams(r.form)
            twin = exact.get(r.form) if r.form else None
            for k in () if twin else kept:
                near = k["doc"] == r.document_id and abs(k["index"] - r.chunk_index) == 1
                if (not across_documents and k["doc"] != r.document_id) or (keep_adjacent and near):
                    continue
                union = len(k["grams"] | mine)
                if (len(k["grams"] & mine) / union if union else 1.0) >= threshold:
                    twin = k
                    break
            if twin:
                twin["duplicates"].append(r.chunk_id)
                continue
            kept.append({"query_id": r.query_id, "chunk_id": r.chunk_id, "rank": r.rank, "duplicates": [], "doc": r.document_id, "index": r.chunk_index, "grams": mine})
            if r.form:
                exact[r.form] = kept[-1]
        return pd.DataFrame([{c: k[c] for c in ("query_id", "chunk_id", "rank", "duplicates")} for k in kept], columns=["query_id", "chunk_id", "rank", "duplicates"])

    rows = pool.select("query_id", "chunk_id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "rank", tx.compare_form(F.col("text")).alias("form"))
    return rows.groupBy("query_id").applyInPandas(fold, KEPT)


def hybrid_search(chunks: DataFrame, index: DataFrame, stats: DataFrame, queries: DataFrame, semantic: DataFrame | None, mode: str = "hybrid", pool: int = 18, k: int = 6, floor: float = 0.0, fusion: str = "rrf") -> DataFrame:
    """Retrieve, fuse, boost, collapse, rerank. mode: hybrid, semantic or keyword; semantic: ranked vector hits."""
    if mode not in ("hybrid", "semantic", "keyword"):
        raise ValueError(f"unknown mode {mode!r}")
    pool = max(pool, k)
    empty = queries.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    words = keyword_search(index, stats, queries, pool) if mode != "semantic" else empty
    near = semantic if mode != "keyword" and semantic is not None else empty
    fused = fuse(near, words, fusion)
    q = queries.select("query_id", "tenant_id", "terms", "phrases", "numbers")
    wide = fused.join(q, "query_id").join(chunks, ["tenant_id", "chunk_id"])  # the join by tenant is the second guard of isolation
    boosted = boost(wide, pool)
    kept = collapse(boosted).select("query_id", "chunk_id", "duplicates")
    return score_floor(rerank(boosted.join(kept, ["query_id", "chunk_id"]), k), floor)

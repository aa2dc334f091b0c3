"""Exact top-k inner products by MaxScore over shards of postings.

Vectors are whole numbers; a component is a term, and a block of vectors holds
for each term its smallest and largest weight. For one query a term's
contribution is shifted by its least possible value in the block, so it is never
negative and its greatest value is the term's score bound. The query's terms are
split by its threshold (the k-th best score it is known to reach): the largest set
of weakest terms whose bounds together stay below it is non-essential, the others
are essential. A block none of whose terms is essential is skipped. Only vectors with
something in an essential term are candidates; their essential postings are traversed
first, and non-essential ones probed, strongest first, for those that stay competitive.

Thresholds start from a first pass over one bounded block of seed vectors, which
every task has, and rise from block to block of a shard. A shard of vectors and a
few blocks of queries are the unit of work and return k rows a query, merged over the
shards. Their sizes are fixed by row counts whatever the data, so equal vectors,
however many, are spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SHARD, QUERIES, SEEDS = 4096, 16_384, 256, 2048
GROUP = 2  # query blocks that meet a shard in one task
PROBES = 8
EXACT = 1 << 53  # sums of products below it are exact as doubles


def quantise(df: DataFrame, vector: str, scale: int = 64) -> DataFrame:
    """df with v, each component x as floor(scale * x); rows with null vectors or null or non-finite components go."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return df.where(x.isNotNull() & finite).withColumn("v", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


PACKED = "part int, nth int, ids binary, widths binary, kind string, vals binary"


def _packed(df: DataFrame, size: int, parts: int) -> DataFrame:
    """PACKED rows of at most size vectors each, as narrow little-endian arrays; nth of the task's part."""

    def flush(part, nth, rows):
        ids = np.array([r[0] for r in rows], "<i8")
        widths = np.array([len(r[1]) for r in rows], "<i4")
        values = np.concatenate([r[1] for r in rows])
        most = int(np.abs(values).max(initial=0))
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        return pd.DataFrame({"part": np.int32([part]), "nth": np.int32([nth]), "ids": [ids.tobytes()], "widths": [widths.tobytes()], "kind": [kind], "vals": [values.astype(kind).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            held += zip(b["id"].tolist(), (np.asarray(v, "<i8") for v in b["v"]), strict=True)
            while len(held) >= size:
                yield flush(part, nth, held[:size])
                held, nth = held[size:], nth + 1
        if held:
            yield flush(part, nth, held)

    # rows are dealt evenly without a key, so no vector or id can make a block hot
    return df.select("id", "v").repartition(parts).mapInPandas(run, PACKED)


def _matrix(ids: bytes, widths: bytes, kind: str, values: bytes, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.frombuffer(widths, "<i4"), np.frombuffer(values, kind).astype(np.int64)
    full = max(width, int(w.max(initial=0)))
    if (w == full).all():
        return np.frombuffer(ids, "<i8"), v.reshape(len(w), full)
    out, at = np.zeros((len(w), full), np.int64), 0
    for i, n in enumerate(w):
        out[i, :n] = v[at : at + n]
        at += n
    return np.frombuffer(ids, "<i8"), out


def maxscore(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, skip: int | None, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of a block for one query; columns: terms x vectors; ties to smaller ids.

    floor: a score that the k-th best is known to reach, from other blocks; lower ones may be left out."""
    base = np.where(query >= 0, query * low, query * high)
    bound = np.where(query >= 0, query * high, query * low) - base
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from here on can add
    constant = base.sum()
    live = np.arange(len(ids)) if skip is None else np.flatnonzero(ids != skip)
    if floor is None:  # no threshold: every term is essential
        essential = len(order)
    else:
        if constant + rest[0] < floor:  # no vector of the block can reach it
            return ids[:0], np.zeros(0, np.int64)
        essential = int((constant + rest >= floor).sum()) if constant < floor else len(order)
        essential = min(essential, len(order))
    terms = order[:essential]
    score = query[terms] @ (columns[terms] if len(live) == len(ids) else columns[np.ix_(terms, live)]) + constant - base[terms].sum()
    if floor is not None and constant < floor:  # candidates have something in an essential term
        some = score > constant
        live, score = live[some], score[some]
    done, theta = essential, floor
    while True:
        if len(live) > k:
            best = np.partition(score, len(score) - k)[len(score) - k]
            theta = best if theta is None else max(theta, best)  # what is left only adds
        if theta is not None:
            keep = score + rest[done] >= theta
            live, score = live[keep], score[keep]
        if done == len(order) or not len(live):
            break
        some = order[done : done + PROBES]
        score = score + query[some] @ columns[np.ix_(some, live)] - base[some].sum()
        done += len(some)
    found = ids[live]
    top = np.lexsort((found, -score))[:k]
    return found[top], score[top].astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


class Shard:
    """Blocks of a shard's vectors, wide enough for the queries, with their terms' least and greatest weights."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, width: int, block: int = BLOCK):
        rows = np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))
        self.most = int(np.abs(rows).max(initial=0)) * rows.shape[1]
        self.blocks = []
        for at in range(0, len(ids), block):
            part = rows[at : at + block]
            self.blocks.append((ids[at : at + block], np.ascontiguousarray(part.T), part.min(axis=0), part.max(axis=0)))
        self.doubles: list = []

    def top(self, query: np.ndarray, k: int, skip: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.blocks[0][1])
        query = np.pad(query, (0, max(0, width - len(query))))
        exact = self.most * int(np.abs(query).max(initial=0)) < EXACT
        if exact and not self.doubles:
            self.doubles = [(i, *(x.astype(np.float64) for x in rest)) for i, *rest in self.blocks]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in self.doubles if exact else self.blocks:
            found, given = maxscore(query.astype(np.float64) if exact else query, *block, k, skip, floor)
            ids, scores = _best(np.concatenate([ids, found]), np.concatenate([scores, given]), k)
            if len(ids) == k:
                floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
        return ids, scores


def top_k(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, key, score): for each query row the k best other rows of df by inner product.

    Ties go to the smaller key. Null vectors and vectors with null or non-finite
    components take no part. A shorter vector counts as filled up with zeros, an
    empty one scores 0. A row isn't its own candidate; rows that repeat the
    query's key count as the query itself. Null keys take no part. Fewer than k
    candidates: all of them. Empty tables give no rows."""
    spark = df.sparkSession
    take = lambda d: quantise(d.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("x")), "x", scale)
    vectors, asked = take(df), take(queries)
    shards = max(1, -(-df.count() // SHARD))
    groups = max(1, -(-queries.count() // (QUERIES * GROUP)))
    seed = [(r["id"], r["v"]) for r in vectors.select("id", "v").limit(SEEDS).collect()]  # one block: seeds the thresholds, decides nothing
    width = max((len(v) for _, v in seed), default=0)
    seeds = np.zeros((len(seed), width), np.int64)
    for i, (_, v) in enumerate(seed):
        seeds[i, : len(v)] = v
    shared = spark.sparkContext.broadcast((np.array([i for i, _ in seed], np.int64), seeds))
    # each cell of a shard and a group of query blocks is a task's work; both sides are copied to their cells
    cells = shards * groups
    left = _packed(vectors, SHARD, shards).withColumnRenamed("part", "shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = _packed(asked, QUERIES, groups).withColumnsRenamed({c: f"q_{c}" for c in ("nth", "ids", "widths", "kind", "vals")})
    right = right.withColumnRenamed("part", "group").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = left.repartition(cells, "shard", "group").join(right.repartition(cells, "shard", "group"), ["shard", "group"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed_ids, seed_rows = shared.value
        now, shard, first = None, None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_widths, r.q_kind, r.q_vals)
                if (r.shard, r.nth, q.shape[1]) != now:
                    ids, rows = _matrix(r.ids, r.widths, r.kind, r.vals)
                    width = max(q.shape[1], rows.shape[1], seed_rows.shape[1])
                    now, shard, first = (r.shard, r.nth, q.shape[1]), Shard(ids, rows, width), Shard(seed_ids, seed_rows, width)
                out = []
                for i in range(len(q_ids)):
                    one = np.pad(q[i], (0, width - q.shape[1]))
                    _, known = first.top(one, k, int(q_ids[i]), None)
                    found, scores = shard.top(one, k, int(q_ids[i]), int(known[-1]) if len(known) == k else None)
                    out.append(pd.DataFrame({"query_id": q_ids[i], key: found, "score": scores}))
                yield pd.concat(out)

    local = met.mapInPandas(run, f"query_id long, `{key}` long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")

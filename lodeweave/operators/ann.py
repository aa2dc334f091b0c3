"""Approximate vector search: an inverted file of cells around k-means centres.

Centres are learnt from a bounded sample, then every row is put in the cell of its
nearest centre, both as unit vectors where the metric is cosine. A query reads the cells
nearest to it. More probes find more; as many probes as cells is the exact search.
Vectors without clusters need about half of the cells for a recall of 0.9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodeweave.functions.vectors import SIMILARITIES, usable

SAMPLE, MOST_CELLS, MOST_QUERIES = 100_000, 4_096, 10_000


def fit_centres(vectors: DataFrame, vector: str = "vector", key: str = "chunk_id", cells: int | None = None, sample: int = SAMPLE, metric: str = "cosine") -> np.ndarray:
    """Centres from at most sample rows, the first by a hash of the key; about the square root of the row count where cells isn't given.

    A zero vector or one with null or non-finite parts teaches nothing. No usable row gives one centre of nothing."""
    rows = vectors.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(usable(F.col("v")))
    drawn = rows.orderBy(F.xxhash64("k"), "k").limit(sample).select(array_to_vector("v").alias("features"))
    drawn = Normalizer(inputCol="features", outputCol="u").transform(drawn).select(F.col("u").alias("features")) if metric == "cosine" else drawn
    drawn = drawn.persist()
    n = drawn.count()
    if not n:
        return np.zeros((1, 0))
    size = cells or min(MOST_CELLS, max(1, round(math.sqrt(vectors.count()))), max(1, n // 8))
    model = KMeans(k=max(2, size), seed=42, maxIter=10).fit(drawn) if size > 1 and n > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.array([drawn.first()["features"].toArray()])
    drawn.unpersist()
    return centres


def nearest_cells(df: DataFrame, centres: np.ndarray, vector: str, probes: int, metric: str = "cosine") -> Column:
    """The numbers of the probes centres nearest to a vector; a vector of another width or with gaps goes to cell 0."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    @F.pandas_udf("array<int>")
    def near(batch: pd.Series) -> pd.Series:
        c = shared.value
        fit = [v is not None and len(v) == c.shape[1] and c.shape[1] > 0 for v in batch]
        x = np.array([np.asarray(v, dtype=np.float64) for v, ok in zip(batch, fit, strict=True) if ok]).reshape(sum(fit), c.shape[1])
        x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
        if metric == "cosine":
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        far = (c * c).sum(1) - 2 * x @ c.T
        order = iter((far.argmin(1)[:, None] if probes == 1 else np.argsort(far, axis=1, kind="stable")[:, :probes]).astype(np.int32))
        return pd.Series([next(order).tolist() if ok else [0] for ok in fit])

    return near(F.col(vector))


def build(vectors: DataFrame, centres: np.ndarray, vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """Every row with its cell. Written partitioned by cell, a search reads its cells only."""
    return vectors.withColumn("cell", F.get(nearest_cells(vectors, centres, vector, 1, metric), F.lit(0)))


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 8, metric: str = "cosine", key: str = "chunk_id", vector: str = "vector", by: str | None = "tenant_id", same: Column | None = None, own: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the k best rows of the probed cells, ties to the smaller key.

    queries: (query_id, by, query_vector), a batch of questions; up to MOST_QUERIES are
    broadcast, so a crowded cell stays spread over its tasks, more meet the index in a shuffle
    that AQE may split. Pairs for which same holds are left out, without own those whose key is the query's id, and
    vectors that are null or have null or non-finite parts, on either side. A batch of up to MOST_QUERIES by cosine
    without a condition meets the index in blocks of matrices; vectors of another width than its first are left out there."""
    asked = queries.where(usable(F.col("query_vector"))).withColumn("cell", F.explode(nearest_cells(queries, centres, "query_vector", probes, metric)))
    keys = ["cell", by] if by else ["cell"]
    few = queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    if few and same is None and metric == "cosine":
        best = _block_search(index.where(usable(F.col(vector))), asked, k, key, vector, by, own)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)
    pairs = index.where(usable(F.col(vector))).join(F.broadcast(asked) if few else asked, keys)
    pairs = pairs if own else pairs.where(~F.col(key).eqNullSafe(F.col("query_id")))
    if same is not None:
        pairs = pairs.where(~same)
    scored = pairs.select("query_id", key, SIMILARITIES[metric](F.col(vector), F.col("query_vector")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))  # the k best a task go on to the shuffle
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


BLOCK, NEAR = 1_024, 1e-9  # rows compared at once; how far products of matrices may be off


def _block_search(rows: DataFrame, asked: DataFrame, k: int, key: str, vector: str, by: str | None, own: bool) -> DataFrame:
    """(query_id, key, score): the k best rows of each task for each query, by exact cosine; a task holds those and one block.

    asked: (query_id, by, query_vector, cell), of MOST_QUERIES queries at most. A product of matrices
    tells which rows may be among the best; their scores are then computed row by row, so equal vectors tie."""
    found: dict = {}  # a row a query; only the cells are many
    for r in asked.groupBy("query_id", *([by] if by else []), "query_vector").agg(F.collect_list("cell").alias("cells")).collect():
        found[len(found)] = (r["query_id"], r[by] if by else None, np.array(r["query_vector"], np.float64), r["cells"])
    width = len(found[0][2]) if found else 0
    kept = [q for q in found.values() if len(q[2]) == width and width]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    q = np.array([v for _, _, v, _ in kept]).reshape(len(kept), width)
    probed = np.zeros((max([c for *_, cells in kept for c in cells], default=0) + 1, len(kept)), bool)
    for i, (*_, cells) in enumerate(kept):
        probed[cells, i] = True
    tenants = {t: np.array([x[1] == t for x in kept]) for t in {x[1] for x in kept}}
    places: dict = {}
    for i, x in enumerate(kept):
        places.setdefault(x[0], []).append(i)
    shared = rows.sparkSession.sparkContext.broadcast((q, unit(q), probed, tenants, places, [x[0] for x in kept]))
    columns = ["cell", key, vector, *([by] if by else [])]
    fields = {f.name: f.dataType for f in rows.schema} | {f"q.{f.name}": f.dataType for f in asked.schema}
    out = T.StructType([T.StructField("query_id", fields["q.query_id"]), T.StructField(key, fields[key]), T.StructField("score", T.DoubleType())])
    own_schema = to_arrow_schema(out)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, unit_q, probed, tenants, places, names = shared.value
        top: list[list[tuple]] = [[] for _ in names]  # (-score, key), best first
        least = np.full(len(names), -np.inf)
        norms = np.sqrt((q * q).sum(1))
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                cells, keys, vectors, *owners = (c.to_pylist() for c in whole.slice(start, BLOCK).columns)
                fit = [i for i, v in enumerate(vectors) if len(v) == q.shape[1] and cells[i] < len(probed)]
                if not fit or not names:
                    continue
                x = np.array([vectors[i] for i in fit], np.float64)
                meets = probed[[cells[i] for i in fit]]
                if owners:
                    none = np.zeros(len(names), bool)
                    meets = meets & np.array([tenants.get(owners[0][i], none) for i in fit])
                if not own:
                    for row, i in enumerate(fit):
                        meets[row, places.get(keys[i], [])] = False
                close = np.where(meets, np.clip(unit(x) @ unit_q.T, 0.0, 1.0), -np.inf)
                bar = least
                if len(fit) > k:  # of this block, too, only its k best can count
                    bar = np.maximum(least, np.partition(close, len(fit) - k, axis=0)[len(fit) - k])
                at, of = np.nonzero((close >= bar - NEAR) & meets)
                if not len(at):
                    continue
                a, b = x[at], q[of]
                n = np.sqrt((a * a).sum(1)) * norms[of]
                scores = np.where(n == 0, 0.0, np.clip((a * b).sum(1) / np.where(n == 0, 1.0, n), 0.0, 1.0))
                touched = set(of.tolist())
                for row, i, score in zip(at.tolist(), of.tolist(), scores.tolist(), strict=True):
                    top[i].append((-score, keys[fit[row]]))
                for i in touched:
                    top[i] = sorted(top[i])[:k]
                    least[i] = -top[i][-1][0] if len(top[i]) == k else -np.inf
        made = [(names[i], name, -score) for i, rows_ in enumerate(top) for score, name in rows_]
        yield pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], own_schema.field(j).type) for j in range(3)], schema=own_schema)

    return rows.select(*columns).mapInArrow(best, out)

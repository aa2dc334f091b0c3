"""The opN queries: thin digests of the operators over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import decontaminate, language_id, near_dup, packing, sharding, suffix_dedup, topk, toxicity, url_filter, warc
from lodeweave.llm.common import read_table, with_row_id

RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"  # rows that nothing is learnt from
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(24)], 4099


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, "url", RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(f"not coalesce({HELD_OUT}, true)"))
    out = toxicity.score(docs.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "text"), weights)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(docs, "doc_id", SHARDS, SLOTS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    model = language_id.fit(docs.where(f"not coalesce({HELD_OUT}, true)"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, TOKENIZER)


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20, scale=64)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_id(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_dup.find(docs, shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_maxscore": op9_maxscore,
    "op10_near_duplicates": op10_near_duplicates,
}


def oracle_sql() -> dict[str, str]:
    table = ",".join(map(str, sharding.fill_table(SHARDS, SLOTS)))
    slot = f"(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::BIGINT % {SLOTS})"
    digest = " || ".join(
        f"substr('{warc.BASE32}', ((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {15 - 5 * i}) & 31) + 1, 1)" for g in range(8) for i in range(4)
    )
    return {
        "op4_sharding": f"SELECT doc_id, {slot}::INTEGER AS slot, ([{table}])[{slot} + 1]::INTEGER AS shard FROM documents",
        "op7_warc": f"""
            WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
            e AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM d)
            SELECT page_id, payload_bytes, {digest} AS payload_digest,
                   CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first < page_id THEN first END AS refers_to FROM e""",
        "op9_maxscore": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                       WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS query_id, b.vec_id,
                         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
                  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    }

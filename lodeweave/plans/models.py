"""Queries of models, the store, sources and streaming. Model outputs are checked by row count only."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions.embeddings import encoder
from lodeweave.operators import ml
from lodeweave.operators import tabular as t
from lodeweave.plans.registry import query, table
from lodeweave.sources.store import changed, same_content, unchanged


def _orders(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").cast("double").alias("month"), "o_orderpriority")
    return t.hash_split(x, "o_orderkey")


@query()
def logistic_risk_list(spark, d):
    x = _orders(spark, d)
    model = ml.fit_classifier(x.where("part = 'train'"), "label", ["price", "month"], "logistic", ["o_orderpriority"], maxIter=10)
    return ml.risk_list(model, x.where("part = 'test'"), "o_orderkey")


@query()
def forest_classifier(spark, d):
    x = _orders(spark, d)
    model = ml.fit_classifier(x.where("part = 'train'"), "label", ["price", "month"], "forest", numTrees=10)
    out = model.transform(x.where("part = 'test'")).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
    return t.confusion(out, "label", "predicted")


@query()
def boosted_regressor(spark, d):
    x = table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1e4).alias("y"))
    model = ml.fit_regressor(x, "y", ["l_quantity", "l_discount"], "boosted", maxIter=3)
    return t.regression_metrics(model.transform(x), "y", "prediction")


@query()
def linear_svm(spark, d):
    x = _orders(spark, d)
    model = ml.fit_classifier(x, "label", ["price", "month"], "svm", maxIter=5)
    return t.accuracy(model.transform(x).withColumn("p", F.col("prediction").cast("int")), "label", "p")


@query()
def dense_classifier(spark, d):
    x = _orders(spark, d)
    model = ml.fit_classifier(x, "label", ["price", "month"], "dense", layers=[2, 4, 2], maxIter=5)
    return t.accuracy(model.transform(x).withColumn("p", F.col("prediction").cast("int")), "label", "p")


@query()
def text_classifier(spark, d):
    x = table(spark, d, "conversations").where("role <> 'system'").select("text", (F.col("role") == "user").cast("int").alias("label"))
    features = ml.text_pipeline("text", 300, 200).fit(x).transform(x)
    model = ml.CLASSIFIERS["logistic"](maxIter=5).setLabelCol("label").fit(features)
    out = model.transform(features).withColumn("p", F.col("prediction").cast("int"))
    return t.classification_report(out, "label", "p")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e, v FROM v)
    SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top, list_position(v, list_max(v))::INTEGER - 1 AS best, round(1 / (1 + exp(-v[1])), 6) AS sig FROM e""")
def softmax_argmax(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    x = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return x.select("vec_id", F.round(F.array_max(ml.softmax(F.col("v"))), 6).alias("top"), ml.argmax(F.col("v")).cast("int").alias("best"), F.round(ml.sigmoid(F.col("v")[0]), 6).alias("sig"))


@query()
def hashed_embeddings(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", encoder("hashing", width=64)(F.col("text")).alias("vector"))


# the index holds every document, some of them as they were before a change
_DIGESTS = "SELECT source, doc_id, sha256(text) AS digest, CASE WHEN n_chars % 3 = 0 THEN sha256(text || '.') ELSE sha256(text) END AS indexed FROM documents"


def _digests(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("digest"), "n_chars", "text")
    return x.withColumn("indexed", F.when(F.col("n_chars") % 3 == 0, F.sha2(F.concat("text", F.lit(".")), 256)).otherwise(F.col("digest"))).drop("text", "n_chars")


def _index(x):
    return x.select("tenant_id", "document_id", F.col("indexed").alias("digest"))


@query(f"WITH d AS ({_DIGESTS}) SELECT source AS tenant_id, doc_id AS document_id, digest FROM d WHERE digest = indexed")
def unchanged_documents(spark, d):
    x = _digests(spark, d)
    return unchanged(x.drop("indexed"), _index(x)).select("tenant_id", "document_id", "digest")


@query(f"WITH d AS ({_DIGESTS}) SELECT source AS tenant_id, doc_id AS document_id, digest FROM d WHERE digest <> indexed")
def changed_documents(spark, d):
    x = _digests(spark, d)
    return changed(x.drop("indexed"), _index(x)).select("tenant_id", "document_id", "digest")


@query(f"WITH d AS ({_DIGESTS}), t AS (SELECT source, digest, min(doc_id) AS lo, max(doc_id) AS hi FROM d GROUP BY ALL) SELECT d.source AS tenant_id, d.doc_id AS document_id, CASE WHEN lo <> d.doc_id THEN lo ELSE hi END AS twin FROM d JOIN t USING (source, digest) WHERE lo <> d.doc_id OR hi <> d.doc_id")
def duplicate_documents(spark, d):
    x = _digests(spark, d).drop("indexed")
    return same_content(x, x)


@query("SELECT conv_id AS job_id, count(*) AS processed, count(*) FILTER (role <> 'system') AS succeeded, count(*) FILTER (role = 'system') AS failed, 1.0::DOUBLE AS progress FROM conversations GROUP BY conv_id")
def job_progress(spark, d):
    from lodeweave.streaming.ingest import job_progress as progress

    c = table(spark, d, "conversations")
    total = c.groupBy("conv_id").agg(F.count("*").alias("total"))
    items = c.join(total, "conv_id").select(F.col("conv_id").alias("job_id"), "total", F.when(F.col("role") == "system", "failed").otherwise("success").alias("status"), F.lit(1).alias("chunks"))
    return progress(items).select("job_id", "processed", "succeeded", "failed", "progress")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    from lodeweave.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), width="1 day").withColumn("total", F.round("total", 4))

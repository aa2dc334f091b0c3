"""Queries of the smaller steps against their SQL, on the smallest tables, and their refusals."""

import base64
import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import ann, answers, context, retrieval, tabular
from lodeweave.plans import steps
from lodeweave.plans.registry import QUERIES, SQL
from lodeweave.sources import store as stores
from lodeweave.streaming import ingest

TABLES = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == steps.__name__ and n in SQL)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    names = sorted(got.columns)
    want = duck.execute(SQL[name])
    at = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(at) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(plain(r[at[c]]) for c in names) for r in want.fetchall())


def test_refusals(spark):
    x = spark.createDataFrame([("q", " ", [1.0])], "query_id string, tenant_id string, query_vector array<double>")
    v = spark.createDataFrame([(" ", "c", [1.0])], "tenant_id string, chunk_id string, vector array<double>")
    with pytest.raises(Exception, match="tenant"):
        retrieval.simple_search(v, x, 3).collect()
    with pytest.raises(ValueError):
        tabular.drop_columns(x, ["nothing"])
    with pytest.raises(ValueError):
        answers.provider("nobody")
    answers.register_provider("echo", lambda p: p)
    assert answers.provider("echo")(F.lit("x")) is not None


def test_evictions_of_nothing(spark):
    jobs = spark.createDataFrame([], "job_id string, finished_at timestamp")
    assert ingest.evicted_jobs(jobs, 2).count() == 0
    entries = spark.createDataFrame([("a", 1, 900), ("b", 2, 900)], "name string, used_at long, size long")
    assert [r["name"] for r in ingest.evicted_entries(entries, 10).collect()] == ["a"]  # the newest stays


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["before"] for r in tabular.running_before(rows, "id", F.col("v"), "before").collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7
    assert tabular.running_before(rows.limit(0), "id", F.col("v"), "before").count() == 0


def test_quantiles_of_groups(spark):
    values = {"a": [3.0, 1.0, 1.0, 1.0, 9.0], None: [2.0], "b": [5.0, 7.0]}
    rows = [(g, v) for g, vs in values.items() for v in [*vs, None, float("nan")]] + [("none", None)]
    x = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in tabular.quantiles(x, ["g"], "v", (0, 0.25, 0.5, 0.9, 1)).collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        assert got[g] == pytest.approx(np.quantile(vs, (0, 0.25, 0.5, 0.9, 1)).tolist())
    assert tabular.quantiles(x.limit(0), ["g"], "v", (0.5,)).count() == 0
    assert tabular.fill_median(x.where("v is null"), ["v"]).where("v is not null").count() == 0


def test_exact_counts_equal_the_library(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from lodeweave.functions import counters

    texts = ["", "two words", "Zwölf Bücher, 3,14 €", "  blanks\n\n and <|endoftext|> marks", None]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [len(own.encode_ordinary(t or "")) for t in texts]
    for name, pattern in (("byte_bpe_50k.tiktoken", public.PATTERN), ("byte_bpe_50k.json", None)):
        count = counters.counter(spark, "exact", public.path(name), pattern)
        assert [r["n"] for r in x.select("i", count(F.col("text")).alias("n")).orderBy("i").collect()] == want
    with pytest.warns(UserWarning, match="estimates"):
        assert counters.counter(spark, "exact", "/nowhere.json") is counters.counter(spark)
    with pytest.raises(ValueError):
        counters.counter(spark, "other")


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError
        return x

    assert answers.retrying(call, sleep=waits.append)(7) == 7 and waits == [1.5, 3.0]
    with pytest.raises(TimeoutError):
        answers.retrying(lambda: (_ for _ in ()).throw(TimeoutError), sleep=waits.append)()
    with pytest.raises(ValueError):
        answers.retrying(lambda: int("x"), sleep=waits.append)()
    assert waits == [1.5, 3.0, 1.5, 3.0]


def test_failed_turns_are_taken_back(spark):
    h = spark.createDataFrame([("a", 0, "user", "hi"), ("a", 1, "assistant", "yes")], "conv_id string, turn int, role string, text string")
    said = spark.createDataFrame([("a", "more"), ("b", "first")], "conv_id string, text string")
    got = answers.chat_turn(h, said, lambda p: F.when(~F.contains(p, F.lit("first")), p))
    assert [tuple(r) for r in got.orderBy("conv_id", "turn").collect()][2:] == [("a", 2, "user", "more"), ("a", 3, "assistant", "user: hi\nassistant: yes\nuser: more")]


def test_sentence_report(spark):
    x = spark.createDataFrame([("Kya hai the plan?", [0.2, 0.8]), ("  ", [0.5, 0.5]), (None, None)], "text string, p array<double>")
    full, blank, null = [r[0] for r in x.select(answers.sentence_report(F.col("text"), F.col("p"), ["bad", "good"], ["hai"], ["the"])).collect()]
    assert (full["label"], full["confidence"], full["scores"]) == ("good", 0.8, {"bad": 0.2, "good": 0.8})
    assert [tuple(t) for t in full["word_tags"]] == [("Kya", "UNK"), ("hai", "HI"), ("the", "EN"), ("plan?", "UNK")] and tuple(full["mix"]) == (0.25, 0.25, 0.5)
    assert blank["label"] is None and blank["error"] == null["error"] == "no text"


def test_cells_find_what_the_exact_search_finds(spark):
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(20, 8))
    rows = [(f"{i:04}", "t", (hubs[i % 20] + 0.1 * rng.normal(size=8)).tolist()) for i in range(600)]
    odd = [("null", "t", None), ("nan", "t", [float("nan")] * 8), ("gap", "t", [None] * 8)]
    x = spark.createDataFrame(rows + odd, "chunk_id string, tenant_id string, vector array<double>")
    q = x.where("chunk_id in ('0007', '0123', '0599', 'nan')").selectExpr("chunk_id as query_id", "tenant_id", "vector as query_vector")
    centres = ann.fit_centres(x, cells=16)
    index = ann.build(x, centres)
    assert index.count() == 603 and index.where("cell is null").count() == 0
    found = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = found(retrieval.batch_vector_top_k(x.where("chunk_id < 'a'"), q.where("query_id < 'a'"), 5))
    assert found(ann.search(index, centres, q, 5, probes=16)) == exact
    assert len(found(ann.search(index, centres, q, 5, probes=3)) & exact) >= 0.9 * len(exact)
    none = ann.fit_centres(x.limit(0))
    assert ann.search(ann.build(x.limit(0), none), none, q, 5).count() == 0


def test_registries_name_what_they_know(spark, tmp_path):
    with pytest.raises(ValueError, match="lexical"):
        retrieval.rerank(None, 3, by="other")
    with pytest.raises(ValueError, match="parquet"):
        stores.open_store(spark, str(tmp_path), "other")
    retrieval.register_reranker("shorter", lambda text, terms, phrases: 1 / F.length(text))
    x = spark.createDataFrame([("q", "long", "a long text", 1.0, False, [], []), ("q", "short", "text", 1.0, False, [], [])], "query_id string, chunk_id string, text string, rank_score double, pinned boolean, terms array<string>, phrases array<string>")
    assert [r["chunk_id"] for r in retrieval.rerank(x, 2, by="shorter").orderBy("rank").collect()] == ["short", "long"]
    del retrieval.RERANKERS["shorter"]


def test_twins_of_what_is_stored(spark, tmp_path):
    store = stores.open_store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("a", "d1", "same words here")], "tenant_id string, document_id string, text string")
    assert stores.indexed_twins(store, "a", docs).count() == 0
    stores.index_documents(store, "a", docs)
    assert stores.indexed_twins(store, "a", docs).count() == 0  # itself isn't a twin
    again = docs.withColumn("document_id", F.lit("d2"))
    assert [r["twin"] for r in stores.indexed_twins(store, "a", again).collect()] == ["d1"]


def test_context_warnings(spark):
    sources = spark.createDataFrame([("a", True, 90, 60, False), ("a", False, 10, 10, None), ("b", False, 5, 5, True)], "query_id string, truncated boolean, original_tokens int, text_tokens int, ocr boolean")
    omitted = spark.createDataFrame([("a", "budget_exhausted"), ("b", "below_floor"), ("c", "empty")], "query_id string, reason string")
    got = {r["query_id"]: r["warnings"] for r in context.warnings(sources, omitted, 2).collect()}
    assert got == {"a": ["shortened:30", "left_out:1"], "b": ["few_sources", "ocr"], "c": ["no_sources"]}

"""Empty texts, ties and plans of queries that grow with their tables."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodeweave.functions import counters, kernels, segments
from lodeweave.functions import text as tx
from lodeweave.operators import ann, chunking, context, ml, retrieval
from lodeweave.plans import catalog

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, texts):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_ratios_of_an_empty_text(spark, tmp_path):
    found = catalog.QUERIES["group_mean_ratios"](spark, documents(spark, tmp_path, ["a.1", "b.", None, "", "c"]))
    got = {r["lang"]: r for r in found.collect()}
    assert got["de"]["digits"] == round(1 / 6, 6) and got["en"]["dots"] != got["en"]["dots"]  # NaN, as 0 / 0 in SQL


def test_evidence_moves_no_text_but_that_of_the_best(spark):
    rows = [("q", f"c{i % 7}", i % 5 / 5, i % 11 == 0, " " if i % 6 == 0 else "x") for i in range(60)] + [("p", "c", None, None, "y"), (None, "d", 0.5, False, "z")]
    x = spark.createDataFrame(rows, "query_id string, chunk_id string, final_score double, pinned boolean, text string")
    for most in (0, 1, 4, 9, 100):
        kept, omitted = context.select_evidence(x, 0.1, most)
        want = []
        for q in ("q", "p", None):
            usable = [r for r in rows if r[0] == q and r[4].strip() and not (r[2] is not None and r[2] < 0.1)]
            usable.sort(key=lambda r: (not r[3], -(r[2] or 0), r[1]))
            want += [(q, r[1], r[2]) for r in usable[:most]]
        key = lambda t: tuple(str(v) for v in t)
        assert sorted([(r["query_id"], r["chunk_id"], r["final_score"]) for r in kept.collect()], key=key) == sorted(want, key=key)
        reasons = omitted.groupBy("reason").count().collect()
        assert sum(r["count"] for r in reasons) + len(want) == len(rows)
    plan = context.select_evidence(x, 0.1, 4)[0]._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if re.search(r"\bWindow \[", line)]
    assert len(windows) == 2 and "WindowGroupLimit" in plan


ODD = ["the notices' KKelvin İs 3.5/x-ray a.b. -- us bus classes cities", "", None, "... -/- .", "gas gas it's e-mail/e-mail", "the of", "x" * 20, "Σσ cafés ss"]


def test_kernels_count_as_the_column_functions(spark):
    x = spark.createDataFrame(list(enumerate(ODD)), "i long, t string")
    terms = {r["i"]: list(r["t"]) for r in x.select("i", tx.terms(F.col("t")).alias("t")).collect()}
    got = kernels.counted_terms(x, F.col("t"), ["i"]).collect()
    assert {(r["i"], r["term"]): r["tf"] for r in got} == {(i, w): t.count(w) for i, t in terms.items() for w in t}
    assert all(r["length"] == len(terms[r["i"]]) for r in got)
    assert {r["i"]: r["n"] for r in x.select("i", kernels.term_length(F.col("t")).alias("n")).collect()} == {i: len(t) for i, t in terms.items()}
    pairs = kernels.counted_pairs(x, F.col("t")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    want = [f"{a} {b}" for t in terms.values() for a, b in zip(t, t[1:])]
    assert {r["pair"]: r["n"] for r in pairs} == {p: want.count(p) for p in want}


def test_shingles_are_counted_without_arrays(spark, tmp_path):
    x = spark.createDataFrame(list(enumerate(ODD)), "i long, t string")
    both = x.select(kernels.shingle_count(F.col("t")).alias("a"), F.size(tx.char_shingles(F.col("t"))).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both]
    plan = catalog.QUERIES["shingle_counts"](spark, documents(spark, tmp_path, ODD))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "sequence" not in plan


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_keyword_search_moves_asked_postings_only(spark, tmp_path):
    d = documents(spark, tmp_path, ["de la que", "de que que", None, "und der"])
    plan = catalog.QUERIES["bm25_topk"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi.*rightHint=\(strategy=broadcast\)", plan)  # rows meet the asked terms where they are
    c = spark.createDataFrame([("a", "c", "x y"), ("a", "c", "x"), ("a", "e", "y z")], "tenant_id string, chunk_id string, text string")
    plan = retrieval.postings(c, ranged=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") > 0  # one shuffle, the duplicates' counts add up there
    assert {(r["chunk_id"], r["term"]): r["tf"] for r in retrieval.postings(c, ranged=True).collect()} == {("c", "x"): 2, ("c", "y"): 1, ("e", "y"): 1, ("e", "z"): 1}


def test_tfidf_moves_the_vocabulary_only(spark, tmp_path):
    found = catalog.QUERIES["tfidf"](spark, documents(spark, tmp_path, ["b b c", "c d", "", None, "b"]))
    assert found.where("doc_id = 4").first()["weight"] == 1.0
    assert not [e for e in _exchanges(found) if re.search(r"hashpartitioning\(doc_id#\d+L?, term#", e)]


def test_equal_texts_tie(spark):
    words = ["de", "der", "die", "que", "und"]
    rows = [("t", f"c{i}", " ".join(words[i % 5 :] + words[: i % 5]) + " zz" * 3) for i in range(10)]
    c = spark.createDataFrame(rows + [("t", "other", "xx")], "tenant_id string, chunk_id string, text string")
    q = spark.createDataFrame([("q", "t", words)], "query_id string, tenant_id string, terms array<string>")
    out = retrieval.bm25(retrieval.postings(c, asked=q), retrieval.corpus_stats(c), q)
    assert out.select("score").distinct().count() == 1


def test_texts_are_encoded_as_they_come():
    seen = []
    encode = counters._encoder(b"YQ== 0\nYg== 1\n", r"\w+")
    texts = (seen.append(t) or t for t in ["ab", "b"])
    counts = iter(encode(texts))
    assert len(next(counts)) == 2 and seen == ["ab"]  # ids of one text at a time


def test_token_count_of_odd_pieces():
    for text, n in [("1.,,5", 2), ("abcde 12.5", 4), ("²³ x", 3), ("", 0), ("é abcdabcd", 3)]:
        assert segments.count(text) == n
    assert not segments.surely_over("abcd " * 10, 10) and segments.surely_over("abcd " * 10 + "e", 10)


def test_documents_are_moved_once_to_be_chunked(spark):
    docs = spark.createDataFrame([("a", "d", "One. Two.\n\nThree."), ("a", "e", None), ("b", "d", "Four.")], "tenant_id string, document_id string, text string")
    out = chunking.chunk_documents(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r["text"] for r in out.collect()) == ["Four.", "One. Two.\n\nThree."]
    assert sorted(map(tuple, out.drop("block_ids").collect())) == sorted(map(tuple, chunking.chunk(chunking.document_blocks(docs)).drop("block_ids").collect()))


def test_block_search_finds_the_rows_of_the_join(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6))
    v[7], v[8] = v[9], 0.0
    x = spark.createDataFrame([(i, "ab"[i % 2], r.tolist()) for i, r in enumerate(v)], "k long, t string, vector array<double>")
    q = x.where("k % 3 = 0").select(F.col("k").alias("query_id"), "t", F.col("vector").alias("query_vector"))
    centres = ann.fit_centres(x, key="k", cells=8)
    for by in (None, "t"):
        asked = q if by else q.drop("t")
        common = dict(probes=3, key="k", by=by)
        fast = ann.search(ann.build(x, centres), centres, asked, 4, own=False, **common)
        slow = ann.search(ann.build(x, centres), centres, asked, 4, same=F.col("k") == F.col("query_id"), **common)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["k"], round(r["score"], 9)) for r in df.collect())
        assert rows(fast) == rows(slow)
        assert "Join" not in fast._jdf.queryExecution().optimizedPlan().toString()


def test_trees_read_parts_of_bounded_size(spark):
    x = spark.range(1_000_001).coalesce(1)
    assert ml.in_parts(x, "boosted").rdd.getNumPartitions() == 6 and ml.in_parts(x, "linear").rdd.getNumPartitions() == 1

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import embeddings, segments
from lodeweave.operators import answers, chunking, cleaning, context, retrieval
from lodeweave.operators import tabular as t
from lodeweave.sources import readers
from lodeweave.sources.store import ChunkStore, index_documents, search_index
from lodeweave.streaming import ingest

QUERY = "query_id string, tenant_id string, terms array<string>, phrases array<string>, numbers array<string>"


def test_next_row_target(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 2.0)], "i int, c double")
    assert [r["target"] for r in t.next_row_target(x, "c", [], ["i"]).orderBy("i").collect()] == [1, 0, 0]


def test_scope_needs_a_tenant(spark):
    with pytest.raises(ValueError, match="tenant"):
        t.scope(" ")
    x = spark.createDataFrame([("a", p) for p in (5, 10, 20, 25, None)], "tenant_id string, page_number int")
    assert x.where(t.scope("a", page_range=(20, 10))).count() == 2


@pytest.mark.parametrize(("values", "want"), [([0.0, 0.0], [0.0, 0.0]), ([2.0, 1.0], [1.0, 0.5]), ([-1.0, 2.0], [0.0, 1.0])])
def test_scale_to_max(spark, values, want):
    x = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("g", F.lit(1))
    assert [r["s"] for r in x.withColumn("s", t.scale_to_max(F.col("v"), ["g"])).orderBy("i").collect()] == want


def test_describe_treats_nan_as_missing(spark):
    x = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert t.describe(x).first()["count"] == 2 and t.null_counts(x).first()["n"] == 2


def chunks(spark):
    rows = [("a", "c1", "d1", 0, "4. Termination", "either party may terminate with notice"), ("a", "c2", "d1", 1, "Fees", "fees are due under clause 4 here"), ("b", "c3", "d2", 0, None, "terminate notice terminate")]
    return spark.createDataFrame(rows, "tenant_id string, chunk_id string, document_id string, chunk_index int, section string, text string")


def test_hybrid_search_pins_named_clause_and_isolates_tenants(spark):
    c = chunks(spark)
    q = spark.createDataFrame([("q", "a", ["terminate", "notice"], [], ["4"])], QUERY)
    sem = spark.createDataFrame([("q", "c2", 0.9, 1), ("q", "c1", 0.1, 2)], "query_id string, chunk_id string, score double, rank int")
    out = retrieval.hybrid_search(c, retrieval.postings(c, "section"), retrieval.corpus_stats(c, "section"), q, sem).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["c1", "c2"] and out[0]["pinned"]
    with pytest.raises(ValueError, match="mode"):
        retrieval.hybrid_search(c, c, c, q, sem, mode="other")
    with pytest.raises(ValueError, match="fusion"):
        retrieval.fuse(sem, sem, "other")


def test_collapse(spark):
    rows = [("q", "c1", "d", 0, 1, "The same text, here."), ("q", "c2", "d", 5, 2, "the SAME text here"), ("q", "c3", "d", 1, 3, "the same text here now"), ("q", "c4", "e", 0, 4, "something else entirely")]
    pool = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, chunk_index int, rank int, text string")
    kept = {r["chunk_id"]: r["duplicates"] for r in retrieval.collapse(pool, 0.6).collect()}
    assert kept == {"c1": ["c2"], "c3": [], "c4": []}  # c3 is c1's neighbour
    assert set(r["chunk_id"] for r in retrieval.collapse(pool, 0.6, keep_adjacent=False).collect()) == {"c1", "c4"}


def test_rrf_prefers_two_signals(spark):
    sem = spark.createDataFrame([("q", "x", 0.9, 1), ("q", "y", 0.8, 2)], "query_id string, chunk_id string, score double, rank int")
    key = spark.createDataFrame([("q", "y", 1.0, 3)], "query_id string, chunk_id string, score double, rank int")
    assert retrieval.fuse(sem, key).orderBy(F.desc("fused_score")).first()["chunk_id"] == "y"


TEXT = "\n\n".join(f"{i}. Heading {i}\n" + " ".join(f"Sentence {j} of part {i} says something about words." for j in range(i * 6)) for i in range(1, 6))


def test_chunks_lose_no_word_and_keep_the_ceiling(spark):
    docs = spark.createDataFrame([("t", "d", TEXT), ("t", "e", "x" * 5000), ("t", "f", "")], "tenant_id string, document_id string, text string")
    sizes = chunking.Sizes(size=64, overlap=16, min_tokens=10)
    out = chunking.chunk(chunking.document_blocks(docs), sizes)
    rows = out.orderBy("document_id", "chunk_index").collect()
    again = out.orderBy("document_id", "chunk_index").collect()
    assert rows == again
    d = [r for r in rows if r["document_id"] == "d"]
    assert [r["chunk_index"] for r in d] == list(range(len(d)))
    assert all(r["token_count"] <= sizes.ceiling for r in rows)
    assert set(TEXT.split()) <= set(" ".join(r["text"] for r in d).split())
    assert "".join(r["text"].replace("\n\n", "") for r in rows if r["document_id"] == "e").count("x") >= 5000
    assert not [r for r in rows if r["document_id"] == "f"] and len({r["chunk_id"] for r in rows}) == len(rows)


def test_overlap_doesnt_compound():
    long = " ".join(["word"] * 400)
    assert segments.count(segments.tail(long, 20)) <= 20


def test_running_lines(spark):
    pages = spark.createDataFrame([("d", p, f"Company Header\nBody {'wxyz'[p - 1]} has words\nPage {p} of 4") for p in range(1, 5)] + [("short", p, "Company Header\nmore text") for p in (1, 2)], "document_id string, page_number int, text string")
    out = {(r["document_id"], r["page_number"]): r["text"] for r in cleaning.clean_pages(pages).collect()}
    assert "Company Header" not in out["d", 1] and "Body w has" in out["d", 1] and "Page 1 of 4" not in out["d", 1]
    assert "Company Header" in out["short", 1] and len(out) == 6


def test_context_fits_the_budget(spark):
    rows = [("q", f"c{i}", f"d{i % 2}", i, "S", "Some sentence of words here. " * 30, False, 1.0 - i / 10) for i in range(8)]
    x = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, chunk_index int, section string, text string, pinned boolean, final_score double")
    sources, evidence, omitted = context.build(x, budget=700, max_sources=6)
    assert sum(r["total_tokens"] for r in sources.collect()) <= 700
    text = evidence.first()["evidence"]
    assert text.startswith("Source 1:") and segments.count(text) <= 700
    assert {r["reason"] for r in omitted.collect()} >= {"max_sources"}
    assert context.statistics(sources, omitted).first()["sources"] == sources.count()
    back = answers.source_blocks(evidence).collect()
    assert len(back) == sources.count()


def test_replies():
    assert answers.source_number("2") == 2 and answers.source_number(2.0) == 2 and answers.source_number("Source 2") == 2
    assert answers.source_number(True) is None and answers.source_number("the clause") is None
    p = answers.parse_reply('Sure! {"answer": "a } b", "citations": [{"source": "Source 2"}, 3, 3]} trailing')
    assert p["answer"] == "a } b" and p["cited"] == [2, 3] and p["recovered"]
    assert answers.parse_reply("no json")["error"] and answers.parse_reply("")["error"] and answers.parse_reply('{"x": 1}')["error"]


def test_citations_and_quotes(spark):
    a = spark.createDataFrame([("q", 'It says "the vendor shall not assign" per Source 9.', [1, 7], False)], "query_id string, answer string, cited array<int>, insufficient boolean")
    s = spark.createDataFrame([("q", 1, "c1", "The Vendor shall\nnot assign.")], "query_id string, number int, chunk_id string, text string")
    status = {r["number"]: r["status"] for r in answers.check_citations(a, s).collect()}
    assert status == {1: "ok", 7: "unknown_source", 9: "unknown_source_in_answer"}
    assert [r["verified"] for r in answers.check_quotes(a, s).collect()] == [True]
    assert answers.grounded(a, s).first()["grounded"] is False


def test_extractive_answer(spark):
    s = spark.createDataFrame([("q", 1, "Notice is thirty days. Fees are due."), ("q", 2, "Termination needs notice.")], "query_id string, number int, text string")
    q = spark.createDataFrame([("q", ["notice", "terminate"]), ("r", ["x"])], "query_id string, terms array<string>")
    out = {r["query_id"]: r for r in answers.extractive_answers(s, q).collect()}
    assert out["q"]["answer"] == "Notice is thirty days. Termination needs notice." and out["q"]["cited"] == [1, 2] and out["r"]["insufficient"]


def test_history_trim(spark):
    m = spark.createDataFrame([("c", i, "x" * 12000) for i in range(3)], "conv_id string, turn int, text string")
    assert sorted(r["turn"] for r in answers.trim_history(m).collect()) == [1, 2]


@pytest.mark.parametrize("width", [8, 64, 384])
def test_hashing_encoder(spark, width):
    v = spark.createDataFrame([("notice of termination",), ("",)], "t string").select(embeddings.encoder(width=width)(F.col("t")).alias("v")).collect()
    assert len(v[0]["v"]) == width and abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-9 and not any(v[1]["v"])
    with pytest.raises(ValueError, match="encoder"):
        embeddings.encoder("other")


def test_store_upsert_delete_isolation(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "d1", "c1", 0, "x"), ("b", "d1", "c1", 0, "y")], "tenant_id string, document_id string, chunk_id string, chunk_index int, text string")
    assert store.upsert("a", rows) == 1 and store.upsert("b", rows) == 1
    assert store.upsert("a", rows.withColumn("text", F.lit("z"))) == 2
    assert [r["text"] for r in store.fetch("a").collect()] == ["z"] and [r["text"] for r in store.fetch("b").collect()] == ["y"]
    assert store.delete_document("a", "d1") == 1 and store.count("a") == 0 and store.count("b") == 1
    assert store.delete_tenant("b") == 1 and store.fetch("b") is None
    with pytest.raises(ValueError, match="tenant"):
        store.fetch("")


def test_store_loses_no_write(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    row = lambda c: spark.createDataFrame([("a", "d" + c, c, 0, "x")], "tenant_id string, document_id string, chunk_id string, chunk_index int, text string")
    store.upsert("a", row("1"))
    calls = []

    def late(old):
        if not calls:
            ChunkStore(spark, store.root).upsert("a", row("2"))  # another writer comes first
        calls.append(1)
        return old.unionByName(row("3"))

    assert store.change("a", late) == 3 and len(calls) == 2
    assert [r["chunk_id"] for r in store.fetch("a").collect()] == ["1", "2", "3"]
    assert store.vacuum("a") == 2 and store.count("a") == 3 and len(list((tmp_path / "store/slices").glob("[!.]*"))) == 1
    assert store.vacuum("nobody") == 0 and store.version("nobody") == 0


def test_stored_keywords_follow_the_version(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "d1", "c1", 0, "red apples"), ("a", "d2", "c2", 0, "green pears")], "tenant_id string, document_id string, chunk_id string, chunk_index int, text string")
    asked = spark.createDataFrame([("q", "a", ["apple", "pear"], [], [])], QUERY)
    assert store.keywords("a") is None
    store.upsert("a", rows)
    found = lambda: {r["chunk_id"]: r["raw_score"] for r in search_index(store.keywords("a"), asked, 5).collect()}
    first = found()
    assert first.keys() == {"c1", "c2"} and found() == first
    direct = retrieval.keyword_search(retrieval.postings(rows), retrieval.corpus_stats(rows), asked, 5)
    assert first == pytest.approx({r["chunk_id"]: r["raw_score"] for r in direct.collect()})
    store.delete_document("a", "d1")
    assert found().keys() == {"c2"}


def test_indexing_skips_unchanged(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", "d1", TEXT), ("a", "d2", "short text")], "tenant_id string, document_id string, text string")
    assert index_documents(store, "a", docs)["indexed"] == 2
    n = store.count("a")
    assert index_documents(store, "a", docs) == {"indexed": 0, "unchanged": 2, "version": 1} and store.count("a") == n


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", "d1", "hello words", at), ("a", "d1", "hello words", at), ("a", "d2", "more words", at)]
    spark.createDataFrame(rows, ingest.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    store = ChunkStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.run_ingest(ingest.fresh_documents(ingest.read_stream(spark, str(tmp_path / "in"))), store, str(tmp_path / "ck")).awaitTermination()
    assert store.count("a") == 2


def test_readers(spark, tmp_path):
    x = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, s string")
    readers.write_csv(x, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), "i int, s string").count() == 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_text("plain")
    (tmp_path / "files/b.docx").write_bytes(b"nope")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "files/c.docx").write_bytes(buffer.getvalue())
    out = {(r["path"].rsplit("/", 1)[1], r["page_number"]): r for r in readers.read_documents(spark, str(tmp_path / "files")).collect()}
    assert out["a.txt", 0]["text"] == "plain" and out["b.docx", None]["error"] and out["c.docx", 1]["text"] == "One" and "x | y" in out["c.docx", 2]["text"]
    assert readers.checked_path("a/b.txt", "/root/x", {"txt"}) == "/root/x/a/b.txt"
    for bad in ("../x.txt", "/etc/x.txt", "a.exe"):
        with pytest.raises(ValueError):
            readers.checked_path(bad, "/root/x", {"txt"})


def test_text_classifier_reads_whole_texts(spark, tmp_path):
    from lodeweave.plans.models import text_classifier

    same = "the same long opening of every turn " * 10  # over 300 characters
    rows = [(i, 0, role, same + word) for i in range(20) for role, word in (("user", "question please"), ("assistant", "answer given"), ("system", "rules"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r["class"]: r for r in text_classifier(spark, str(tmp_path)).collect()}
    assert out["weighted avg"]["f1"] == 1 and out["weighted avg"]["support"] == 40


def test_digest_covers_the_whole_text(spark):
    from lodeweave.functions import ids

    long = F.repeat(F.lit("x"), 8 * 1024 * 1024)
    row = spark.range(1).select(ids.digest(F.concat(long, F.lit("a"))).alias("a"), ids.digest(F.concat(long, F.lit("b"))).alias("b")).first()
    assert row["a"] != row["b"]

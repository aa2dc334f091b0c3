"""Queries of the smaller steps: profiling, cleaning, blocks, evidence, answers, stores, files and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.functions import counters
from lodeweave.functions import lexicon as L
from lodeweave.functions import text as tx
from lodeweave.operators import answers, chunking, cleaning, context, ml
from lodeweave.operators import retrieval as r
from lodeweave.operators import tabular as t
from lodeweave.plans.registry import query, scratch, table
from lodeweave.sources import readers
from lodeweave.sources.store import ChunkStore
from lodeweave.streaming import ingest


# --- tabular -----------------------------------------------------------------------


@query("SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS order_status FROM orders")
def renamed_columns(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias(" order key "), F.col("o_totalprice").alias("total-price"), F.col("o_orderstatus").alias("order status"))
    return t.clean_names(x)


@query("SELECT doc_id, lang, source FROM documents")
def dropped_columns(spark, d):
    return t.drop_columns(table(spark, d, "documents"), ["text", "n_chars"])


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric_part(spark, d):
    x = table(spark, d, "customer")
    return x.select(*t.numeric_columns(x))


@query("SELECT c_name, c_mktsegment FROM customer")
def text_part(spark, d):
    x = table(spark, d, "customer")
    return x.select(*t.text_columns(x))


@query("""SELECT (ordinal - 1)::INTEGER AS position, name AS "column", present FROM (
    SELECT 1 AS ordinal, 'o_orderkey' AS name, count(o_orderkey) AS present FROM orders UNION ALL SELECT 2, 'o_custkey', count(o_custkey) FROM orders UNION ALL SELECT 3, 'o_orderstatus', count(o_orderstatus) FROM orders
    UNION ALL SELECT 4, 'o_totalprice', count(o_totalprice) FROM orders UNION ALL SELECT 5, 'o_orderdate', count(o_orderdate) FROM orders UNION ALL SELECT 6, 'o_orderpriority', count(o_orderpriority) FROM orders)""")
def table_info(spark, d):
    return t.info(table(spark, d, "orders")).select("position", "column", "present")


@query("(SELECT 'first' AS part, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def head_and_tail(spark, d):
    x = table(spark, d, "orders").select("o_orderkey")
    return t.first_rows(x, ["o_orderkey"]).select(F.lit("first").alias("part"), "o_orderkey").union(t.last_rows(x, ["o_orderkey"]).select(F.lit("last"), "o_orderkey"))


@query("""SELECT x::DOUBLE AS x, round(avg(exp(-pow((value - x) / 5.0, 2) / 2)) / (5.0 * sqrt(2 * pi())), 9) AS density FROM events, (SELECT unnest([0, 10, 25, 50, 75, 100]) AS x) GROUP BY x""")
def kernel_density(spark, d):
    return ml.density(table(spark, d, "events"), "value", [0, 10, 25, 50, 75, 100], 5.0).select("x", F.round("density", 9).alias("density"))


# --- cleaning and blocks -----------------------------------------------------------------


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if s.isprintable() else " || ".join(f"chr({ord(c)})" for c in s) or "''"


def _repaired_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), '�+', '', 'g')"
    for glyph, plain in (L.LIGATURES | L.PUNCTUATION).items():
        out = f"replace({out}, {_literal(glyph)}, {_literal(plain)})"
    return f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"


@query(f"WITH r AS (SELECT doc_id, {_repaired_sql(chr(39) + 'ﬁne “quoted” ‑ ' + chr(39) + ' || text')} AS x FROM documents) SELECT doc_id, md5(x) AS form, length(x) AS n FROM r")
def repaired_characters(spark, d):
    x = table(spark, d, "documents").select("doc_id", tx.repair_characters(F.concat(F.lit("ﬁne “quoted” ‑ "), "text")).alias("x"))
    return x.select("doc_id", F.md5("x").alias("form"), F.length("x").cast("long").alias("n"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace('a  b ,c' || chr(9) || chr(10) || chr(10) || chr(10) || text, '[ \t]{2,}', ' ', 'g'), ' +([,;:.)\]])', '\1', 'g') AS x FROM documents)
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(x, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS form FROM r""")
def tidied_blanks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.tidy_blanks(F.concat(F.lit("a  b ,c\t\n\n\n"), "text"))).alias("form"))


# pages of a document: here the documents of a source
_EDGES = r"""lines AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    edges AS (SELECT DISTINCT source, doc_id, unnest(list_concat(l[1:3], CASE WHEN len(l) > 3 THEN l[-3:] ELSE l END)) AS line FROM lines),
    forms AS (SELECT source, doc_id, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS exact,
        CASE WHEN regexp_matches(trim(line), '[0-9]') AND (regexp_matches(trim(line), '(?i)\b(page|p\.|pg)\b') OR len(regexp_split_to_array(trim(line), '\s+')) <= 6)
             THEN regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[0-9]+', '#', 'g') ELSE '' END AS masked FROM edges),
    keys AS (SELECT source, doc_id, line, exact AS key FROM forms WHERE length(exact) BETWEEN 4 AND 120 UNION SELECT source, doc_id, line, masked FROM forms WHERE length(masked) BETWEEN 4 AND 120),
    totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
    running AS (SELECT source, key FROM keys JOIN totals USING (source) GROUP BY source, key, pages HAVING pages >= 2 AND count(*) >= greatest(1, floor(pages * 0.02)))"""


def _pages(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")


@query(f"WITH {_EDGES} SELECT source AS document_id, key FROM running")
def running_keys(spark, d):
    return cleaning.running_keys(_pages(spark, d), 0.02, 2)


@query("""SELECT source AS document_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, count(*) FILTER (n_chars % 2 = 0) AS native, count(*) FILTER (n_chars % 2 = 1) AS ocr,
    CASE WHEN count(*) FILTER (n_chars % 2 = 0) > 0 AND count(*) FILTER (n_chars % 2 = 1) > 0 THEN 'mixed' WHEN count(*) FILTER (n_chars % 2 = 1) > 0 THEN 'ocr' ELSE 'native' END AS method FROM documents GROUP BY source""")
def extraction_stats(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("document_id"), "text", F.when(F.col("n_chars") % 2 == 0, "native").otherwise("ocr").alias("method"))
    return cleaning.extraction_stats(x)


@query(r"""SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) < 100 AS needed, length(text || text[1:30]) >= length(text) * 1.2 AS better FROM documents""")
def ocr_decisions(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", cleaning.needs_ocr(F.col("text")).alias("needed"), cleaning.ocr_improves(F.col("text"), F.concat("text", F.substring("text", 1, 30))).alias("better"))


_BLOCKS = r"""parts AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '\. ', '.' || chr(10) || chr(10), 'g'), '\n\s*\n'), lambda x: trim(x) <> '') AS p FROM documents),
    blocks AS (SELECT doc_id, unnest(p) AS text, unnest(range(0, len(p))) AS block_index FROM parts)"""


def _paragraphs(spark, d):
    """Documents with a paragraph a sentence."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text"))


@query(f"WITH {_BLOCKS} SELECT doc_id, 0 AS page_number, block_index::INTEGER AS block_index, md5(trim(text)) AS text FROM blocks")
def inline_blocks(spark, d):
    return cleaning.blocks(_paragraphs(spark, d), "doc_id").select("doc_id", "page_number", "block_index", F.md5("text").alias("text"))


@query(f"WITH {_BLOCKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1)::INTEGER AS block_index, md5(trim(text)) AS text FROM blocks WHERE block_index % 3 <> 1")
def renumbered_blocks(spark, d):
    x = cleaning.blocks(_paragraphs(spark, d), "doc_id")
    x = x.withColumn("text", F.when(F.col("block_index") % 3 == 1, " ").otherwise(F.col("text")))  # blank ones drop out
    return cleaning.renumbered(x, "doc_id").select("doc_id", "block_index", F.md5("text").alias("text"))


@query("""SELECT count(*) AS chunks, sum(n_chars)::BIGINT AS tokens, min(n_chars) AS least, max(n_chars) AS most, round_even(avg(n_chars), 1) AS mean, count(*) FILTER (n_chars % 3 = 0) AS mid_sentence,
    count(DISTINCT lang) AS sections, count(DISTINCT n_chars % 7) AS pages, count(*) FILTER (n_chars % 5 > n_chars % 7) AS spanning FROM documents""")
def chunk_rollup(spark, d):
    n = F.col("n_chars")
    return chunking.statistics(table(spark, d, "documents").select(n.alias("token_count"), (n % 3 == 0).alias("split_mid_sentence"), F.col("lang").alias("section"), (n % 7).alias("page_number"), (n % 5).alias("page_end")))


# --- metadata -------------------------------------------------------------------------------


def _metadata(spark, d):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("tenant_id"), F.col("source"), F.lit("filename"), F.lit("x.txt"), F.lit("size"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", readers.scalar_metadata(m).alias("meta"))


@query("SELECT doc_id, 'lang' AS key, lang AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'size', n_chars::VARCHAR FROM documents WHERE n_chars IS NOT NULL")
def scalar_metadata(spark, d):
    return _metadata(spark, d).select("doc_id", F.explode("meta").alias("key", "value"))


@query("SELECT doc_id, lang AS meta_lang, n_chars::VARCHAR AS meta_size, NULL::VARCHAR AS meta_author FROM documents")
def flat_metadata(spark, d):
    return readers.flat_columns(_metadata(spark, d), "meta", ["lang", "size", "author"]).drop("meta")


@query("SELECT DISTINCT word FROM (SELECT unnest(['the', 'of', 'and']) AS word UNION ALL SELECT unnest(['ka', 'ki', 'hai', 'the']))")
def word_union(spark, d):
    words = L.word_union(["the", "of", "and"], ["ka", "ki", "hai", "the"])
    return spark.createDataFrame([(w,) for w in words], "word string")


# --- hits and evidence ------------------------------------------------------------------------


def _hits(spark, d):
    """Documents as hits of one query per language."""
    x = table(spark, d, "documents").where("lang is not null")
    return x.select(
        F.col("lang").alias("query_id"), F.format_string("d%07d", "doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("doc_id") % 50).cast("int").alias("chunk_index"),
        (F.col("n_chars") % 5).cast("int").alias("page_number"), (F.col("n_chars") % 9973 / 9973.0).alias("final_score"), (F.col("n_chars") % 101 == 0).alias("pinned"),
        F.when(F.col("n_chars") % 11 == 0, " ").otherwise(F.col("text")).alias("text"), "n_chars", "doc_id",
    )


_HITS = """hits AS (SELECT lang AS query_id, printf('d%07d', doc_id) AS chunk_id, source AS document_id, (doc_id % 50)::INTEGER AS chunk_index, (n_chars % 5)::INTEGER AS page_number,
    (n_chars % 9973) / 9973.0 AS final_score, n_chars % 101 = 0 AS pinned, CASE WHEN n_chars % 11 = 0 THEN ' ' ELSE text END AS text, n_chars, doc_id FROM documents WHERE lang IS NOT NULL)"""


@query(f"WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS n FROM hits) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n)::INTEGER AS rank FROM r WHERE final_score >= 0.05")
def floored_hits(spark, d):
    ranked = r.ranked(_hits(spark, d), 1 << 30, score="final_score")
    return r.score_floor(ranked, 0.05).select("query_id", "chunk_id", "rank")


@query(f"WITH {_HITS} SELECT query_id, chunk_id, document_id, chunk_index, page_number, pinned, n_chars, doc_id, round(final_score, 6) AS final_score FROM hits")
def projected_hits(spark, d):
    return r.project(_hits(spark, d).withColumn("sources", F.array(F.lit("keyword"))), include_text=False)


@query(f"WITH {_HITS} SELECT query_id, chunk_id, round(CASE WHEN n_chars % 2 = 0 THEN final_score ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_chars % 2 = 0 THEN final_score ELSE 0 END DESC, chunk_id)::INTEGER AS rank, '' AS section FROM hits")
def bare_candidates(spark, d):
    hits = _hits(spark, d).withColumn("score", F.when(F.col("n_chars") % 2 == 0, F.col("final_score"))).drop("pinned", "page_number")
    return r.as_candidates(hits).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "section")


_SELECTED = f"""{_HITS}, tagged AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN final_score < 0.02 THEN 'below_floor' END AS reason FROM hits),
    counted AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pinned DESC, final_score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS usable FROM tagged),
    chosen AS (SELECT *, coalesce(reason, CASE WHEN usable > 40 THEN 'max_sources' END) AS verdict FROM counted)"""


@query(f"WITH {_SELECTED} SELECT query_id, chunk_id, coalesce(verdict, 'kept') AS verdict FROM chosen")
def evidence_selection(spark, d):
    kept, omitted = context.select_evidence(_hits(spark, d), 0.02, 40)
    return kept.select("query_id", "chunk_id", F.lit("kept").alias("verdict")).union(omitted.select("query_id", "chunk_id", "reason"))


def _fitted(spark, d):
    kept, _ = context.select_evidence(_hits(spark, d), 0.02, 40)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id"))
    return kept.withColumn("number", nth)


_FITTED = f"""{_SELECTED}, fitted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS nth FROM chosen WHERE verdict IS NULL),
    placed AS (SELECT *, max(final_score) OVER (PARTITION BY query_id, document_id) AS best, min(nth) OVER (PARTITION BY query_id, document_id) AS first FROM fitted),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, document_id, page_number, chunk_index, chunk_id)::INTEGER AS number FROM placed),
    sources AS (SELECT *, CASE WHEN lag(document_id) OVER w = document_id AND lag(chunk_index) OVER w + 1 = chunk_index THEN number - 1 ELSE 0 END AS continues FROM ordered WINDOW w AS (PARTITION BY query_id ORDER BY number))"""


@query(f"WITH {_FITTED} SELECT query_id, chunk_id, number, continues::INTEGER AS continues FROM sources")
def document_order(spark, d):
    return context.order_sources(_fitted(spark, d)).select("query_id", "chunk_id", "number", F.coalesce("continues", F.lit(0)).alias("continues"))


@query(f"WITH {_FITTED} SELECT query_id, chunk_id, nth::INTEGER AS number FROM fitted")
def relevance_order(spark, d):
    return context.order_sources(_fitted(spark, d), "relevance").select("query_id", "chunk_id", "number")


def _sources(spark, d):
    x = context.order_sources(_fitted(spark, d)).withColumn("filename", F.concat("document_id", F.lit(".txt"))).withColumn("section", F.lit("Terms"))
    n = F.col("n_chars").cast("int")
    return x.withColumns({"page_end": F.col("page_number") + (n % 2), "ocr": n % 3 == 0, "split_mid_sentence": n % 4 == 0, "also": F.array().cast("array<string>"), "original_tokens": n, "text_tokens": n - n % 2 * 7, "truncated": n % 2 == 1, "total_tokens": n})


_BLOCK = """'Source ' || number || ':' || chr(10) || 'Document: ' || document_id || '.txt (id: ' || document_id || ')' || chr(10) || 'Page: ' || CASE WHEN page_number < 1 THEN 'unknown' WHEN n_chars % 2 = 0 THEN page_number::VARCHAR ELSE page_number || '-' || (page_number + 1) END
    || chr(10) || 'Section: Terms' || chr(10) || 'Chunk: ' || chunk_index || ' (id: ' || substr(chunk_id, 1, 12) || ')' || CASE WHEN continues > 0 THEN chr(10) || 'Continues: Source ' || continues ELSE '' END
    || CASE WHEN n_chars % 2 = 1 OR n_chars % 3 = 0 OR n_chars % 4 = 0 THEN chr(10) || 'Note: ' || concat_ws(' ', CASE WHEN n_chars % 2 = 1 THEN 'This passage was shortened to fit the context budget; 7 tokens were removed from the end, so it may not contain the whole clause.' END,
        CASE WHEN n_chars % 3 = 0 THEN 'Text recovered by OCR from a scanned page; wording may contain recognition errors.' END, CASE WHEN n_chars % 4 = 0 THEN 'This passage begins or ends mid-sentence.' END) ELSE '' END
    || chr(10) || 'Text:' || chr(10) || text || CASE WHEN n_chars % 2 = 1 THEN chr(10) || '[… passage shortened; 7 tokens omitted …]' ELSE '' END"""


@query(f"WITH {_FITTED} SELECT query_id, md5(string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY number)) AS evidence FROM sources GROUP BY query_id")
def rendered_evidence(spark, d):
    return context.render(_sources(spark, d)).select("query_id", F.md5("evidence").alias("evidence"))


@query(f"WITH {_FITTED} SELECT query_id, number, md5(text) AS text FROM sources")
def parsed_evidence(spark, d):
    return answers.source_blocks(context.render(_sources(spark, d))).select("query_id", "number", F.md5("text").alias("text"))


@query(f"""WITH {_FITTED}, s AS (SELECT query_id, count(*) AS sources, sum(n_chars)::BIGINT AS tokens, count(DISTINCT document_id) AS documents, count(*) FILTER (n_chars % 2 = 1) AS truncated FROM sources GROUP BY query_id),
    o AS (SELECT query_id, count(*) FILTER (verdict = 'empty') AS empty, count(*) FILTER (verdict = 'below_floor') AS below_floor, count(*) FILTER (verdict = 'max_sources') AS max_sources, 0::BIGINT AS budget_exhausted, 0::BIGINT AS too_small_to_truncate FROM chosen WHERE verdict IS NOT NULL GROUP BY query_id)
    SELECT query_id, coalesce(sources, 0) AS sources, coalesce(tokens, 0) AS tokens, coalesce(documents, 0) AS documents, coalesce(truncated, 0) AS truncated, coalesce(empty, 0) AS empty, coalesce(below_floor, 0) AS below_floor,
    coalesce(max_sources, 0) AS max_sources, coalesce(budget_exhausted, 0) AS budget_exhausted, coalesce(too_small_to_truncate, 0) AS too_small_to_truncate FROM s FULL JOIN o USING (query_id)""")
def context_rollup(spark, d):
    _, omitted = context.select_evidence(_hits(spark, d), 0.02, 40)
    return context.statistics(_sources(spark, d), omitted)


@query(f"""WITH {_FITTED}, s AS (SELECT query_id, count(*) AS n, count(*) FILTER (n_chars % 2 = 1) AS cut, max(CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END) AS ocr FROM sources GROUP BY query_id), o AS (SELECT query_id, count(*) AS out FROM chosen WHERE verdict = 'max_sources' GROUP BY query_id)
    SELECT query_id, CASE WHEN n IS NULL THEN 'no_sources' ELSE concat_ws(' ', CASE WHEN n < 30 THEN 'few_sources' END, CASE WHEN cut > 0 THEN 'shortened:' || (cut * 7) END, CASE WHEN out > 0 THEN 'left_out:' || out END, CASE WHEN ocr = 1 THEN 'ocr' END) END AS warnings
    FROM (SELECT DISTINCT query_id FROM chosen) LEFT JOIN s USING (query_id) LEFT JOIN o USING (query_id)""")
def context_warnings(spark, d):
    """The source limit plays the budget here."""
    _, omitted = context.select_evidence(_hits(spark, d), 0.02, 40)
    omitted = omitted.withColumn("reason", F.when(F.col("reason") == "max_sources", "budget_exhausted").otherwise(F.col("reason")))
    return context.warnings(_sources(spark, d), omitted, 30).select("query_id", F.array_join("warnings", " ").alias("warnings"))


@query(f"""WITH {_FITTED}, a AS (SELECT s.query_id, s.chunk_id, list_sort(list(DISTINCT h.document_id || CASE WHEN h.page_number = 0 THEN '' ELSE ' p. ' || h.page_number END)) AS also FROM sources s JOIN hits h ON h.query_id = s.query_id AND h.doc_id % 50 = s.doc_id % 50 AND h.doc_id <> s.doc_id GROUP BY ALL)
    SELECT s.query_id, s.number, s.chunk_id, s.document_id, coalesce(nullif(s.page_number, 0), -1) AS page_number, coalesce(array_to_string(a.also, '; '), '') AS also FROM sources s LEFT JOIN a USING (query_id, chunk_id)""")
def citation_list(spark, d):
    s = _sources(spark, d).drop("also")
    others = _hits(spark, d).select("query_id", F.col("chunk_index").alias("chunk_index"), F.col("chunk_id").alias("other"), "document_id", "page_number")
    repeats = s.select("query_id", "chunk_id", "chunk_index").join(others, ["query_id", "chunk_index"]).where("other <> chunk_id").select("query_id", "chunk_id", "document_id", "page_number")
    listed = context.citations(context.also_appears_in(s, repeats))
    return listed.select("query_id", "number", "chunk_id", "document_id", F.coalesce("page_number", F.lit(-1)).alias("page_number"), F.array_join(F.array_sort("also"), "; ").alias("also"))


# --- boosts: all five kinds ---------------------------------------------------------------------

_NUMBER = r"(^|[^a-zA-Z0-9_.])4($|[^a-zA-Z0-9_.]|[.]($|[^0-9]))"


@query(rf"""WITH {_HITS}, s AS (SELECT *, CASE WHEN n_chars % 6 = 0 THEN 'Clause 4 terms' WHEN n_chars % 6 = 1 THEN 'term' ELSE '' END AS section,
        CASE WHEN n_chars % 4 = 0 THEN 'see 4 and "the end" of it ' ELSE '' END || lower(text) AS body FROM hits),
    b AS (SELECT *, CASE WHEN n_chars % 6 = 0 THEN 0.25 WHEN regexp_matches(body, '{_NUMBER}') THEN 0.125 ELSE 0 END AS reference, 0.15 * ((contains(body, 'the end'))::INTEGER + (contains(body, ' de '))::INTEGER) AS phrase,
        CASE WHEN n_chars % 5 = 0 THEN 0.05 ELSE 0 END AS agree, CASE WHEN n_chars % 6 <= 1 THEN 0.05 ELSE 0 END AS heading, CASE WHEN n_chars % 9 = 0 THEN -0.3 ELSE 0 END AS bare FROM s)
    SELECT query_id, chunk_id, n_chars % 6 = 0 AS pinned, round(greatest(0, final_score + reference + phrase + agree + heading + bare), 6) AS rank_score,
    (reference <> 0)::INTEGER + (phrase <> 0)::INTEGER + (agree <> 0)::INTEGER + (heading <> 0)::INTEGER + (bare <> 0)::INTEGER AS kinds,
    row_number() OVER (PARTITION BY query_id ORDER BY n_chars % 6 = 0 DESC, round(greatest(0, final_score + reference + phrase + agree + heading + bare), 9) DESC, chunk_id)::INTEGER AS rank FROM b""")
def boost_kinds(spark, d):
    n = F.col("n_chars")
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    c = _hits(spark, d).withColumns({
        "section": F.when(n % 6 == 0, "Clause 4 terms").when(n % 6 == 1, "term").otherwise(""), "text": F.concat(F.when(n % 4 == 0, 'see 4 and "the end" of it ').otherwise(""), F.lower("text")),
        "fused_score": F.col("final_score"), "numbers": words("4"), "phrases": words("the end", " de "), "terms": words("term"),
        "sources": F.when(n % 5 == 0, words("keyword", "semantic")).otherwise(words("keyword")), "heading_only": n % 9 == 0,
    })
    return r.boost(c.drop("pinned")).select("query_id", "chunk_id", "pinned", F.round("rank_score", 6).alias("rank_score"), F.size("boosts").alias("kinds"), "rank")


# --- answers ---------------------------------------------------------------------------------


@query("SELECT conv_id, turn, 'Question:' || chr(10) || role || chr(10) || chr(10) || 'Evidence:' || chr(10) || text AS prompt FROM conversations")
def prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answers.prompt(F.col("role"), F.col("text")).alias("prompt"))


@query("""SELECT conv_id || ':' || turn AS query_id, CASE WHEN turn % 7 = 6 THEN 'insufficient_evidence' WHEN turn % 5 = 1 THEN 'llm_unavailable' WHEN turn % 5 = 2 THEN 'llm_configuration_error' WHEN turn % 3 = 1 THEN 'malformed_response'
    WHEN turn % 2 = 1 THEN 'insufficient_evidence' ELSE 'ok' END AS status FROM conversations""")
def answer_statuses(spark, d):
    n = F.col("turn")
    x = table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.when(n % 7 == 6, 0).otherwise(3).alias("sources"), F.when(n % 5 == 1, "unavailable").when(n % 5 == 2, "configuration").alias("failure"),
        F.when(n % 3 == 1, "no JSON object").alias("error"), F.col("text").alias("answer"), (n % 2 == 1).alias("insufficient"),
    )
    return answers.answer_status(x).select("query_id", "status")


@query("""SELECT conv_id || ':' || turn AS query_id, CASE WHEN turn % 4 = 3 THEN 'insufficient_evidence' WHEN turn % 4 = 2 THEN 'malformed_response' ELSE 'ok' END AS status,
    CASE WHEN turn % 4 = 2 THEN '' WHEN turn % 4 = 3 THEN 'The retrieved passages do not contain anything that answers this question. No answer can be given from the available evidence.' ELSE 'said ' || length(text) END AS answer FROM conversations""")
def answered_questions(spark, d):
    x = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), "turn")
    said = lambda p: F.to_json(F.struct(F.concat(F.lit("said "), F.regexp_extract(p, r"#(\d+)#", 1)).alias("answer")))
    model = lambda p: F.when(F.contains(p, F.lit("never")), "no").when(F.contains(p, F.lit("later")) & ~F.contains(p, F.lit("JSON object only")), "no").otherwise(said(p))
    kind = F.element_at(F.array(F.lit("at once"), F.lit("later"), F.lit("never"), F.lit("none")), (F.col("turn") % 4 + 1).cast("int"))
    evidence = x.select("query_id", F.concat(F.lit("#"), F.length("question").cast("string"), F.lit("# "), kind).alias("evidence"), F.when(F.col("turn") % 4 == 3, 0).otherwise(1).alias("sources"))
    out = answers.answer_all(x.withColumn("question", F.lit("How long is it?")), evidence, model)
    return out.select("query_id", "status", F.coalesce("answer", F.lit("")).alias("answer"))


@query("SELECT conv_id, turn, trim(text) AS answer, turn > 0 AS cites, turn::INTEGER AS cited, true AS recovered FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND turn > 0")
def recovered_replies(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant' and trim(text) <> '' and turn > 0")
    reply = F.concat(F.lit("Here: ```json\n"), F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.struct(F.concat(F.lit("Source "), F.col("turn").cast("string")).alias("source"))).alias("citations"))), F.lit("\n```"))
    p = answers.parse_replies(c.select("conv_id", "turn", reply.alias("reply"))).select("conv_id", "turn", "parsed.*")
    return p.select("conv_id", "turn", "answer", (F.size("cited") > 0).alias("cites"), F.get("cited", F.lit(0)).alias("cited"), "recovered")


# --- catalogues ----------------------------------------------------------------------------


@query("""WITH j AS (SELECT user_id AS job_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE max(ts) END AS finished_at FROM events GROUP BY user_id), n AS (SELECT greatest(0, count(*) - 60) AS excess FROM j),
    f AS (SELECT *, row_number() OVER (ORDER BY finished_at, job_id) AS nth FROM j WHERE finished_at IS NOT NULL) SELECT job_id, finished_at FROM f, n WHERE nth <= excess""")
def evicted_jobs(spark, d):
    jobs = table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("last"))
    return ingest.evicted_jobs(jobs.select("job_id", F.when(F.col("job_id") % 4 != 0, F.col("last")).alias("finished_at")), 60)


@query("""WITH e AS (SELECT source AS name, max(doc_id) AS used_at, count(*) AS size FROM documents GROUP BY source), k AS (SELECT *, sum(size) OVER w AS kept, row_number() OVER w AS nth FROM e WINDOW w AS (ORDER BY used_at DESC, name DESC))
    SELECT name, used_at, size FROM k WHERE kept > 300 AND nth > 1""")
def evicted_entries(spark, d):
    x = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.max("doc_id").alias("used_at"), F.count("*").alias("size"))
    return ingest.evicted_entries(x, 300)


# --- stores and files ------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = scratch(spark)
    readers.write_csv(table(spark, d, "customer"), path)
    return readers.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def session_round_trip(spark, d):
    path, c = scratch(spark), table(spark, d, "conversations")
    readers.save_sessions(c.withColumn("conv_id", F.col("conv_id").cast("string")), path)
    return readers.load_session(spark, path, str(c.agg(F.min("conv_id")).first()[0])).select("turn", "role", "text")


@query("""WITH t AS (SELECT min(source) AS tenant FROM documents), x AS (SELECT * FROM documents, t WHERE source = tenant),
    one AS (SELECT min(doc_id) AS gone FROM x) SELECT printf('d%07d', doc_id) AS chunk_id, doc_id::VARCHAR AS document_id, CASE WHEN n_chars % 2 = 0 THEN 'second' ELSE 'first' END AS text,
    (SELECT count(*) FROM x, one WHERE doc_id <> gone) AS chunks, 3::BIGINT AS version, 1 AS deleted FROM x, one WHERE doc_id <> gone""")
def store_round_trip(spark, d):
    """Two upserts of one tenant (the second of every other chunk), then a deleted document: what is left."""
    docs = table(spark, d, "documents")
    tenant, gone = docs.agg(F.min_by("source", F.struct("source", "doc_id")), F.min_by("doc_id", F.struct("source", "doc_id"))).first()
    rows = docs.where(F.col("source") == tenant).select(F.col("source").alias("tenant_id"), F.format_string("d%07d", "doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("first").alias("text"), "n_chars")
    store = ChunkStore(spark, scratch(spark))
    store.upsert(tenant, rows.drop("n_chars"))
    store.upsert(tenant, rows.where("n_chars % 2 = 0").withColumn("text", F.lit("second")).drop("n_chars"))
    deleted = store.delete_document(tenant, str(gone))
    left = store.fetch(tenant).join(F.broadcast(store.statistics(tenant).select("tenant_id", "chunks")), "tenant_id")
    return left.select("chunk_id", "document_id", "text", "chunks", F.lit(store.version(tenant)).cast("long").alias("version"), F.lit(deleted).alias("deleted"))


# --- models ------------------------------------------------------------------------------------

_FIT = """m AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice / 1e4 AS y FROM lineitem),
    c AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM m),
    w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS wx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS wz FROM c)"""


@query(f"WITH {_FIT}, p AS (SELECT y, my + wx * (x - mx) + wz * (z - mz) AS p FROM m, w) SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM p")
def linear_regression(spark, d):
    x = table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1e4).alias("y"))
    out = t.regression_metrics(ml.fit_regressor(x, "y", ["l_quantity", "l_discount"]).transform(x), "y", "prediction")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query(f"WITH {_FIT} SELECT 'l_quantity' AS name, round(wx, 6) AS weight, 1 AS rank FROM w WHERE wx >= wz UNION ALL SELECT 'l_discount', round(wz, 6), 2 FROM w WHERE wx >= wz UNION ALL SELECT 'l_quantity', round(wx, 6), 2 FROM w WHERE wx < wz UNION ALL SELECT 'l_discount', round(wz, 6), 1 FROM w WHERE wx < wz")
def model_weights(spark, d):
    """The weights of a linear model that was saved and loaded again, greatest first."""
    x = table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1e4).alias("y"))
    path = scratch(spark)
    ml.save(ml.fit_regressor(x, "y", ["l_quantity", "l_discount"]), path)
    return ml.top_weights(ml.coefficients(ml.load(path), ["l_quantity", "l_discount"])).select("name", F.round("weight", 6).alias("weight"), "rank")


@query("""WITH c AS (SELECT label AS class, 'f' || i AS name, avg(embedding[i + 1]::DOUBLE) AS weight FROM embeddings, (SELECT unnest(range(0, 16)) AS i) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY weight DESC, name) AS rank FROM c) SELECT class, name, round(weight, 6) AS weight, rank::INTEGER AS rank FROM k WHERE rank <= 10""")
def top_weights(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("class"), F.posexplode(F.slice("embedding", 1, 16)).alias("i", "v"))
    w = x.groupBy("class", F.concat(F.lit("f"), F.col("i").cast("string")).alias("name")).agg(F.avg(F.col("v").cast("double")).alias("weight"))
    return ml.top_weights(w).select("class", "name", F.round("weight", 6).alias("weight"), "rank")


@query("""WITH v AS (SELECT 'l_quantity' AS name, round(var_pop(l_quantity), 4) AS importance FROM lineitem UNION ALL SELECT 'l_discount', round(var_pop(l_discount), 4) FROM lineitem UNION ALL SELECT 'l_tax', round(var_pop(l_tax), 4) FROM lineitem)
    SELECT name, importance, row_number() OVER (ORDER BY importance, name)::INTEGER AS place FROM v""")
def feature_importances(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    x = table(spark, d, "lineitem").agg(F.array(*[F.round(F.var_pop(c), 4) for c in names]).alias("v"))
    rows = x.select(F.posexplode(ml.importances(F.array(*[F.lit(c) for c in names]), F.col("v"))).alias("at", "r"))
    return rows.select("r.name", "r.importance", (F.col("at") + 1).alias("place"))


@query("""WITH RECURSIVE e AS (SELECT avg(x * x) AS xx, avg(x) AS mx, avg(x * y) AS xy, avg(y) AS my FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 1e5 AS y FROM lineitem)),
    g(n, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT n + 1, w - 0.5 * (w * xx + b * mx - xy), b - 0.5 * (w * mx + b - my) FROM g, e WHERE n < 50)
    SELECT l_orderkey, l_linenumber, round(l_quantity / 50 * w + b, 6) AS predicted FROM lineitem, g WHERE n = 50""")
def gradient_descent(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"))
    w, b = ml.descend(x, "y", ["x"], rate=0.5)
    return x.select("l_orderkey", "l_linenumber", F.round(F.col("x") * w[0] + b, 6).alias("predicted"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id || '|' || quality), 1, 8))::BIGINT % 5 AS fold FROM labels")
def cross_validation_folds(spark, d):
    return ml.stratified_folds(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", F.col("fold").cast("long").alias("fold"))


@query()
def cross_validation(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") / 1000.0).alias("size"))
    return ml.cross_validate(x, "doc_id", "label", ["size"], maxIter=10)


@query("SELECT doc_id, round(-(quality * log2(p) + (1 - quality) * log2(1 - p)), 9) AS loss FROM (SELECT doc_id, quality, greatest(1e-15, least(1 - 1e-15, n_chars / (n_chars + 500.0))) AS p FROM labels JOIN documents USING (doc_id))")
def log2_loss(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", F.round(ml.log2_loss(F.col("quality"), F.col("n_chars") / (F.col("n_chars") + 500.0)), 9).alias("loss"))


@query("SELECT vec_id, list_transform(embedding[1:4], lambda x: round((floor(abs(x::DOUBLE) * 100) / 255.0 - 0.5) / 0.25, 6)) AS pixels FROM embeddings")
def standard_pixels(spark, d):
    raw = F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(ml.standard_pixels(raw, 0.5, 0.25), lambda x: F.round(x, 6)).alias("pixels"))


# --- counters, sentences, conversations -------------------------------------------------------


@query("SELECT doc_id, greatest(1, floor(n_chars * 0.75))::INTEGER AS words FROM documents")
def word_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", counters.words_for_tokens(F.col("n_chars")).alias("words"))


@query()
def exact_token_count(spark, d):
    import public_tokenizers

    count = counters.counter(spark, "exact", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(spark, d, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


_ENGLISH, _HINDI = ["the", "and", "of", "to", "in", "is", "a"], ["hai", "ka", "ki", "nahi", "aur"]
_SQL_LIST = {lang: ", ".join(f"'{w}'" for w in words) for lang, words in (("EN", _ENGLISH), ("HI", _HINDI))}


@query(rf"""WITH p AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label, list_filter(regexp_split_to_array(trim('hai ' || text), '\s+'), lambda w: w <> '') AS w FROM conversations),
    t AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g')) AS bare FROM p)
    SELECT conv_id, turn, label, 0.6 AS confidence, round(len(list_filter(bare, lambda x: x IN ({_SQL_LIST["HI"]}))) / len(w), 3) AS hi, round(len(list_filter(bare, lambda x: x IN ({_SQL_LIST["EN"]}))) / len(w), 3) AS en FROM t""")
def sentence_predictions(spark, d):
    """The report of a sentence, from class probabilities as a model gives them (here set by the turn)."""
    one = lambda i: F.when(F.col("turn") % 3 == i, 0.6).otherwise(0.2)
    report = answers.sentence_report(F.concat(F.lit("hai "), "text"), F.array(one(0), one(1), one(2)), ["negative", "neutral", "positive"], _HINDI, _ENGLISH)
    return table(spark, d, "conversations").select("conv_id", "turn", report.alias("r")).select("conv_id", "turn", "r.label", "r.confidence", "r.mix.hi", "r.mix.en")


@query("""WITH n AS (SELECT conv_id, max(turn) + 1 AS turn FROM conversations GROUP BY conv_id), h AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, 'user', 'Go on.' FROM n),
    s AS (SELECT *, sum(greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM h),
    p AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM s WHERE used <= 120 OR back <= 2 GROUP BY conv_id),
    r AS (SELECT conv_id, md5(prompt) AS reply FROM p WHERE length(prompt) % 4 <> 0)
    SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, 'user', 'Go on.' FROM n JOIN r USING (conv_id) UNION ALL SELECT conv_id, turn + 1, 'assistant', reply FROM n JOIN r USING (conv_id)""")
def chat_turns(spark, d):
    """One more turn of every conversation; the provider fails on a quarter of the prompts."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = c.select("conv_id").distinct().withColumn("text", F.lit("Go on."))
    return answers.chat_turn(c, said, lambda p: F.when(F.length(p) % 4 != 0, F.md5(p)), 120)

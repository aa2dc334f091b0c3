"""Queries of retrieval, context and answers: documents are chunks, sources are tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.operators import ann, answers, chunking, context
from lodeweave.operators import retrieval as r
from lodeweave.operators.tabular import scope
from lodeweave.plans.registry import SQL, query, scratch, spread, table
from lodeweave.plans.text import WORDS_SQL
from lodeweave.sources import store

TERMS = ["thnt", "ation", "que", "de", "der", "die", "und", "ing", "tion"]


def chunks(spark, d):
    x = spread(table(spark, d, "documents").select("source", "doc_id", "text", "lang"))
    return x.select(F.col("source").alias("tenant_id"), F.format_string("d%07d", "doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.substring_index("text", "\n", 1).alias("section"), "text", "lang")


def _every_tenant(spark, d):
    """One fixed question put to every tenant."""
    t = table(spark, d, "documents").select(F.col("source").alias("tenant_id")).distinct()
    words = F.array(*[F.lit(x) for x in TERMS])
    empty = F.array().cast("array<string>")
    return t.select(F.col("tenant_id").alias("query_id"), "tenant_id", words.alias("terms"), empty.alias("phrases"), empty.alias("numbers"))


_BM25 = f"""WITH {WORDS_SQL}, n AS (SELECT d.source, count(*) AS docs, avg(coalesce(len, 0)) AS mean FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS len FROM words GROUP BY doc_id) l USING (doc_id) GROUP BY d.source),
    l AS (SELECT doc_id, count(*) AS len FROM words GROUP BY doc_id), tf AS (SELECT source, doc_id, term, count(*) AS tf FROM words WHERE term IN ({", ".join(f"'{t}'" for t in TERMS)}) GROUP BY ALL),
    df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT source, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (source, term) JOIN n USING (source) JOIN l USING (doc_id) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""


def _keyword(spark, d, k=18):
    c, asked = chunks(spark, d), _every_tenant(spark, d)
    return r.keyword_search(r.postings(c, asked=asked), r.corpus_stats(c), asked, k)


@query(_BM25 + " SELECT source AS tenant_id, printf('d%07d', doc_id) AS chunk_id, round(score, 6) AS raw_score, round(score / max(score) OVER (PARTITION BY source), 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 18")
def bm25_topk(spark, d):
    return _keyword(spark, d).select("tenant_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"), "rank")


@query(SQL["bm25_topk"])
def stored_index_topk(spark, d):
    """The same answers from an index that is written once and read by term."""
    path, asked = scratch(spark), _every_tenant(spark, d)
    store.write_index(chunks(spark, d), path)
    out = store.search_index(store.read_index(spark, path), asked, 18)
    return out.select("tenant_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {WORDS_SQL} SELECT source AS tenant_id, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM words GROUP BY ALL")
def document_frequency(spark, d):
    return r.postings(chunks(spark, d)).groupBy("tenant_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query()
def ann_topk(spark, d):
    """The ten likeliest nearest vectors of every hundredth vector, from an index of all."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    centres = ann.fit_centres(e, key="vec_id")
    return ann.search(ann.build(e, centres), centres, asked, 10, probes=max(8, len(centres) // 2), key="vec_id", by=None, own=False)


_VECTOR = """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {1}),
    s AS (SELECT vec_id, {0} AS score FROM v, q) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10"""


def _vector(spark, d, metric, where=None):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    return r.vector_top_k(e, asked, 10, metric, "vec_id", "embedding", where).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(_VECTOR.format("greatest(0, least(1, list_cosine_similarity(v, q)))", "true"))
def cosine_topk(spark, d):
    return _vector(spark, d, "cosine")


@query(_VECTOR.format("list_inner_product(v, q)", "true"))
def ip_topk(spark, d):
    return _vector(spark, d, "ip")


@query(_VECTOR.format("1 / (1 + list_distance(v, q))", "true"))
def l2_topk(spark, d):
    return _vector(spark, d, "l2")


@query(_VECTOR.format("greatest(0, least(1, list_cosine_similarity(v, q)))", "label = 3 AND vec_id BETWEEN 50 AND 400"))
def filtered_topk(spark, d):
    return _vector(spark, d, "cosine", scope("3", tenant_column="label", page_range=(400, 50), page_column="vec_id"))


# the semantic side: documents that have an embedding, against one query vector per tenant
_TWO = """, qv AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
    vs AS (SELECT d.source, d.doc_id, greatest(0, least(1, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), q))) AS score FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, qv),
    sem AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM vs),
    key AS (SELECT source, doc_id, score / max(score) OVER (PARTITION BY source) AS score, rank FROM k WHERE rank <= 18),
    m AS (SELECT coalesce(s.source, k.source) AS source, coalesce(s.doc_id, k.doc_id) AS doc_id, s.score AS ss, s.rank AS sr, k.score AS ks, k.rank AS kr
          FROM (SELECT * FROM sem WHERE rank <= 18) s FULL JOIN key k ON s.source = k.source AND s.doc_id = k.doc_id)"""


def _vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), "doc_id", F.format_string("d%07d", "doc_id").alias("chunk_id"))
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").drop("doc_id")


def _vector_queries(spark, d):
    """One vector, put to every tenant."""
    one = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    tenants = table(spark, d, "documents").select(F.col("source").alias("tenant_id")).distinct()
    return tenants.crossJoin(F.broadcast(one)).withColumn("query_id", F.col("tenant_id"))  # one row


def _semantic_table(spark, d, k=18):
    return r.batch_vector_top_k(_vectors(spark, d), _vector_queries(spark, d), k).select("query_id", "chunk_id", "score", "rank")


@query(_BM25 + _TWO + " SELECT source AS query_id, source AS tenant_id, printf('d%07d', doc_id) AS chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM sem WHERE rank <= 10 AND score >= 0.1")
def simple_search(spark, d):
    out = r.simple_search(_vectors(spark, d), _vector_queries(spark, d), 10, 0.1)
    return out.select("query_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_BM25 + _TWO + """ SELECT source AS query_id, printf('d%07d', doc_id) AS chunk_id, (CASE WHEN kr IS NULL THEN '' ELSE 'keyword ' END) || (CASE WHEN sr IS NULL THEN '' ELSE 'semantic ' END) AS sources,
    round(coalesce(ss, 0), 6) AS semantic_score, coalesce(sr, 0)::INTEGER AS semantic_rank, round(coalesce(ks, 0), 6) AS keyword_score, coalesce(kr, 0)::INTEGER AS keyword_rank FROM m""")
def merged_lists(spark, d):
    m = r.merge(_semantic_table(spark, d), _keyword(spark, d))
    names = F.array_join(F.transform("sources", lambda x: F.concat(x, F.lit(" "))), "")
    num = lambda c: F.coalesce(c, F.lit(0))
    return m.select("query_id", "chunk_id", names.alias("sources"), *[F.round(F.coalesce(f"{c}_score", F.lit(0.0)), 6).alias(f"{c}_score") for c in ("semantic", "keyword")], *[num(f"{c}_rank").alias(f"{c}_rank") for c in ("semantic", "keyword")])


@query(_BM25 + _TWO + """, f AS (SELECT *, coalesce(0.6 / (60 + sr), 0) + coalesce(0.4 / (60 + kr), 0) AS v FROM m)
    SELECT source AS query_id, printf('d%07d', doc_id) AS chunk_id, round(v / max(v) OVER (PARTITION BY source), 6) AS fused_score FROM f""")
def rrf(spark, d):
    return r.fuse(_semantic_table(spark, d), _keyword(spark, d), "rrf").select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"))


@query(_BM25 + _TWO + " SELECT source AS query_id, printf('d%07d', doc_id) AS chunk_id, round(0.6 * coalesce(ss, 0) + 0.4 * coalesce(ks, 0), 6) AS fused_score FROM m")
def weighted_fusion(spark, d):
    return r.fuse(_semantic_table(spark, d), _keyword(spark, d), "weighted").select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"))


@query(_BM25 + _TWO + """, f AS (SELECT *, coalesce(0.6 / (60 + sr), 0) + coalesce(0.4 / (60 + kr), 0) AS v FROM m)
    SELECT source AS query_id, printf('d%07d', doc_id) AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY v DESC, doc_id)::INTEGER AS rank FROM f""")
def fused_order(spark, d):
    return r.ranked(r.fuse(_semantic_table(spark, d), _keyword(spark, d)), 36, score="fused_score").select("query_id", "chunk_id", "rank")


@query(_BM25 + _TWO + " SELECT source AS query_id, round(avg(CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS agreement FROM m GROUP BY source")
def agreement(spark, d):
    return r.agreement(r.merge(_semantic_table(spark, d), _keyword(spark, d)))


def _wide(spark, d):
    fused = r.fuse(_semantic_table(spark, d), _keyword(spark, d))
    return fused.join(_every_tenant(spark, d).drop("tenant_id"), "query_id").join(chunks(spark, d).drop("tenant_id"), "chunk_id")


_WORD_LIST = ", ".join(f"'{t}'" for t in TERMS)


@query(_BM25 + _TWO + f""", f AS (SELECT *, coalesce(0.6 / (60 + sr), 0) + coalesce(0.4 / (60 + kr), 0) AS v FROM m),
    h AS (SELECT DISTINCT d.doc_id FROM documents d JOIN words w USING (doc_id) WHERE w.term IN ({_WORD_LIST}) AND w.pos <= len(regexp_extract_all(lower(string_split(d.text, chr(10))[1]), '[a-z0-9]+(?:[.\\-/][a-z0-9]+)*'))),
    b AS (SELECT source, doc_id, v / max(v) OVER (PARTITION BY source) + CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN h.doc_id IS NOT NULL THEN 0.05 ELSE 0 END AS s FROM f LEFT JOIN h USING (doc_id))
    SELECT source AS query_id, printf('d%07d', doc_id) AS chunk_id, round(s, 6) AS rank_score FROM b""")
def boosts(spark, d):
    return r.boost(_wide(spark, d)).select("query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"))


_RELEVANCE = f"""WITH {WORDS_SQL}, p AS (SELECT doc_id, term, min(seq) AS first FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM words) WHERE term IN ({_WORD_LIST}) GROUP BY ALL),
    g AS (SELECT doc_id, count(*) AS found, max(first) - min(first) AS gap FROM p GROUP BY doc_id),
    e AS (SELECT d.doc_id, round(0.65 * coalesce(found, 0) / {len(TERMS)} + 0.2 * CASE WHEN found IS NULL THEN 0 WHEN found = 1 OR gap <= 0 THEN 1 ELSE least(1, 60.0 / gap) END, 6) AS score FROM documents d LEFT JOIN g USING (doc_id))"""


@query(_RELEVANCE + " SELECT doc_id, score FROM e")
def lexical_rerank(spark, d):
    terms = F.array(*[F.lit(t) for t in TERMS])
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", r.lexical_relevance(F.col("text"), terms, F.array().cast("array<string>")).alias("score"))


_BLENDED = _BM25 + _TWO + f""", f AS (SELECT *, coalesce(0.6 / (60 + sr), 0) + coalesce(0.4 / (60 + kr), 0) AS v FROM m),
    h AS (SELECT DISTINCT d.doc_id FROM documents d JOIN words w USING (doc_id) WHERE w.term IN ({_WORD_LIST}) AND w.pos <= len(regexp_extract_all(lower(string_split(d.text, chr(10))[1]), '[a-z0-9]+(?:[.\\-/][a-z0-9]+)*'))),
    b AS (SELECT source, doc_id, v / max(v) OVER (PARTITION BY source) + CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN h.doc_id IS NOT NULL THEN 0.05 ELSE 0 END AS s FROM f LEFT JOIN h USING (doc_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS rank FROM b),
    p AS (SELECT doc_id, term, min(seq) AS first FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM words) WHERE term IN ({_WORD_LIST}) GROUP BY ALL),
    g AS (SELECT doc_id, count(*) AS found, max(first) - min(first) AS gap FROM p GROUP BY doc_id),
    e AS (SELECT o.source, o.doc_id, o.s, round(0.65 * coalesce(found, 0) / {len(TERMS)} + 0.2 * CASE WHEN found IS NULL THEN 0 WHEN found = 1 OR gap <= 0 THEN 1 ELSE least(1, 60.0 / gap) END, 6) AS r FROM o LEFT JOIN g USING (doc_id) WHERE o.rank <= 18),
    z AS (SELECT source, doc_id, 0.85 * coalesce(r / nullif(max(r) OVER (PARTITION BY source), 0), 0) + (1 - 0.85) * coalesce(s / nullif(max(s) OVER (PARTITION BY source), 0), 0) AS final FROM e)"""


@query(_BLENDED + " SELECT source AS query_id, printf('d%07d', doc_id) AS chunk_id, rank::INTEGER AS rank, round(final, 6) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(final, 9) DESC, doc_id) AS rank FROM z) WHERE rank <= 6")
def blended_rerank(spark, d):
    return r.rerank(r.boost(_wide(spark, d), 18), 6).select("query_id", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"))


@query()
def hybrid_search(spark, d):
    """The whole path for every tenant: BM25 and vectors, fusion, boosts, collapse, rerank."""
    c = chunks(spark, d)
    asked = _every_tenant(spark, d)
    out = r.hybrid_search(c, r.postings(c, "section", asked=asked), r.corpus_stats(c, "section"), asked, _semantic_table(spark, d))
    return out.select("query_id", "tenant_id", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"), "sources", "duplicates")


@query()
def collapsed_pool(spark, d):
    pool = r.ranked(chunks(spark, d).select(F.col("tenant_id").alias("query_id"), "chunk_id", "document_id", "chunk_index", "text", F.lit(1.0).alias("score")), 18)
    return r.collapse(pool)


def _chunked(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("document_id"), "text"))


@query()
def chunked_documents(spark, d):
    return _chunked(spark, d)


@query()
def chunk_statistics(spark, d):
    return chunking.statistics(_chunked(spark, d))


def _context(spark, d):
    c = chunks(spark, d)
    cand = _wide(spark, d)
    top = r.rerank(r.boost(cand, 18), 6).select("query_id", "chunk_id", "pinned", "final_score", "section", "text", "document_id", "chunk_index")
    del c
    return context.build(top, 3000, 6)


@query()
def context_blocks(spark, d):
    return _context(spark, d)[1]


@query()
def context_statistics(spark, d):
    sources, _, omitted = _context(spark, d)
    return context.statistics(sources, omitted)


@query()
def extractive_answer(spark, d):
    sources, _, _ = _context(spark, d)
    return answers.extractive_answers(sources, _every_tenant(spark, d))


_ANSWERS = "SELECT conv_id AS query_id, turn AS number, text FROM conversations WHERE role = 'user'"


@query("""WITH a AS (SELECT conv_id, [1, 3, 99] AS cited FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, unnest(cited) AS number FROM a),
    s AS (SELECT conv_id, turn + 1 AS number, conv_id || ':' || turn AS chunk_id FROM conversations WHERE role <> 'system')
    SELECT n.conv_id AS query_id, n.number::INTEGER AS number, coalesce(s.chunk_id, '') AS chunk_id, CASE WHEN s.chunk_id IS NULL THEN 'unknown_source' ELSE 'ok' END AS status FROM n LEFT JOIN s USING (conv_id, number)""")
def citation_check(spark, d):
    c = table(spark, d, "conversations")
    a = c.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.array(*[F.lit(x) for x in (1, 3, 99)]).alias("cited"), F.lit("").alias("answer"))
    s = c.where("role <> 'system'").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("number"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))
    return answers.check_citations(a, s).select("query_id", "number", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "status")


@query(r"""WITH f AS (SELECT conv_id, string_agg(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' ' ORDER BY turn) AS hay FROM conversations GROUP BY conv_id),
    q AS (SELECT conv_id, trim(substr(text, 1, 60)) AS quote FROM conversations WHERE turn = 1 AND length(text) >= 80 AND NOT contains(substr(text, 1, 60), '"'))
    SELECT conv_id AS query_id, quote, contains(hay, trim(regexp_replace(regexp_replace(lower(quote), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS verified FROM q JOIN f USING (conv_id) WHERE len(regexp_split_to_array(quote, '\s+')) >= 4""")
def quote_check(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("turn = 1 and length(text) >= 80 and not contains(substr(text, 1, 60), '\"')").select(F.col("conv_id").alias("query_id"), F.concat(F.lit('It says "'), F.substring("text", 1, 60), F.lit('".')).alias("answer"))
    return answers.check_quotes(a, c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("number"), "text"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN trim(text) END AS answer, CASE WHEN text IS NOT NULL AND turn > 0 THEN [turn::INTEGER] ELSE []::INTEGER[] END AS cited, false AS insufficient, '' AS interpretation, true AS recovered,
    CASE WHEN text IS NULL THEN 'no ''answer'' field' WHEN trim(text) = '' THEN 'empty answer' END AS error FROM conversations WHERE role = 'assistant'""")
def parsed_replies(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    reply = F.concat(F.lit("Here: ```json\n"), F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.struct(F.concat(F.lit("Source "), F.col("turn").cast("string")).alias("source"))).alias("citations"))), F.lit("\n```"))
    return answers.parse_replies(c.select("conv_id", "turn", reply.alias("reply"))).select("conv_id", "turn", "parsed.*")


@query("""WITH w AS (SELECT conv_id, turn, text, CASE WHEN regexp_matches(text, '(^|[^a-zA-Z0-9_.])4($|[^a-zA-Z0-9_.])') OR regexp_matches(text, '(^|[^a-zA-Z0-9_.])4[.]($|[^0-9])') THEN true ELSE false END AS hit FROM conversations) SELECT conv_id, turn, hit FROM w""")
def reference_match(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.mentions_reference(F.col("text"), "4").alias("hit"))

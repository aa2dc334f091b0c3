"""Evidence selection, token-budget fitting, ordering and rendering of context blocks.

Selection, ordering and numbering are windows. Fitting a budget depends on what
fitted before, so it is a fold per query over a few rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import segments as sg

RULE = "\n\n---\n\n"
UNKNOWN, NO_PAGE = "unknown", "unknown"
SENTENCE_SHARE = 0.75
REFITS = 3


def select_evidence(candidates: DataFrame, floor: float = 0.0, max_sources: int = 6) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted with reason) of collapsed candidates: empty, below the floor, past the source limit; pinned first.

    Ranks are taken of keys alone, the best of each task before the shuffle; the last source kept of a query
    (a row a query, broadcast) then parts the candidates where they are, so no task has all of a query's."""
    order = [F.desc("pinned"), F.desc("final_score"), "chunk_id"]
    reason = F.when(F.trim("text") == "", "empty").when((F.lit(floor) > 0) & (F.col("final_score") < floor), "below_floor")
    tagged = candidates.withColumn("reason", reason)
    if max_sources < 1:
        return candidates.where("false"), tagged.withColumn("reason", F.coalesce("reason", F.lit("max_sources")))
    usable, barred = tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")
    best = lambda rows: rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("__n") <= max_sources)
    top = best(usable.select("query_id", "pinned", "final_score", "chunk_id")).groupBy("query_id", "pinned", "final_score", "chunk_id").agg(F.max("__n").alias("__n"), F.count("*").alias("__places"))
    last = top.groupBy(F.col("query_id").alias("__q")).agg(F.max(F.struct("__n", "pinned", "final_score", "chunk_id", "__places")).alias("__last"))
    placed = usable.join(F.broadcast(last), F.col("query_id").eqNullSafe(F.col("__q"))).drop("__q")
    score, end = F.struct("pinned", "final_score"), F.struct("__last.pinned", "__last.final_score")  # structs order nulls too
    key, end_key = F.struct("chunk_id"), F.struct("__last.chunk_id")
    after, level = (score < end) | ((score == end) & (key > end_key)), (score == end) & (key == end_key)
    kept = best(placed.where(~after).drop("__last")).drop("__n")
    # of rows that repeat the last key as many stay as there were places
    nth = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("chunk_id"))
    past = placed.where(level).withColumn("__n", nth).where(F.col("__n") > F.col("__last.__places")).drop("__n").union(placed.where(after))
    return kept, barred.unionByName(past.drop("__last").withColumn("reason", F.lit("max_sources")))


def header(r, number: int, cut: int = 0, continues: int = 0, body: str = "", also: str = "") -> str:
    """A rendered block; cut: tokens removed from the end."""
    page = NO_PAGE if not r["page_number"] or r["page_number"] < 1 else str(r["page_number"])
    if page != NO_PAGE and r["page_end"] and r["page_end"] != r["page_number"]:
        page += f"-{r['page_end']}"
    notes = [
        f"This passage was shortened to fit the context budget; {cut} tokens were removed from the end, so it may not contain the whole clause." if cut else "",
        "Text recovered by OCR from a scanned page; wording may contain recognition errors." if r["ocr"] else "",
        "This passage begins or ends mid-sentence." if r["split_mid_sentence"] else "",
    ]
    note = " ".join(n for n in notes if n)
    lines = [
        f"Source {number}:", f"Document: {r['filename'] or UNKNOWN} (id: {r['document_id'] or UNKNOWN})", f"Page: {page}", f"Section: {r['section'] or UNKNOWN}",
        f"Chunk: {r['chunk_index']} (id: {(r['chunk_id'] or '')[:12]})", f"Continues: Source {continues}" if continues else "", f"Also appears in: {also}" if also else "", f"Note: {note}" if note else "",
    ]
    text = f"{body}\n[… passage shortened; {cut} tokens omitted …]" if cut else body
    return "\n".join([x for x in lines if x] + ["Text:", text])


def strip_heading(text: str, section: str | None) -> str:
    """The text without a leading section heading, unless that is all there is."""
    body, head = (text or "").lstrip(), (section or "").strip()
    if head and body.lower().startswith(head.lower()):
        rest = body[len(head) :].lstrip("\n\r \t:.-")
        return rest if rest.strip() else text
    return text


def shorten(text: str, budget: int) -> str:
    """Whole sentences where they keep three quarters of the budget, else whole words."""
    if budget <= 0:
        return ""
    if sg.count(text) <= budget:
        return text
    kept: list[str] = []
    for sentence in sg.sentences(text):
        if sg.count(" ".join([*kept, sentence])) > budget:
            break
        kept.append(sentence)
    aligned = " ".join(kept)
    return aligned if kept and sg.count(aligned) >= SENTENCE_SHARE * budget else sg.within(text, budget)


FITTED = "query_id string, chunk_id string, number int, text string, original_tokens int, text_tokens int, total_tokens int, truncated boolean, reason string"


def fit(kept: DataFrame, budget: int = 3000, per_source: int = 700, least: int = 60, truncate: bool = True) -> DataFrame:
    """FITTED rows in relevance order: text that fits, or a reason why a source was left out; misfits don't end the walk."""
    names = [x.split()[0] for x in FITTED.split(", ")]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        ordered = rows.sort_values(["pinned", "final_score", "chunk_id"], ascending=[False, False, True])
        for number, r in enumerate(ordered.astype(object).where(ordered.notna(), None).to_dict("records"), 1):
            body = strip_heading(r["text"], r["section"])
            n = sg.count(body)
            between = sg.count(RULE) if any(o["reason"] is None for o in out) else 0
            room = left - between - sg.count(header(r, number))
            room = min(room, per_source) if per_source > 0 else room
            row = {"query_id": r["query_id"], "chunk_id": r["chunk_id"], "number": number, "text": None, "original_tokens": n, "text_tokens": 0, "total_tokens": 0, "truncated": False, "reason": None}
            out.append(row)
            if room < least or (n > room and not truncate):
                row["reason"] = "budget_exhausted"
                continue
            text, target = body, room
            for _ in range(REFITS + 1):
                text = shorten(text, target)
                cut = n - sg.count(text)
                total = between + sg.count(header(r, number, cut, body=text))
                if total <= left:
                    break
                target = sg.count(text) - (total - left) - 1
            if total > left or (n > room and sg.count(text) < least):
                row["reason"] = "too_small_to_truncate"
                continue
            row |= {"text": text, "text_tokens": n - cut, "total_tokens": total, "truncated": cut > 0}
            left -= total
        return pd.DataFrame(out, columns=names)

    return kept.groupBy("query_id").applyInPandas(fold, FITTED)


def order_sources(fitted: DataFrame, by: str = "document") -> DataFrame:
    """Numbered 1..N: by relevance, or documents by their best source with sources in reading order; continuation marked."""
    q = Window.partitionBy("query_id")
    d = Window.partitionBy("query_id", "document_id")
    rows = fitted.withColumn("__best", F.max("final_score").over(d)).withColumn("__first", F.min("number").over(d))
    keys = [F.desc("__best"), "__first", "document_id", "page_number", "chunk_index", "chunk_id"] if by == "document" else [F.desc("final_score"), "chunk_id"]
    rows = rows.withColumn("number", F.row_number().over(q.orderBy(*keys))).drop("__best", "__first")
    w = q.orderBy("number")
    follows = (F.lag("document_id").over(w) == F.col("document_id")) & (F.lag("chunk_index").over(w) + 1 == F.col("chunk_index"))
    return rows.withColumn("continues", F.when(follows, F.col("number") - 1))


def render(sources: DataFrame) -> DataFrame:
    """(query_id, evidence): blocks joined by rules."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))
    page = F.when(F.coalesce("page_number", F.lit(0)) < 1, NO_PAGE).when(F.coalesce("page_end", "page_number") == F.col("page_number"), F.col("page_number").cast("string")).otherwise(F.concat_ws("-", "page_number", "page_end"))
    cut = F.col("original_tokens") - F.col("text_tokens")
    note = F.concat_ws(
        " ",
        F.when(F.col("truncated"), F.concat(F.lit("This passage was shortened to fit the context budget; "), cut.cast("string"), F.lit(" tokens were removed from the end, so it may not contain the whole clause."))),
        F.when(F.col("ocr"), "Text recovered by OCR from a scanned page; wording may contain recognition errors."),
        F.when(F.col("split_mid_sentence"), "This passage begins or ends mid-sentence."),
    )
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Source "), F.col("number").cast("string"), F.lit(":")), F.concat(F.lit("Document: "), c("filename"), F.lit(" (id: "), c("document_id"), F.lit(")")),
        F.concat(F.lit("Page: "), page), F.concat(F.lit("Section: "), c("section")), F.concat(F.lit("Chunk: "), c("chunk_index"), F.lit(" (id: "), F.substring("chunk_id", 1, 12), F.lit(")")),
        F.when(F.col("continues").isNotNull(), F.concat(F.lit("Continues: Source "), F.col("continues").cast("string"))),
        F.when(F.size(F.coalesce("also", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Also appears in: "), F.array_join("also", "; "))),
        F.when(note != "", F.concat(F.lit("Note: "), note)), F.lit("Text:"), F.col("text"),
        F.when(F.col("truncated"), F.concat(F.lit("[… passage shortened; "), cut.cast("string"), F.lit(" tokens omitted …]"))),
    )
    rows = sources.select("query_id", "number", block.alias("block"))
    joined = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("b"))  # a few sources
    return joined.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), RULE).alias("evidence"))


def build(candidates: DataFrame, budget: int = 3000, max_sources: int = 6, floor: float = 0.0, order: str = "document", **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, evidence, omitted) from reranked candidates with chunk columns."""
    for name, default in (("filename", F.col("document_id").cast("string")), ("page_number", F.lit(0)), ("page_end", F.lit(0)), ("ocr", F.lit(False)), ("split_mid_sentence", F.lit(False)), ("also", F.array().cast("array<string>"))):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, default)
    kept, dropped = select_evidence(candidates, floor, max_sources)
    fitted = fit(kept, budget, **limits)
    meta = kept.select("query_id", "chunk_id", "document_id", "filename", "page_number", "page_end", "section", "chunk_index", "ocr", "split_mid_sentence", "also", "final_score")
    sources = order_sources(fitted.where("reason is null").drop("reason").join(meta, ["query_id", "chunk_id"]), order)
    omitted = dropped.select("query_id", "chunk_id", "reason").union(fitted.where("reason is not null").select("query_id", "chunk_id", "reason"))
    return sources, render(sources), omitted


def statistics(sources: DataFrame, omitted: DataFrame) -> DataFrame:
    """Per query: sources, tokens, documents, truncated, and omissions by reason."""
    s = sources.groupBy("query_id").agg(F.count("*").alias("sources"), F.sum("total_tokens").alias("tokens"), F.countDistinct("document_id").alias("documents"), F.count_if("truncated").alias("truncated"))
    reasons = ["empty", "below_floor", "max_sources", "budget_exhausted", "too_small_to_truncate"]
    o = omitted.groupBy("query_id").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in reasons])
    return s.join(o, "query_id", "full").na.fill(0)


def warnings(sources: DataFrame, omitted: DataFrame, min_sources: int = 0) -> DataFrame:
    """(query_id, warnings array<string>): what to know before a context is used; reported, never enforced.

    no_sources stands alone; else few_sources (under min_sources), shortened:<tokens
    lost>, left_out:<sources that met no budget> and ocr, in this order. Every query
    that has a source or an omission has a row."""
    s = sources.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("truncated"), F.col("original_tokens") - F.col("text_tokens"))).alias("lost"), F.max(F.coalesce("ocr", F.lit(False))).alias("ocr"),
    )
    o = omitted.groupBy("query_id").agg(F.count_if(F.col("reason").isin("budget_exhausted", "too_small_to_truncate")).alias("out"))
    x = s.join(o, "query_id", "full").na.fill(0, ["n", "out"])
    some = F.array_compact(F.array(
        F.when(F.col("n") < min_sources, "few_sources"), F.when(F.col("lost").isNotNull(), F.concat_ws(":", F.lit("shortened"), F.col("lost").cast("string"))),
        F.when(F.col("out") > 0, F.concat_ws(":", F.lit("left_out"), F.col("out").cast("string"))), F.when(F.col("ocr"), "ocr"),
    ))
    return x.select("query_id", F.when(F.col("n") == 0, F.array(F.lit("no_sources"))).otherwise(some).alias("warnings"))


def citations(sources: DataFrame) -> DataFrame:
    """(query_id, number, chunk_id, document_id, page_number, also): what each source number stands for, for a citation list."""
    return sources.select("query_id", "number", "chunk_id", "document_id", cited_page(F.col("page_number")).alias("page_number"), F.coalesce("also", F.array().cast("array<string>")).alias("also"))


def also_appears_in(pool: DataFrame, repeats: DataFrame) -> DataFrame:
    """pool with also: 'document p. page' of each survivor's repeats, in order. repeats: (query_id, chunk_id, document_id, page_number)."""
    names = F.transform(F.array_sort(F.collect_set(F.struct("document_id", "page_number"))), lambda x: F.concat_ws(" p. ", x["document_id"].cast("string"), F.nullif(x["page_number"], F.lit(0)).cast("string")))
    return pool.join(repeats.groupBy("query_id", "chunk_id").agg(names.alias("also")), ["query_id", "chunk_id"], "left").withColumn("also", F.coalesce("also", F.array().cast("array<string>")))


def cited_page(page: Column) -> Column:
    return F.nullif(page, F.lit(0))

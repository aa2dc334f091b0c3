"""Page cleaning: characters, noise lines, page numbers, running lines, line breaks, blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as tx

EDGE = 3


def _edges(pages: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    both = F.array_distinct(F.concat(F.slice(lines, 1, EDGE), F.when(F.size(lines) > EDGE, F.slice(lines, -EDGE, EDGE)).otherwise(lines)))
    return pages.select("document_id", "page_number", F.explode(both).alias("line"))


def running_keys(pages: DataFrame, ratio: float = 0.6, min_pages: int = 3) -> DataFrame:
    """(document_id, key): fingerprints on the edges of most of a document's pages; none under min_pages pages."""
    edges = _edges(pages)
    keys = edges.select("document_id", "page_number", "line", F.explode(F.array_distinct(F.array(tx.fingerprint(F.col("line")), tx.masked_fingerprint(F.col("line"))))).alias("key")).where("key <> ''")
    counts = keys.select("document_id", "page_number", "line", "key").distinct().groupBy("document_id", "key").agg(F.count("*").alias("n"))
    totals = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.lit(min_pages - 1), F.floor(F.col("pages") * ratio))
    return counts.join(totals, "document_id").where((F.col("pages") >= min_pages) & (F.col("n") >= enough)).select("document_id", "key")


def clean_pages(pages: DataFrame, ratio: float = 0.6, min_pages: int = 3) -> DataFrame:
    """(document_id, page_number, text, removed): empty pages stay; removed counts the lines that went."""
    repaired = pages.withColumn("text", tx.repair_characters(F.coalesce("text", F.lit(""))))
    lines = repaired.select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(~tx.is_noise(F.col("line")) & ~tx.is_page_number(F.col("line")))
    running = running_keys(repaired, ratio, min_pages)
    keyed = lines.withColumn("exact", tx.fingerprint(F.trim(F.col("line")))).withColumn("masked", tx.masked_fingerprint(F.trim(F.col("line"))))
    for name in ("exact", "masked"):
        keyed = keyed.join(running.withColumnRenamed("key", name), ["document_id", name], "left_anti")
    body = keyed.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))  # one page's lines
    body = body.select("document_id", "page_number", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
    full = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))
    out = repaired.join(body, ["document_id", "page_number"], "left")
    text = tx.tidy_blanks(tx.repair_lines(F.coalesce("body", F.lit(""))))
    return out.select("document_id", "page_number", text.alias("text"), F.greatest(F.lit(0), full(F.col("text")) - full(F.coalesce("body", F.lit("")))).alias("removed"))


def blocks(documents: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys..., page_number 0, block_index, text, section): paragraphs of inline text, headings carried forward. keys: document_id unless given."""
    keys = keys or ("document_id",)
    parts = F.filter(F.split(F.col(text), r"\n\s*\n"), lambda x: F.trim(x) != "")
    rows = documents.select(*keys, F.posexplode(parts).alias("block_index", "text"))
    found = rows.withColumn("found", tx.section_label(F.substring_index(F.trim(F.col("text")), "\n", 1)))
    carried = F.last("found", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0))
    return found.select(*keys, F.lit(0).alias("page_number"), "block_index", F.trim("text").alias("text"), carried.alias("section"))


def renumbered(blocks: DataFrame, key: str = "document_id", order: str = "block_index", text: str = "text") -> DataFrame:
    """blocks without blank ones, numbered 0, 1, 2 ... within each document."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return blocks.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn(order, nth)


def extraction_stats(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, native / ocr pages and the method they amount to."""
    x = pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("method") == "native").alias("native"), F.count_if(F.col("method") == "ocr").alias("ocr"),
    )
    kind = F.when((F.col("native") > 0) & (F.col("ocr") > 0), "mixed").when(F.col("ocr") > 0, "ocr").when(F.col("native") > 0, "native").otherwise("none")
    return x.withColumn("method", kind)


def needs_ocr(text, threshold: int = 100):
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < threshold


def ocr_improves(native, ocr, factor: float = 1.2):
    return F.length(F.coalesce(ocr, F.lit(""))) >= F.length(F.coalesce(native, F.lit(""))) * factor

"""Readers and writers: CSV, chat sessions, inline text, binary documents, with guards and a parser registry."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = r"^[A-Za-z0-9_.:@-]{1,128}$"
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}
SYNTHETIC_PAGE = 3000
PAGES = "path string, page_number int, method string, synthetic boolean, text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """CSV with a header and a declared schema: nothing is inferred."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_workbook(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The sheets of a workbook exported as one CSV each."""
    return {name: read_csv(spark, f"{root}/{name}.csv", schema) for name, schema in schemas.items()}


MESSAGE = "conv_id string, turn long, role string, text string, at timestamp"


def save_sessions(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").json(path)


def load_session(spark: SparkSession, path: str, conv_id: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path).where(F.col("conv_id") == conv_id).orderBy("turn")


# --- guards ----------------------------------------------------------------------


def valid_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def checked_path(path: str, root: str, extensions: set[str]) -> str:
    """path, if it stays within root and has an allowed extension."""
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"{path} leaves {root}")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    name = "/".join(parts)
    if not name or path.startswith("/") or "\0" in path:
        raise ValueError(f"{path!r} isn't a relative path below {root}")
    if name.rsplit(".", 1)[-1].lower() not in extensions:
        raise ValueError(f"{path!r} has none of the extensions {sorted(extensions)}")
    return f"{root.rstrip('/')}/{name}"


def file_error(path: Column, content: Column, length: Column, most: int) -> Column:
    """Null, or what is wrong with a binary file: empty, too large, or bytes that don't fit its extension."""
    extension = F.lower(F.substring_index(path, ".", -1))
    out = F.when(length == 0, "empty file").when(length > most, f"larger than {most} bytes")
    for kind, magic in MAGIC.items():
        out = out.when((extension == kind) & ~F.startswith(content, F.lit(bytearray(magic))), f"not a {kind} file")
    return out


# --- parsers ------------------------------------------------------------------------

PARSERS: dict[str, Callable[[bytes], list[dict]]] = {}


def register_parser(extension: str, parse: Callable[[bytes], list[dict]]) -> None:
    """parse: file content -> page rows (page_number, method, synthetic, text)."""
    PARSERS[extension.lower()] = parse


def parse_text(content: bytes) -> list[dict]:
    return [{"page_number": 0, "method": "native", "synthetic": False, "text": content.decode("utf-8", "replace")}]


def parse_docx(content: bytes) -> list[dict]:
    """Paragraphs and tables (cells joined by ' | ') of a word-processor file; a page ends at a page break or SYNTHETIC_PAGE characters."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    pages: list[list[str]] = [[]]
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            lines = [" | ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")).strip() for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
        else:
            lines = ["".join(t.text or "" for t in node.iter(f"{_W}t")).strip()]
        broken = any(b.get(f"{_W}type") == "page" for b in node.iter(f"{_W}br"))
        if pages[-1] and (broken or sum(map(len, pages[-1])) >= SYNTHETIC_PAGE):
            pages.append([])
        pages[-1] += [x for x in lines if x]
    return [{"page_number": i, "method": "native" if p else "none", "synthetic": True, "text": "\n\n".join(p)} for i, p in enumerate(pages, 1)]


register_parser("txt", parse_text)
register_parser("md", parse_text)
register_parser("docx", parse_docx)


def read_documents(spark: SparkSession, path: str, most: int = 64 * 1024 * 1024, glob: str = "*") -> DataFrame:
    """PAGES rows of binary files. A file that can't be read is one row with an error; it stops nothing else."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.select("path", "content", file_error(F.col("path"), F.col("content"), F.col("length"), most).alias("error"))
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                none = {"path": r.path, "page_number": None, "method": "none", "synthetic": False, "text": None}
                extension = r.path.rsplit(".", 1)[-1].lower()
                if r.error is not None or extension not in parsers:
                    rows.append(none | {"error": r.error or f"no parser for .{extension}"})
                    continue
                try:
                    rows += [{"path": r.path, "error": None, **p} for p in parsers[extension](bytes(r.content))]
                except Exception as e:  # one bad file is a row, whatever its parser raises
                    rows.append(none | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])

    return files.mapInPandas(run, PAGES)


def scalar_metadata(entries: Column, reserved: tuple[str, ...] = ("document_id", "tenant_id", "filename", "document_type")) -> Column:
    """A string map without reserved keys and null values."""
    return F.map_filter(entries, lambda k, v: ~k.isin(*reserved) & v.isNotNull())


def flat_columns(df: DataFrame, entries: str, keys: list[str], prefix: str = "meta_") -> DataFrame:
    """df with a column per key of a string map, null where a row lacks it."""
    return df.withColumns({f"{prefix}{k}": F.try_element_at(entries, F.lit(k)) for k in keys})


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", name)[:128]

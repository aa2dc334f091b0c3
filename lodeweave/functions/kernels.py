"""Text work of many small steps in Python, over Arrow batches: counted terms, pairs of terms, shingles.

Texts come lowered from Spark, so both sides agree on case. Tokens hold ASCII only: the bytes of a text are mapped to
those a token may have and split at the rest, and only words with a mark inside meet the token's pattern."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import lexicon as L

ROWS, PAIRS = 500, 200_000  # rows a batch handed on, pairs counted at once
_PLAIN = b"abcdefghijklmnopqrstuvwxyz0123456789"
_WORD_BYTES = bytes(c if c in _PLAIN + b".-/" else 32 for c in range(256))
_FORM_BYTES = bytes(c if c in _PLAIN else 32 for c in range(256))
_TOKEN = re.compile(L.TOKEN.encode())
_CANONICAL = {word.encode(): family[0].encode() for family in L.FAMILIES for word in family}
_STOP = frozenset(word.encode() for word in L.STOPWORDS)


def canonical(token: bytes) -> bytes:
    """The same rules as the Column function."""
    if token[-1] != 115:  # s
        return _CANONICAL.get(token, token)
    found = _CANONICAL.get(token)
    if found:
        return found
    n = len(token)
    if n > 4 and token.endswith(b"ies"):
        return token[:-3] + b"y"
    if n > 4 and token.endswith(b"sses"):
        return token[:-2]
    return token[:-1] if n > 3 and not token.endswith((b"ss", b"us", b"is")) else token


def words(lowered: str) -> list[bytes]:
    """Runs of token characters and marks, marks at the ends included."""
    return lowered.encode().translate(_WORD_BYTES).split()


def word_tokens(word: bytes) -> list[bytes]:
    word = word.strip(b".-/")
    return [t for t in ([word] if word.isalnum() else _TOKEN.findall(word)) if t not in _STOP]


def tally(lowered: str) -> dict[bytes, int]:
    """How often each canonical term occurs."""
    tf: dict[bytes, int] = {}
    for word, n in Counter(words(lowered)).items():
        for token in (word,) if word.isalnum() and word not in _STOP else word_tokens(word):
            term = canonical(token)
            tf[term] = tf.get(term, 0) + n
    return tf


def in_order(lowered: str) -> list[bytes]:
    """Canonical terms as they follow each other."""
    out: list[bytes] = []
    for word in words(lowered):
        if word.isalnum():
            if word not in _STOP:
                out.append(canonical(word))
        else:
            out += map(canonical, word_tokens(word))
    return out


def _lowered(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("__text"))


def counted_terms(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """(keep..., term, tf, length): a row per row of df and distinct term; length: how many tokens the row has."""
    rows = _lowered(df, text, keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                terms, counts, ends, lengths = [], [], [0], []
                for one in batch.column(batch.num_columns - 1).to_pylist():
                    tf = tally(one)
                    terms += tf
                    counts += tf.values()
                    ends.append(len(terms))
                    lengths.append(sum(tf.values()))
                at = pa.array(ends, pa.int32())
                made = [pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())), pa.array(lengths, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keep, "__t", "__n", "length"])

    out = T.StructType([*[f for f in rows.schema if f.name != "__text"], T.StructField("__t", T.ArrayType(T.StringType())), T.StructField("__n", T.ArrayType(T.LongType())), T.StructField("length", T.IntegerType())])
    lists = rows.mapInArrow(count, out)
    return lists.select(*keep, "length", F.inline(F.arrays_zip(F.col("__t").alias("term"), F.col("__n").alias("tf")))).select(*keep, "term", "tf", "length")


def term_length(text: Column) -> Column:
    """How many lexical tokens a text has, stopwords left out."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(n * len(word_tokens(w)) for w, n in Counter(words(t)).items()) for t in texts], dtype="int32")

    return count(F.lower(F.coalesce(text, F.lit(""))))


def counted_pairs(df: DataFrame, text: Column) -> DataFrame:
    """(pair, n): neighbouring terms within a row, counted in parts; a pair may have several rows, which add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for one in batch.column(0).slice(start, ROWS).to_pylist():
                    terms = in_order(one)
                    held.update(zip(terms, terms[1:], strict=False))
                    if len(held) >= PAIRS:
                        yield flush(held)
                        held.clear()
        yield flush(held)

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a + b" " + b for a, b in held], pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["pair", "n"])

    return _lowered(df, text, []).mapInArrow(count, "pair string, n long")


_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(b" " + _PLAIN):
    _CODE[_c] = _i


def shingle_count(text: Column, size: int = 5) -> Column:
    """How many distinct character n-grams the compare form has; a shorter text is its own only one. size: 12 at most, so that a gram is one number."""
    if not 1 <= size <= 12:
        raise ValueError("size: 1 to 12")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([_distinct(t, size) for t in texts], dtype="int64")

    return count(F.lower(F.coalesce(text, F.lit(""))))


def _distinct(lowered: str, size: int) -> int:
    form = b" ".join(lowered.encode().translate(_FORM_BYTES).split())  # the compare form
    if len(form) <= size:
        return 1 if form else 0
    codes = _CODE[np.frombuffer(form, np.uint8)].astype(np.int32 if size <= 5 else np.int64)
    n = len(codes) - size + 1
    grams = codes[:n].copy()
    for i in range(1, size):
        grams *= 37
        grams += codes[i : i + n]
    grams.sort()
    return 1 + int(np.count_nonzero(grams[1:] != grams[:-1]))

"""Token counters by name: the estimate, or the exact count of a tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import warnings
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as tx

WORDS_PER_TOKEN = 0.75  # fixed value


def vocabulary_counter(spark: SparkSession, path: str, pattern: str | None = None) -> Callable[[Column], Column]:
    """Exact counts in Arrow batches; the file (a few MB) is read by the driver and broadcast.

    A .tiktoken file holds ranks and needs the pattern that splits a text into pieces; any
    other is taken as a tokenizers JSON file. Strings of special tokens count as plain text."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    ranked = path.endswith(".tiktoken")
    if ranked and not pattern:
        raise ValueError("a .tiktoken file needs the pattern of its pieces")

    @F.pandas_udf("int")
    def count(batches: pd.Series) -> pd.Series:
        encode = _loaded.get(path) or _loaded.setdefault(path, _encoder(shared.value, pattern if ranked else None))
        return pd.Series([len(ids) for ids in encode(t or "" for t in batches)], dtype="int32")

    return count


_loaded: dict[str, Callable] = {}  # one encoder a worker and file
TEXTS = 64  # encoded at once where the library takes many


def _encoder(data: bytes, pattern: str | None) -> Callable[[Iterable[str]], Iterator]:
    """Ids text by text: those of a batch are many times its size."""
    if pattern:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: map(own.encode_ordinary, texts)
    from tokenizers import Tokenizer

    read = Tokenizer.from_str(data.decode())
    read.encode_special_tokens = True
    return lambda texts: (e.ids for some in batched(texts, TEXTS) for e in read.encode_batch(list(some), add_special_tokens=False))


def counter(spark: SparkSession, name: str = "heuristic", path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """'heuristic', or 'exact' with a vocabulary file; where that can't be read, a warning and the estimate."""
    if name not in ("heuristic", "exact"):
        raise ValueError(f"unknown counter {name!r}; known: ['exact', 'heuristic']")
    if name == "exact":
        try:
            return vocabulary_counter(spark, path or "", pattern)
        except OSError as e:
            warnings.warn(f"no vocabulary ({e}); token counts are estimates", stacklevel=2)
    return tx.token_count


def words_for_tokens(tokens: Column) -> Column:
    """How many words surely fit: three quarters of the tokens, one at least."""
    return F.greatest(F.lit(1), F.floor(tokens * WORDS_PER_TOKEN).cast("int"))

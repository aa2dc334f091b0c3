"""Text encoders as Arrow-batched functions: a deterministic hashing encoder, and a registry for others."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=200_000)
def _slot(gram: str, width: int) -> tuple[int, float]:
    d = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "big") % width, 1.0 if d[4] % 2 == 0 else -1.0


def hashed_vector(text: str | None, width: int, normalised: bool = True) -> list[float]:
    """Signed counts of words and neighbouring pairs, log-damped, of unit length unless empty."""
    words = WORD.findall((text or "").lower())
    v = np.zeros(width)
    for gram in [*words, *(f"{a}~{b}" for a, b in zip(words, words[1:], strict=False))]:
        at, sign = _slot(gram, width)
        v[at] += sign
    v = np.sign(v) * np.log1p(np.abs(v))
    n = np.sqrt((v * v).sum())
    return (v / n if normalised and n > 1e-12 else v).tolist()


def hashing_encoder(width: int = 384, normalised: bool = True) -> Callable[[Column], Column]:
    if width < 1:
        raise ValueError("the width must be positive")

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: hashed_vector(t, width, normalised))

    return encode


ENCODERS: dict[str, Callable[..., Callable[[Column], Column]]] = {"hashing": hashing_encoder}


def register_encoder(name: str, make: Callable[..., Callable[[Column], Column]]) -> None:
    ENCODERS[name] = make


def encoder(name: str = "hashing", strict: bool = True, **options) -> Callable[[Column], Column]:
    """The named encoder; where it is missing an error, or the hashing one if not strict."""
    if name not in ENCODERS:
        if strict:
            raise ValueError(f"unknown encoder {name!r}; known: {sorted(ENCODERS)}")
        name, options = "hashing", {k: v for k, v in options.items() if k in ("width", "normalised")}
    return ENCODERS[name](**options)


def checked_width(vector: Column, width: int) -> Column:
    """vector, or an error where its width differs."""
    return F.when(F.size(vector) == width, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected vectors {width} wide, not "), F.size(vector).cast("string"))))


def nfkc(text: Column) -> Column:
    """NFKC form; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return form(text)

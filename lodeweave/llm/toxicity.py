"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each distinct feature of a text counts once. Training is one sequential pass or
more over a bounded, documented sample of labelled rows, with per-coordinate
rates and L1 shrinkage, so most of the table ends as exact zeros and the rest is
broadcast as sorted (slot, weight) arrays of at most SLOTS entries.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 19
WORD = re.compile(r"[^\W\d_]+")
WORDS_CACHED = 300_000
BLOCK = 1 << 18


class Features:
    """Hashed slots of a text's words, word pairs and pairs around one word."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int64)
        words, known = WORD.findall(text.lower()), self.known
        if len(known) > WORDS_CACHED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words)) if len(known) else np.zeros(0, np.uint64)
        found = []
        for at in range(0, len(h), BLOCK):  # blocks overlap by two words
            x = h[at : at + BLOCK + 2]
            for gap in (0, 1, 2):
                if len(x) > gap:
                    y = x[: len(x) - gap] * np.uint64(2 * gap + 1) + (x[gap:] * np.uint64(0xC2B2AE3D27D4EB4F) if gap else np.uint64(0))
                    y = (y ^ (y >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    found.append((y >> np.uint64(64 - 19)).astype(np.int64))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


@dataclass
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.05
    epochs: int = 5
    z: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1))

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == SLOTS, 0.0, self.l1)  # the bias isn't shrunk
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def fit(self, rows: list[tuple[np.ndarray, int]]) -> Ftrl:
        for _ in range(self.epochs):
            for slots, y in rows:
                at = np.append(slots, SLOTS)
                w = self._weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                was = self.n[at]
                self.n[at] = was + g * g
                self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / self.alpha * w
        return self

    def compact(self) -> Weights:
        w = self._weights(np.arange(SLOTS + 1))
        at = np.flatnonzero(w[:SLOTS])
        return Weights(at.astype(np.int32), w[at].astype(np.float32), float(w[SLOTS]))


@dataclass
class Weights:
    slots: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(SLOTS, dtype=np.float32)
        table[self.slots] = self.values
        return table


def margin(table: np.ndarray, bias: float, slots: np.ndarray) -> float:
    return float(table[slots].sum(dtype=np.float64)) + bias


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_rows: int = 6_000, max_chars: int = 100_000) -> Weights:
    """Learn from at most max_rows labelled rows, the first by a hash of the key, of max_chars at most.

    Their texts are hashed on the executors; the driver gets one list of slots at a
    time and keeps at most max_rows of them. Longer texts don't teach, but are scored
    whole. Where a key has several labels, the largest counts; equal texts of one key
    count once. No labelled row gives weights of zero."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(f"`{key}`").alias("k")).agg(F.max(label).cast("int").alias("y"))
    drawn = marked.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where(f"length(t) <= {max_chars}")
    rows = rows.join(F.broadcast(drawn), "k").select("k", "y", "t")  # max_rows bounds the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            texts = b.column(2).to_pylist()
            order = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            slots = [make(t).astype("<u4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order, pa.int64()), pa.array(slots, pa.binary())], names=["k", "y", "h", "slots"])

    hashed = rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, y int, h long, slots binary")
    got = sorted({(r["h"], r["k"], r["y"], bytes(r["slots"])) for r in hashed.toLocalIterator()})
    model = Ftrl()
    model.l1 = 1 + (model.l1 - 1) * min(1.0, len(got) / 5_000)  # few rows support less shrinkage
    return model.fit([(np.frombuffer(slots, "<u4").astype(np.int64), y) for _, _, y, slots in got]).compact()


def score(docs: DataFrame, weights: Weights, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text (a column of that name is replaced).

    A null or empty text has no features, so it scores as the bias alone. Repeated
    rows score alike, other columns play no part, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, make = shared.value.dense(), shared.value.bias, Features()
        for rows in batches:
            m = [margin(table, bias, make(t)) for t in rows.column(rows.schema.names.index("__text")).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.asarray(m, dtype=np.float64), -35, 35)))
            columns = [rows.column(rows.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64())], names=[*kept, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, `{name}` double")

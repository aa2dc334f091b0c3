"""Language ID: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the cosine of their sets of hashed letter n-grams
(1 to 4 letters, presence only). A bounded, documented sample of labelled rows
is learnt from: landmarks span the kernel's approximation, ridge regression per
language is solved in that span. As the kernel is linear in the presence
vectors, landmarks and ridge weights multiply out to one table of hashed
n-grams by languages (fixed size), and a batch of texts is scored by one
sparse-by-dense matrix product.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
NGRAMS = (1, 2, 3, 4)
LETTERS = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), dtype=bool)
UNKNOWN = "und"
WINDOW = 1 << 18


def presence(text: str | None) -> np.ndarray:
    """Sorted hashed n-grams of the text's lower-cased words; empty if it has no letter."""
    mark = np.zeros(BUCKETS, dtype=bool)
    if text:
        for at in range(0, len(text), WINDOW):  # windows overlap, so that no n-gram is lost
            code = np.frombuffer(text[max(0, at - 8) : at + WINDOW + 8].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = LETTERS[code]
            if not letter.any():
                continue
            code = np.where(letter, code, np.uint32(32))[letter | np.concatenate([[True], letter[:-1]])]  # a gap is one blank
            code = np.concatenate([[32], code, [32]]).astype(np.uint64)
            h = np.zeros(len(code), dtype=np.uint64)
            for n in range(1, max(NGRAMS) + 1):
                if len(code) < n:
                    break
                h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
                h += code[n - 1 :]
                h += np.uint64(n)
                if n in NGRAMS:
                    mixed = h >> np.uint64(29)
                    mixed ^= h
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    mixed >>= np.uint64(49)
                    mark[mixed.view(np.int64)] = True
    return np.flatnonzero(mark)


@dataclass
class KernelRidge:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray

    @classmethod
    def fit(cls, marked: list[np.ndarray], langs: list[str], landmarks: int = 300, ridge: float = 1e-2) -> KernelRidge:
        """marked: the presence lists of the texts; only landmarks are held as dense rows."""
        names = sorted(set(langs))
        kept = [(x, y) for x, y in zip(marked, langs, strict=True) if len(x)]
        if not kept:
            return cls(names, np.zeros((BUCKETS, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32))
        chosen = np.unique(np.linspace(0, len(kept) - 1, min(landmarks, len(kept))).astype(int))
        marks = np.zeros((BUCKETS, len(chosen)), dtype=np.float32)
        for j, i in enumerate(chosen.tolist()):
            marks[kept[i][0], j] = 1 / np.sqrt(len(kept[i][0]))
        kernel = np.array([marks[x].sum(axis=0, dtype=np.float64) / np.sqrt(len(x)) for x, _ in kept])  # texts x landmarks
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z1 = np.hstack([kernel @ root, np.ones((len(kept), 1))])
        y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in kept])
        counts = Counter(lang for _, lang in kept)
        share = np.array([1 / counts[lang] for _, lang in kept])  # languages weigh alike
        share *= len(kept) / share.sum()
        gram = (z1 * share[:, None]).T @ z1 + ridge * len(kept) * np.diag([1.0] * (z1.shape[1] - 1) + [1e-6])
        alpha = np.linalg.solve(gram, (z1 * share[:, None]).T @ y)
        return cls(names, (marks @ (root @ alpha[:-1]).astype(np.float32)).astype(np.float32), alpha[-1].astype(np.float32))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) margins, and which texts have letters."""
        ids = [presence(t) for t in texts]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        out = np.zeros((len(texts), len(self.langs)), dtype=np.float64)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([ids[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(sizes[full])[:, None] + self.bias
        return out, sizes > 0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 1000, landmarks: int = 300, max_chars: int = 200_000) -> KernelRidge:
    """Learn from at most max_rows labelled rows: the first by a hash of the text, equally many a language.

    Their texts are hashed on the executors; the driver gets lists of at most BUCKETS
    small numbers. Rows longer than max_chars don't teach; every row is scored whole
    all the same."""
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where(f"l is not null and t is not null and length(t) <= {max_chars}")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row per language
    each = max(1, max_rows // max(1, len(counts)))
    share = F.lit(0)  # of a language's rows, in millionths, twice what is needed on average
    for name, n in counts.items():
        share = F.when(F.col("l") == name, min(1_000_000, 2_000_000 * each // n + 1)).otherwise(share)
    drawn = rows.withColumn("h", F.xxhash64("t")).where(F.pmod("h", F.lit(1_000_000)) < share)
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [presence(t).astype("<u2").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.binary())], names=["h", "l", "marks"])

    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= each).select("h", "l", "t").mapInArrow(run, "h long, l string, marks binary")
    got = sorted((r["h"], bytes(r["marks"]), r["l"]) for r in sample.collect())  # max_rows lists
    return KernelRidge.fit([np.frombuffer(m, "<u2").astype(np.int64) for _, m, _ in got], [n for _, _, n in got], landmarks)


def predict(docs: DataFrame, model: KernelRidge, text: str = "text", pred: str = "lang_pred", score: str = "score", batch: int = 256) -> DataFrame:
    """docs with pred and score (columns of those names are replaced), texts judged whole.

    A null or empty text, or one without a letter, is `und` with score 0. Repeated
    rows get the same result. An empty table stays empty. Score: the winner's share
    of the softmax over margins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages: a fixed size
    kept = [c for c in docs.columns if c not in (pred, score)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                margins, known = model.scores(part.column(part.schema.names.index("__text")).to_pylist())
                if model.langs:
                    e = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
                    best, p = margins.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)
                    names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                else:
                    names, p = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                columns = [part.column(part.schema.names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.where(known, p, 0.0), pa.float64())], names=[*kept, pred, score])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, `{pred}` string, `{score}` double")

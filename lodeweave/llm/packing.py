"""Best-fit packing of token pieces into sequences by minimum bin slack.

1. Every text is tokenised once, in Arrow batches, and cut into pieces; only the
   narrow piece rows are written to the shared folder.
2. Packing needs just the histogram of piece lengths (at most ``capacity``
   numbers, gathered whole). Per bin the largest piece left is fixed and a bitset
   subset-sum over the available lengths finds the fullest feasible rest; the
   combination is removed as often as the counts allow.
3. Pieces meet their places by their rank among equals: the rank within the
   writing task plus an offset per (task, length), so no length, however common,
   meets in one task.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import stash


class Encoder:
    """Ids of a byte-level BPE tokenizer file (JSON), as little-endian uint32 bytes.

    The file's merges are applied by rank, which tiktoken does several times faster
    than the file's own library. With check, it is made sure on the driver that the
    ids are the same: every merge's id must grow with its place in the file, and PROBE
    must give the same ids. Strings of the file's added tokens become their ids."""

    PROBE = "Ab c's don't  12,3 ñandú\u2009x\n\n\tü\u3000漢字 🙂 zz<|endoftext|> <|x|>"

    def __init__(self, path: str, check: bool = False):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens") or ()}
        ranks = {self._bytes(token): n for token, n in vocab.items() if token not in added}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        if check:
            from tokenizers import Tokenizer

            merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
            same = Tokenizer.from_file(path).encode(self.PROBE, add_special_tokens=False).ids == np.frombuffer(self.encode(self.PROBE), "<u4").tolist()
            if not same or merged != sorted(merged):
                raise ValueError(f"{path} isn't a byte-level BPE file whose ids are its merge ranks")

    @staticmethod
    @functools.cache
    def _alphabet() -> dict[str, int]:
        """The printable character that stands for each byte in such files."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

    def _bytes(self, token: str) -> bytes:
        return bytes(map(self._alphabet().__getitem__, token))

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece; task and nth number the pieces of a length within the task that wrote them."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen, task = Encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                ids = (encoder.encode(t) if t else b"") + np.asarray([end_id], "<u4").tobytes()
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((k, i, start, length, crc, task, seen[length]))
                    seen[length] += 1
            frame = pd.DataFrame(out, columns=["k", "piece", "start", "length", "ids_crc32", "task", "nth"])
            frame["k"] = frame["k"].astype(object).where(frame["k"].notna(), None)
            yield frame

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInPandas(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many alike, [(length, pieces of it)]), from pieces per length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    bins = []
    while left:
        top = max(left)
        fill = fullest(left, top, capacity - top)
        chosen: dict[int, int] = {top: 1}
        for n, k in fill:
            chosen[n] = chosen.get(n, 0) + k
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        bins.append((times, sorted(chosen.items(), reverse=True)))
    return bins


def fullest(left: dict[int, int], taken: int, room: int) -> list[tuple[int, int]]:
    """The available lengths (one of `taken` is gone) whose sum comes nearest to room without passing it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted((n for n in left if n <= room), reverse=True):
        available = min(left[n] - (n == taken), room // n)
        k = 1
        while available > 0:  # copies in binary parcels
            k = min(k, available)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            available -= k
            k *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            chosen.append((n, k))
            at -= n * k
    merged: dict[int, int] = {}
    for n, k in chosen:
        merged[n] = merged.get(n, 0) + k
    return list(merged.items())


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, first offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, content in bins:
        offset = 0
        for n, k in content:
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    A null or empty text is one piece of the end id. Repeated rows and null keys
    are packed as rows of their own. Texts of more than capacity ids fill several
    pieces. An empty table gives an empty result. Other columns play no part."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    Encoder(tokenizer, check=True)
    made = stash(pieces(docs, tokenizer, text, key, capacity, end_id), "pack-pieces")
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # bounded by the number of lengths, not by rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = table.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            at = np.searchsorted(rows[:, 0] << 44 | rows[:, 1], length << 44 | rank, side="right") - 1
            _, first, k, sequence, offset = rows[at].T
            batch["sequence_id"] = sequence + (rank - first) // np.maximum(k, 1)
            batch["offset"] = offset + (rank - first) % np.maximum(k, 1) * length
            yield batch.drop(columns="rank")

    ranked = made.join(base, ["task", "length"]).select("k", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = ranked.mapInPandas(place, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)

"""Exact substring removal with a sparse, range-partitioned suffix array.

Every byte covered by a ``length``-byte string that starts at two or more places
goes. Sorting all suffixes would write many times the corpus; a sparse suffix
array needs only suffixes at anchors, and finds the same bytes:

1. A token is the fingerprint of length / 6 bytes. The anchor of a window is its
   place with the least token (the last of equals); it serves the run of
   neighbouring windows whose least token it is. Equal windows have equal anchors
   at equal offsets, so repeats are found among runs with equal leading tokens.
2. Anchors whose leading token occurs once drop out. Runs with equal bytes are
   counted before any text moves: they are repeated whole, and only one
   representative of a class travels, and only to meet different runs.
3. Representatives are range-partitioned by their leading token with sampled
   splitters. A bucket sorts its suffixes, the windows of its runs, by multikey
   quicksort over packed tokens: ties of one token column go on to the next, whose
   tokens are made for them alone. Neighbours whose common prefix is the whole
   window are repeated. Equal leading tokens never straddle these splitters.
4. A leading token with more than ``hot`` different runs would make one bucket
   grow. Its runs are cut into parts by offset; parts that share all bytes, or
   whose common core occurs once, are settled by counting, and only the windows of
   the other parts become rows. These suffixes are range-partitioned too, by all
   tokens and their run, so that the splitters cut through equal ones as well:
   neighbours are compared within a bucket, and the first and last suffix of each
   bucket with those of the others.
5. Repeated windows are merged into runs and gathered as byte intervals per document.

A text over BLOCK_BYTES is read in blocks that overlap by a window.

Fingerprints have 64 bits (128 where rows are counted by key), over bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import discard, join_counted, stash, with_row_id

LENGTH = 400
HOT = 2048
BATCH_BYTES = 1 << 18
BLOCK_BYTES = 1 << 19  # about 80 bytes of arrays each
TOKENS = 4  # packed tokens of a window, after the leading one
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
MIX1, MIX2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(32)
BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the rolling hash's base and of its inverse, as long as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(ODD, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, k, 1 << 64))])


def prefix(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums that give the fingerprint of any substring; data: bytes as uint8."""
    powers.grow(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * powers.up[: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX1
    return (h ^ (h >> SHIFT)) * MIX2


def span(sums: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers.down[start])


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by doubling."""
    k = 1
    while k * 2 <= w:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: len(values) - (w - k)], values[w - k :]) if k < w else values


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int, powers: Powers):
    """(start, left, windows, token, around) of the anchors in texts laid end to end.

    An anchor serves a run of neighbouring windows: those whose least token
    (the last one, where several are least) it is. start: place of the first window;
    left: how far before the anchor it starts; around: fingerprint of the run's bytes."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = prefix(data, powers)
    token = mixed((sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    order = (token & ~low) | (low - np.arange(len(token), dtype=np.uint64))  # among equal tokens the last place is least
    at = (low - (_least(order, length - gram + 1) & low)).astype(np.int64)
    for e in ends[:-1]:  # windows across texts don't count
        at[max(0, e - length + 1) : e] = -1
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    windows = np.diff(np.concatenate([first, [len(at)]]))
    real = at[first] >= 0
    first, windows = first[real], windows[real]
    anchor = at[first]
    left = anchor - first
    around = span(sums, powers, first, first + windows + length - 1) ^ mixed((left * 1_048_576 + windows).astype(np.uint64))
    return first, left, windows, token[anchor], around


PLACES = "rid long, start int, left int, windows int, token long, around long"


def anchor_rows(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """PLACES of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def flush(rids, parts, base=0):
            ends = np.cumsum([len(p) for p in parts])
            start, left, windows, token, around = anchors(np.frombuffer(b"".join(parts), np.uint8), ends, length, gram, powers)
            k = np.searchsorted(ends, start, side="right")
            start = start - np.concatenate([[0], ends[:-1]])[k] + base
            columns = [np.asarray(rids, np.int64)[k], start.astype(np.int32), left.astype(np.int32), windows.astype(np.int32), token.view(np.int64), around.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in PLACES.split(", ")])

        for b in batches:
            rids, parts, size = [], [], 0
            for rid, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(t.as_buffer()) if t.is_valid else b""
                if len(data) > BLOCK_BYTES:
                    for at in range(0, len(data) - length + 1, BLOCK_BYTES):
                        yield flush([rid], [data[at : at + BLOCK_BYTES + length - 1]], at)
                elif len(data) >= length:
                    rids.append(rid)
                    parts.append(data)
                    size += len(data)
                if size >= BATCH_BYTES:
                    yield flush(rids, parts)
                    rids, parts, size = [], [], 0
            if parts:
                yield flush(rids, parts)

    return docs.select("__rid", F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, PLACES)


def _runs(good: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of a boolean array as (first, last) offsets."""
    edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def multikey_ties(lead: np.ndarray, column, depth: int) -> np.ndarray:
    """Rows whose leading token and depth further tokens all equal those of a neighbour in sorted order.

    column(d, rows) makes token d of the rows that are still tied. A stretch of ties
    is ordered by its next token before the one after that is looked at, as in
    multikey quicksort; all stretches of a depth are ordered at once."""
    rows = np.argsort(lead, kind="stable")
    edge = np.concatenate([[True], lead[rows[1:]] != lead[rows[:-1]]]) if len(rows) else np.zeros(0, bool)
    for d in range(depth + 1):
        alone = edge & np.concatenate([edge[1:], [True]]) if len(edge) else edge
        rows, stretch = rows[~alone], np.cumsum(edge)[~alone]
        if d == depth or not len(rows):
            return rows
        token = column(d, rows)
        order = np.lexsort((token, stretch))
        rows, stretch, token = rows[order], stretch[order], token[order]
        edge = np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (token[1:] != token[:-1])])
    return rows


def window_tokens(text: bytes, windows: int, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Two token columns of a run's windows: their first and second half."""
    sums = prefix(np.frombuffer(text, np.uint8), powers)
    start = np.arange(windows)
    half = start + length // 2
    return span(sums, powers, start, half), span(sums, powers, half, start + length)


def repeated_in_bucket(rows: list[tuple[int, int, int, bytes]], length: int, powers: Powers) -> list[tuple[list[int], list[int]]]:
    """For (leading token, left, windows, text) rows: runs of the windows that another row of the token has at the same offset."""
    token, left, windows, texts = zip(*rows, strict=True)
    sums = prefix(np.frombuffer(b"".join(texts), np.uint8), powers)
    windows = np.array(windows)
    until = np.cumsum(windows)
    row = np.repeat(np.arange(len(rows)), windows)
    nth = np.arange(until[-1]) - (until - windows)[row]
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])[row] + nth
    offset = (np.array(left)[row] - nth).astype(np.uint64)
    lead = mixed(np.array(token, dtype=np.int64).view(np.uint64)[row] + offset * MIX1)
    cuts = np.linspace(0, length, TOKENS + 1).astype(int)
    good = np.zeros(len(start), dtype=bool)
    good[multikey_ties(lead, lambda d, r: span(sums, powers, start[r] + cuts[d], start[r] + cuts[d + 1]), TOKENS)] = True
    return [_runs(part) for part in np.split(good, until[:-1])]


FOUND = "token long, around long, first array<int>, last array<int>"


def _found(rows) -> pa.RecordBatch:
    token, around, first, last = zip(*rows, strict=True)
    kind = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(around, pa.int64()), pa.array(first, kind), pa.array(last, kind)], names=["token", "around", "first", "last"])


AROUND = "token long, around long, left int, windows int, n long, many long, text binary"
AROUND_NAMES = [x.split()[0] for x in AROUND.split(", ")]
BUCKET_ROWS = 2048


def _surroundings(length: int):
    """Arrow function over rows (packed text, [places]): AROUND rows, the bytes of each place's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        unpack = zstandard.ZstdDecompressor()

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=AROUND_NAMES)

        for b in batches:
            out = []
            for z, places in zip(b.column(0), b.column(1), strict=True):
                data = unpack.decompress(z.as_py())
                for p in places.as_py():
                    at, w = p["start"], p["windows"]
                    out.append((p["token"], p["around"], p["left"], w, p["n"], p["many"], data[at : at + w + length - 1]))
                    if len(out) >= 4096:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return run


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """docs with __z, the text's compressed bytes, for text: shuffles move less."""
    names = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [pack.compress(t.as_buffer().to_pybytes()) if t.is_valid else None for t in b.column(b.schema.names.index("__bytes"))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in names), pa.array(z, pa.binary())], names=[*names, "__z"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("binary").alias("__bytes"))
    return rows.mapInArrow(run, f"{fields}, __z binary")


def _bucket(length: int):
    """Arrow function over AROUND rows sorted by token: FOUND rows of those that stand for one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), []

        def flush(rows):
            sets = repeated_in_bucket([(t, left, w, text) for t, _, left, w, n, text in rows], length, powers)
            found = [(r[0], r[1], *s) for r, s in zip(rows, sets, strict=True) if r[4] == 1 and s[0]]
            return [_found(found)] if found else []

        for b in batches:
            held += zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("token", "around", "left", "windows", "n", "text")), strict=True)
            while len(held) > BUCKET_ROWS:  # whole groups only; a group has at most `hot` rows
                cut = next((i for i in range(BUCKET_ROWS, len(held)) if held[i][0] != held[i - 1][0]), None)
                if cut is None:
                    break
                yield from flush(held[:cut])
                held = held[cut:]
        if held:
            yield from flush(held)

    return run


PARTS = "token long, around long, n long, part int, lo int, hi int, core long, whole long"


def _parts(length: int, width: int):
    """Arrow function over AROUND rows: PARTS rows, a run's windows by offset in groups of width.

    core: fingerprint of the bytes that all windows of the part share; whole: of all bytes of those that the run has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            out = []
            for token, around, n, left, w, text in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("token", "around", "n", "left", "windows", "text")), strict=True):
                sums = prefix(np.frombuffer(text, np.uint8), powers)
                part = np.arange((left - w + 1) // width, left // width + 1)
                lo = np.maximum(0, left - (part * width + width - 1))  # windows count from the run's start, offsets down from left
                hi = np.minimum(w - 1, left - part * width)
                core_lo, core_hi = left - part * width, left - (part * width + width - 1) + length
                core = span(sums, powers, core_lo, core_hi)
                whole = span(sums, powers, lo, hi + length) ^ mixed(((left - lo) * 1_048_576 + hi - lo).astype(np.uint64))
                out.append((np.full(len(part), token), np.full(len(part), around), np.full(len(part), n), part, lo, hi, core.view(np.int64), whole.view(np.int64)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    return run


WINDOWS = "token long, around long, n long, i int, o int, x long, y long"
NAMES = [c.split()[0] for c in WINDOWS.split(", ")]


def _window_rows(length: int):
    """Arrow function over AROUND rows with parts (array of structs lo, hi): a WINDOWS row per window of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for token, around, n, left, w, text, parts in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("token", "around", "n", "left", "windows", "text", "parts")), strict=True):
                x, y = window_tokens(text, w, length, powers)
                i = np.unique(np.concatenate([np.arange(p["lo"], p["hi"] + 1, dtype=np.int32) for p in parts]))
                columns = [np.full(len(i), token), np.full(len(i), around), np.full(len(i), n), i, (left - i).astype(np.int32), x[i].view(np.int64), y[i].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=NAMES)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted WINDOWS rows of a bucket: the same rows with tied (a neighbour is equal) and edge (first or last of the bucket)."""

    def marked(columns, before, after, first, last):
        n = len(columns[0])
        key = np.stack([columns[NAMES.index(c)] for c in ("token", "o", "x", "y")])
        equal = (key[:, 1:] == key[:, :-1]).all(axis=0)
        tied = np.concatenate([[before], equal]) | np.concatenate([equal, [after]])
        edge = np.zeros(n, bool)
        edge[0] |= first
        edge[-1] |= last
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(tied), pa.array(edge)], names=[*NAMES, "tied", "edge"])

    held, before, first = None, False, True  # the last row so far, whether it equals the one before it, whether it is the bucket's first
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.names.index(c)).to_numpy() for c in NAMES]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        same = len(columns[0]) > 1 and all(columns[NAMES.index(c)][-1] == columns[NAMES.index(c)][-2] for c in ("token", "o", "x", "y"))
        if len(columns[0]) > 1:
            yield marked([c[:-1] for c in columns], before, same, first, False)
            before, first = same, False
        held = [c[-1:] for c in columns]
    if held is not None:
        yield marked(held, before, False, first, True)


def _again(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The WINDOWS rows that another row equals in token, offset and text; and what they are read from."""
    names = windows.columns
    windows = stash(windows, "windows")  # sampling the splitters reads them twice
    dealt = windows.repartitionByRange("token", "o", "x", "y", "around").sortWithinPartitions("token", "o", "x", "y", "around")
    made = stash(dealt.mapInArrow(_neighbours, f"{WINDOWS}, tied boolean, edge boolean").where("tied or edge"), "neighbours")
    discard(windows)
    edges = made.where("edge")  # two rows a bucket
    across = edges.groupBy("token", "o", "x", "y").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return made.where("tied").select(*names).union(edges.where("not tied").join(F.broadcast(across), ["token", "o", "x", "y"], "left_semi").select(*names)), made


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (token, around, pieces: array of structs lo, hi): FOUND rows, neighbouring pieces merged."""
    for b in batches:
        out = []
        for token, around, pieces in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            good = np.zeros(max(p["hi"] for p in pieces) + 1, dtype=bool)
            for p in pieces:
                good[p["lo"] : p["hi"] + 1] = True
            out.append((token, around, *_runs(good)))
        if out:
            yield _found(out)


def _hot_found(rows: DataFrame, length: int, width: int) -> DataFrame:
    """FOUND rows of hot tokens: parts of runs first, windows only where a part's core is shared and its bytes are not."""
    parts = stash(rows.mapInArrow(_parts(length, width), PARTS), "parts")
    cores = parts.groupBy("token", "part", "core").agg(F.count("*").alias("c")).where("c > 1")
    cored = stash(join_counted(parts, cores, ["token", "part", "core"], "c"), "shared-cores")
    wholes = cored.groupBy("token", "part", "whole").agg(F.count("*").alias("c"), F.min("around").alias("one"))
    shared = stash(join_counted(cored, wholes.withColumn("alone", F.col("c") == 1), ["token", "part", "whole"], "c"), "shared-parts")
    discard(parts, cored)
    same = shared.where("not alone and n = 1").select("token", "around", "lo", "hi")
    looked = shared.where("alone or one = around").groupBy("token", "around").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))  # a few parts a run
    windows = rows.join(looked, ["token", "around"]).mapInArrow(_window_rows(length), WINDOWS)
    again, made = _again(windows)
    pieces = same.union(again.where("n = 1").select("token", "around", F.col("i").alias("lo"), F.col("i").alias("hi")))
    lists = pieces.groupBy("token", "around").agg(F.collect_list(F.struct("lo", "hi")).alias("pieces"))  # a run's windows and parts at most
    found = stash(lists.mapInArrow(_joined, FOUND), "hot-found")
    discard(shared, made)
    return found


def repeated(docs: DataFrame, packed: DataFrame, text: str, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(__rid, spans array<struct<lo, hi>>): byte intervals (hi excluded, unmerged) of docs' repeated strings."""
    if length < 8:
        raise ValueError("the length must be at least 8 bytes")
    gram, width = max(4, length // 6), max(1, length // 20)
    places = stash(anchor_rows(docs, text, length, gram), "anchors")
    twice = places.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    busy = stash(join_counted(places, twice, ["token"], "c"), "busy-anchors")
    discard(places)
    classes = busy.groupBy("token", "around").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start", "left", "windows")).alias("at"))
    classes = stash(classes.select("token", "around", "n", "at.*"), "anchor-classes")
    several = classes.groupBy("token").agg(F.count("*").alias("many"), F.count_if(F.col("n") == 1).alias("alone")).where("many > 1 and alone > 0")
    several = several.select("token", F.col("many").alias("c"), "many")
    lists = join_counted(classes, several, ["token"], "c").groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("token", "around", "start", "left", "windows", "n", "many")).alias("places"))  # bounded by the text
    around = packed.select("__rid", "__z").join(lists, "__rid").select("__z", "places").mapInArrow(_surroundings(length), AROUND)
    around = stash(around, "surroundings")
    usual = around.where(F.col("many") <= hot).repartitionByRange("token").sortWithinPartitions("token")
    parts = [stash(usual.mapInArrow(_bucket(length), FOUND), "found")]
    hot_rows = around.where(F.col("many") > hot)
    if not hot_rows.isEmpty():
        parts.append(_hot_found(hot_rows, length, width))
    discard(around)
    found = reduce(DataFrame.union, parts)
    whole = classes.where("n > 1").select("token", "around", "n", F.array(F.lit(0)).alias("first"), F.array(F.col("windows") - 1).alias("last"))
    again = join_counted(busy, whole, ["token", "around"], "n")
    once = busy.join(found, ["token", "around"]).select(*again.columns)  # runs that occur once: no class has two rows
    bytes_of = F.transform(F.arrays_zip(F.col("first").alias("a"), F.col("last").alias("b")), lambda s: F.struct((F.col("start") + s["a"]).alias("lo"), (F.col("start") + s["b"] + length).alias("hi")))
    spans = again.union(once).select(F.col("rid").alias("__rid"), bytes_of.alias("s"))
    spans = stash(spans.groupBy("__rid").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")  # bounded by the text
    discard(busy, classes, *parts)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in spans:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def passages(data: bytes, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """The spans that hold at least min_words words, cut ones included."""
    return [(lo, hi) for lo, hi in spans if len(data[lo:hi].split()) >= min_words] if min_words else spans


def _fragments(length: int):
    """Arrow function over rows (__rid, packed text, spans): (rid, base, text) of merged intervals of at least length bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for rid, z, spans in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    long = [(lo, hi) for lo, hi in merged(spans) if hi - lo >= length]
                    data = unpack.decompress(z) if long else b""
                    out += [(rid, lo, data[lo:hi]) for lo, hi in long]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["rid", "base", "text"])

    return run


PASSAGE_BYTES, PASSAGE_WORDS = 200, 50


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, hot: int = HOT, passage_bytes: int = PASSAGE_BYTES, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes) of every row.

    passage_bytes: bytes in repeated passages of at least passage_words words, made of
    strings of passage_bytes bytes that recur; n_passages: how many. A repeated string
    of length bytes lies within intervals of the shorter ones, so these are looked for
    first and only such intervals of at least length bytes are searched for it."""
    short = min(passage_bytes, length)
    rows = with_row_id(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")))
    packed = _packed(rows, text)
    coarse = repeated(rows, packed.select("__rid", "__z"), text, short, hot)
    cut = packed.select("__rid", "__z").join(coarse, "__rid").mapInArrow(_fragments(length), "rid long, base int, text binary")
    cut = with_row_id(cut)
    fine = repeated(cut, _packed(cut.select("__rid", "text"), "text"), "text", length, hot).join(cut.select("__rid", "rid", "base"), "__rid")
    fine = stash(fine.select("rid", "base", "spans"), "fine-spans")
    discard(cut)
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("base")).alias("lo"), (s["hi"] + F.col("base")).alias("hi")))
    fine = fine.groupBy(F.col("rid").alias("__rid")).agg(F.flatten(F.collect_list(moved)).alias("spans"))  # bounded by the text
    joined = packed.join(coarse.withColumnRenamed("spans", "coarse"), "__rid", "left").join(fine, "__rid", "left")
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, less, more in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = unpack.decompress(z) if z is not None else b""
                spans, long = merged(more), passages(data, merged(less), passage_words)
                kept = kept_bytes(data, spans)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(long), sum(hi - lo for lo, hi in long)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*out, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"])

    return joined.select(F.col(f"`{key}`"), "__z", "coarse", "spans").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


def clean(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT, min_words: int = 0) -> DataFrame:
    """docs with repeated passages cut from text; characters of which some bytes went go whole.

    A null text stays null; texts under length bytes lose nothing. Strings are judged
    on the input: of equal passages every copy goes, within one text too. With
    min_words, passages with fewer words stay. Repeated rows are separate texts, so
    they remove each other. An empty table stays empty."""
    rows = with_row_id(docs)
    packed = _packed(rows, text)
    joined = packed.join(repeated(rows, packed.select("__rid", "__z"), text, length, hot), "__rid", "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                column = lambda c: part.column(part.schema.names.index(c))
                made = []
                for z, spans in zip(column("__z"), column("spans").to_pylist(), strict=True):
                    data = unpack.decompress(z.as_py()) if z.is_valid else None
                    cut = passages(data, merged(spans), min_words) if data else []
                    made.append(kept_bytes(data, cut).decode("utf-8", "ignore").encode() if cut else data)
                texts = pa.array(made, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == text else column(c) for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    return joined.select("__z", "spans", *[F.col(f"`{c}`") for c in others]).mapInArrow(run, fields)

"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question whose
parameters were changed keeps its template. Windows of template tokens are
hashed; documents' windows pass a fixed-size bit filter made from the
benchmark's windows and the rest meet the benchmark by a hash join. A capitalised
word that begins a sentence is read both as a word and as a name. Windows on one
diagonal of a (document, item) pair are slot-checked one by one: a verbatim window
counts, and so does one whose slot values all follow the diagonal's replacements.
A value of the item is replaced by what stands for it at most of its places; two
values may be replaced by the same one. Windows with too few words for a template
are hashed by their literal tokens, so that exact copies of them still meet. A
document is contaminated by an item when such windows cover at least
``min_coverage`` of the item's windows, or of those that have a template.
"""

from __future__ import annotations

import itertools
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeweave.llm.common import with_row_id

WINDOW = 6
FILTER_BITS = 22
LEAST_TOKENS = 2  # an item of one token would match every text that has the word
BROADCAST_WINDOWS = 500_000  # windows of a benchmark that go to every executor; more are dealt by hash
MARK = "\0"  # before a word that begins a sentence
TOKEN = re.compile(r"\0?[^\W\d_]+|\d+(?:[.,:/]\d+)*")
SENTENCE = re.compile(r"(?:\A|[.!?:;\n])\W*(?=[^\W\d_])")


def _listed(pattern: re.Pattern, last: int) -> re.Pattern:
    """The same pattern with its letters up to last listed as ranges, which are matched faster than a negated class."""
    ranges: list[list[int]] = []
    for m in re.finditer(r"[^\W\d_]", "".join(map(chr, range(last + 1)))):
        if ranges and ranges[-1][1] == m.start() - 1:
            ranges[-1][1] = m.start()
        else:
            ranges.append([m.start(), m.start()])
    return re.compile(pattern.pattern.replace(r"[^\W\d_]", "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges) + "]"))


ASCII_TOKEN, NEAR_TOKEN = _listed(TOKEN, 0x7F), _listed(TOKEN, 0xFFFF)


def tokens_of(text: str) -> list[str]:
    """The matches of TOKEN."""
    if text.isascii():
        return ASCII_TOKEN.findall(text)
    near = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)  # no character beyond 0xFFFF
    return (NEAR_TOKEN if near else TOKEN).findall(text)


UNITS = frozenset(
    "mg g kg t mm cm m km in ft yd mi ml l oz lb lbs percent cents dollars dollar euros euro pounds pound "
    "second seconds minute minutes hour hours day days week weeks month months year years miles mile meters "
    "metres meter metre feet foot inches inch liters litres liter litre grams gram kilograms kilogram degrees".split()
)
NUMBER, NAME, UNIT = 11, 12, 13  # codes of the placeholders
INITIAL = 1 << 40  # set in the code of a marked word
WORDS_CACHED = 300_000
LITERAL = 1 << 50  # sets hashes of literal windows apart
STRETCH = 16_384  # windows read at a time, as a window has up to 2**WINDOW readings
SPREAD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def _part(codes: np.ndarray) -> np.ndarray:
    return codes ^ (codes >> np.uint64(7))


def _literal(token: str) -> int:
    return zlib.crc32(token.lstrip(MARK).lower().encode("utf-8", "surrogatepass")) * 2 + 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


class _Known(dict):
    """Codes of tokens, made when they are first asked for."""

    def __missing__(self, token: str) -> int:
        if token[0].isdigit():
            code = NUMBER
        elif token[0].isupper():
            code = NAME
        else:  # the low bit marks what is a unit after a number
            code = _literal(token) + (token.lstrip(MARK).lower() in UNITS)
            if token[0] == MARK and token[1].isupper():
                code += INITIAL
        self[token] = code
        return code


class Templates:
    """Template codes and window hashes of texts."""

    def __init__(self) -> None:
        self.known = _Known()

    def codes(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens, their codes, and which of them begin a sentence with a capital, so that they may be names."""
        tokens, known = tokens_of(SENTENCE.sub(rf"\g<0>{MARK}", text.replace(MARK, "\1"))) if text else [], self.known
        if len(known) > WORDS_CACHED:
            known.clear()
        codes = np.array(operator.itemgetter(*tokens)(known) if tokens else (), dtype=np.uint64).reshape(len(tokens))
        initial = codes >= INITIAL
        codes &= np.uint64(INITIAL - 1)
        after = np.zeros(len(codes), dtype=bool)
        after[1:] = codes[:-1] == NUMBER
        return tokens, np.where(after & (codes >= 64) & (codes & np.uint64(1) == 1), np.uint64(UNIT), codes), initial

    @staticmethod
    def readings(tokens: list[str], codes: np.ndarray, initial: np.ndarray, n: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, hashes, names) of the readings of windows of n codes, some windows at a time.

        Bit k of names is set where token k, which begins a sentence, is read as a name. Where fewer
        than half the codes of a reading are words, the literal tokens are hashed and names is -1."""
        for start in range(0, len(codes) - n + 1 if n else 0, STRETCH):
            size = min(STRETCH, len(codes) - n + 1 - start)
            part, word = _part(codes[start : start + size + n - 1]), codes[start : start + size + n - 1] >= 64
            first = initial[start : start + size + n - 1]
            at, h, words, names = np.arange(size), np.full(size, n, dtype=np.uint64), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
            for k in range(n):
                h += part[k : k + size] * SPREAD[k]
                words += word[k : k + size]
            if first.any():
                change, less = _part(np.uint64(NAME)) - part, word.astype(np.int32)
                until = np.concatenate([[0], np.cumsum(first)])
                more = np.flatnonzero(until[n:] > until[:size])
                a, b, c, d = at[more], h[more], words[more], names[more]
                for k in range(n):
                    pick = np.flatnonzero(first[a + k])
                    if len(pick):
                        x = a[pick] + k
                        a, b = np.concatenate([a, a[pick]]), np.concatenate([b, b[pick] + change[x] * SPREAD[k]])
                        c, d = np.concatenate([c, c[pick] - less[x]]), np.concatenate([d, d[pick] | (1 << k)])
                at, h = np.concatenate([at, a[len(more) :]]), np.concatenate([h, b[len(more) :]])
                words, names = np.concatenate([words, c[len(more) :]]), np.concatenate([names, d[len(more) :]])
            good = words * 2 >= n
            if good.all():
                yield at + start, _mixed(h), names
                continue
            bare = np.unique(at[~good])
            used = np.unique(bare[:, None] + np.arange(n))
            part = np.zeros(size + n - 1, dtype=np.uint64)
            part[used] = _part(np.array([_literal(tokens[start + i]) for i in used.tolist()], dtype=np.uint64))
            literal = np.full(len(bare), LITERAL + n, dtype=np.uint64)
            for k in range(n):
                literal += part[bare + k] * SPREAD[k]
            places, found = np.concatenate([at[good], bare]), np.concatenate([h[good], literal])
            yield places + start, _mixed(found), np.concatenate([names[good], np.full(len(bare), -1, dtype=np.int32)])

    @staticmethod
    def slots(codes: np.ndarray, at: int, n: int, names: int) -> list[int]:
        """Places of what isn't a plain word in a reading; all of a literal window."""
        return [i for i in range(at, at + n) if codes[i] < 64 or names >> (i - at) & 1]


COLUMNS = "h long, n int, pos int, places array<int>, slots array<string>"
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]


def _rows(key, tokens, codes, n, at, h, names) -> Iterator[tuple]:
    for where, value, read in zip(at.tolist(), h.astype(np.int64).tolist(), names.tolist(), strict=True):
        places = Templates.slots(codes, where, n, read)
        yield key, value, n, where, places, [tokens[i].lstrip(MARK).lower() for i in places]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], cap: int = 20_000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, cap)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def _laid_end_to_end(batches: Iterator[pa.RecordBatch], make: Templates) -> Iterator[tuple]:
    """(keys, tokens, codes, initial, owner, starts) of texts together, about STRETCH tokens at a time; owner: the text of each token."""
    held, size = [], 0

    def laid():
        keys, tokens, codes, initial = zip(*held, strict=True)
        sizes = np.array([len(c) for c in codes])
        return keys, list(itertools.chain.from_iterable(tokens)), np.concatenate(codes), np.concatenate(initial), np.repeat(np.arange(len(held)), sizes), (np.cumsum(sizes) - sizes).tolist()

    for b in batches:
        for *key, t in zip(*(c.to_pylist() for c in b.columns[:-1]), b.columns[-1], strict=True):
            held.append((key, *make.codes(t.as_py())))
            size += len(held[-1][1])
            if size >= STRETCH:
                yield laid()
                held, size = [], 0
    if held:
        yield laid()


def item_windows(items: DataFrame, text: str, key: str) -> DataFrame:
    """Windows of every benchmark item; an item of fewer than WINDOW tokens is one window of its own length."""
    kind = dict(items.dtypes)[key]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        make = Templates()
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens, codes, initial = make.codes(t)
            n = min(len(codes), WINDOW) if len(codes) >= LEAST_TOKENS else 0
            found = list(make.readings(tokens, codes, initial, n))
            worded = {place for at, _, names in found for place in at[names >= 0].tolist()}
            for part in found:
                for row in _rows(k, tokens, codes, n, *part):
                    yield *row, len(codes) - n + 1, len(worded), row[3] in worded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(rows(b), ["k", "h", "n", "pos", "places", "slots", "windows", "worded", "has_words"], [b.schema.field(0).type, *KINDS, pa.int32(), pa.int32(), pa.bool_()])

    return items.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"k {kind}, {COLUMNS}, windows int, worded int, has_words boolean")


def consistent(hits: list[dict]) -> list[dict]:
    """The hits of one diagonal, {pos, slots: [{p, a, b}]}, that are verbatim or follow its replacements.

    p is the place in the item, a the item's value there and b the document's. A replacement
    of a is what stands at more than half of the places of a."""
    stands = {s["p"]: (s["a"], s["b"]) for hit in hits for s in hit["slots"]}
    pairs, places = Counter(stands.values()), Counter(a for a, _ in stands.values())
    follows = {(a, b) for (a, b), times in pairs.items() if times * 2 > places[a]}
    return [hit for hit in hits if all(s["a"] == s["b"] for s in hit["slots"]) or all((s["a"], s["b"]) in follows for s in hit["slots"])]


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", row: str = "__rid", item_text: str = "text", item_key: str = "item_id", label: str | None = None, min_coverage: float = 0.4) -> DataFrame:
    """(row, label, item, windows, matched, first_pos): the pairs found, by the document's row number and its value of the label column.

    Null, empty and too short texts match nothing; an item without words matches
    its exact copies only, however short it is, if it has LEAST_TOKENS tokens. Ties don't
    arise: every pair that reaches min_coverage is given. windows and matched count all places of
    the item, whether they have a template or not. Texts of any length are read whole. Repeated items, rows or windows
    are judged each for itself. Empty tables give no pairs."""
    spark = docs.sparkSession
    windows = item_windows(items, item_text, item_key).persist()
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    found = windows.groupBy("n", slot.alias("s")).agg(F.lit(1)).collect()  # at most WINDOW x 2**FILTER_BITS, whatever the benchmark's size
    bits: dict[int, np.ndarray] = {}
    for r in found:
        bits.setdefault(r["n"], np.zeros(1 << FILTER_BITS, dtype=bool))[r["s"]] = True
    shared = spark.sparkContext.broadcast({n: np.packbits(b) for n, b in bits.items()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        make, tables = Templates(), {n: np.unpackbits(b).astype(bool) for n, b in sorted(shared.value.items())}
        for keys, tokens, codes, initial, owner, starts in _laid_end_to_end(batches, make):
            for n, table in tables.items():
                for at, h, names in make.readings(tokens, codes, initial, n):
                    hit = np.flatnonzero(table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    hit = hit[owner[at[hit]] == owner[at[hit] + n - 1]]  # windows don't cross texts
                    for who, row in zip(owner[at[hit]].tolist(), _rows(None, tokens, codes, n, at[hit], h[hit], names[hit]), strict=True):
                        yield *keys[who], *row[1:3], row[3] - starts[who], *row[4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), ["k", "label", "h", "n", "pos", "places", "slots"], [pa.int64(), kinds["label"], *KINDS])

    asked = docs.select(F.col(f"`{row}`").alias("k"), (F.col(f"`{label}`") if label else F.lit(0)).alias("label"), F.col(f"`{text}`").alias("t"))
    kinds = {f.name: to_arrow_type(f.dataType) for f in asked.schema}
    hits = asked.mapInArrow(run, f"k long, label {dict(asked.dtypes)['label']}, {COLUMNS}").drop("places")
    few = windows.count() <= BROADCAST_WINDOWS
    d, i = hits.alias("d"), (F.broadcast(windows) if few else windows).alias("i")
    pairs = d.join(i, (F.col("d.h") == F.col("i.h")) & (F.col("d.n") == F.col("i.n")) & (F.size("d.slots") == F.size("i.slots"))).select(
        F.col("d.k").alias("row"), F.col("d.label").alias("label"), F.col("i.k").alias("item"), (F.col("d.pos") - F.col("i.pos")).alias("diagonal"), F.col("i.windows").alias("windows"), F.col("i.worded").alias("worded"), F.col("i.pos").alias("pos"), F.col("i.has_words").alias("has_words"),
        F.arrays_zip(F.col("i.places").alias("p"), F.col("i.slots").alias("a"), F.col("d.slots").alias("b")).alias("slots"),
    )
    lines = pairs.groupBy("row", "item", "diagonal").agg(
        F.first("label").alias("label"), F.first("windows").alias("windows"), F.first("worded").alias("worded"), F.collect_set(F.struct("pos", "has_words", "slots")).alias("hits")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [consistent(hits.as_py()) for hits in b.column(6)]
            places = [sorted({hit["pos"] for hit in hits}) for hits in found]
            templates = [sorted({hit["pos"] for hit in hits if hit["has_words"]}) for hits in found]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(places, kind), pa.array(templates, kind)], names=["row", "label", "item", "diagonal", "windows", "worded", "places", "templates"])

    item_kind, label_kind = dict(items.dtypes)[item_key], dict(asked.dtypes)["label"]
    judged = lines.select("row", "label", "item", "diagonal", "windows", "worded", "hits").mapInArrow(judge, f"row long, label {label_kind}, item {item_kind}, diagonal int, windows int, worded int, places array<int>, templates array<int>")
    together = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    best = judged.where(F.size("places") > 0).groupBy("row", "item").agg(
        F.first("label").alias("label"), F.first("windows").alias("windows"), F.first("worded").alias("worded"), together("places").alias("matched"), together("templates").alias("templates"),
        F.min(F.col("diagonal") + F.col("places")[0]).alias("first_pos"),
    )
    enough = (F.col("matched") >= F.col("windows") * min_coverage) | ((F.col("worded") > 0) & (F.col("templates") >= F.col("worded") * min_coverage))
    return best.where(enough).select("row", "label", "item", "windows", "matched", "first_pos")


def report(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """(key, item_id, windows, matched, first_pos) of contaminated documents, a row per pair; clean ones don't appear."""
    rows = docs.select(F.monotonically_increasing_id().alias("__rid"), F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))  # read once: numbers need not last
    found = contaminated(rows, items, "__text", label="__key", **more)
    return found.select(F.col("label").alias(key), F.col("item").alias("item_id"), "windows", "matched", "first_pos")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **more) -> DataFrame:
    """docs without the contaminated rows."""
    rows = with_row_id(docs)
    found = contaminated(rows, items, text, **more).select(F.col("row").alias("__rid")).distinct()
    return rows.join(found, "__rid", "left_anti").drop("__rid")

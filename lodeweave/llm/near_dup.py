"""Near-duplicate detection: SetSketch registers, banding, likelihood estimate, exact verification.

A document is the set of its word shingles (hashed to 64 bits). Documents with
equal sets are one class and go on as one representative. A sketch has REGISTERS
registers; each is the exponentially spaced, truncated minimum of one hash over
the set, so sketches merge by register-wise maximum and two registers agree with
a probability of the Jaccard similarity or slightly more. Bands of ROWS registers
propose candidates: two sets of similarity s meet in no band with probability
(1 - s**ROWS)**BANDS, 2e-9 at 0.8.

No group is expanded into pairs. In each bucket every member is first compared
with one centre. Verified links merge components, and only buckets whose members
are still in different components go on: blocks of members meet blocks of centres
as packed registers and signatures, and only likely pairs become rows. Buckets of
at most SMALL members (a constant) settle at once. In larger ones members outside
the main component first look for it, with the NEAREST of CENTERS random centres,
for as long as that links many of them; then these buckets settle too: all
members outside the main component are centres. So every two members of a bucket
end connected or compared. A pair is dropped only beyond six standard errors of
the registers' maximum-likelihood estimate, given both sizes, or of the share of
common values among the least SIGNATURE of both sets; the rest is confirmed on the
full sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import discard, small_batches, stash, with_row_id
from lodeweave.llm.components import components

BANDS, ROWS = 39, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
SMALL = 32
CENTERS = 64
BLOCK = 256
SIGNATURE = 512
SEARCHES, NEAREST = 3, 3
WORDS_CACHED = 300_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.Generator(np.random.PCG64(20240607))
MASKS = _SEED.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
FACTORS = _SEED.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Known(dict):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of n words.

    A-Z are lower-cased; words are runs without blanks or the controls from tab to
    carriage return. Fewer than n words make one shingle, none make the empty set."""

    def __init__(self, n: int):
        self.n, self.known = n, _Known()

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = text.encode("utf-8", "surrogatepass").lower().split() if text else [], self.known
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(known) > WORDS_CACHED:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n if n < self.n else 0, dtype=np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * PRIME
            out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Register values of a non-empty set."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFF), dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        x = (shingles[None, at : at + 512] ^ MASKS[:, None]) * FACTORS[:, None]
        np.minimum(least, (x >> np.uint64(32)).min(axis=1), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)) + 30000, 0, TOP).astype("<u2")


GRID = np.linspace(0.005, 0.995, 100)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of sketch rows, given the sets' sizes.

    A larger register on one side means that the union's minimum is a shingle that
    only this side has; equal registers mean a common one."""
    same, more, less = (a == b).sum(1), (a > b).sum(1), (a < b).sum(1)
    na, nb = na[:, None].astype(float), nb[:, None].astype(float)
    common = np.minimum(GRID * (na + nb) / (1 + GRID), np.minimum(na, nb))
    union = na + nb - common
    part = lambda x: np.log(np.maximum(x / union, 1e-9))
    like = same[:, None] * part(common) + more[:, None] * part(na - common) + less[:, None] * part(nb - common)
    return GRID[like.argmax(axis=1)]


def sketches(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(__rid, n, fp, sketch): set size, fingerprint of the set, registers as bytes (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for b in batches:
            n, fp, regs = [], [], []
            for t in b.column(1).to_pylist():
                s = make(t)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary())], names=["__rid", "n", "fp", "sketch"])

    return docs.select("__rid", F.col(f"`{text}`").alias("t")).mapInArrow(run, "__rid long, n long, fp binary, sketch binary")


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v, nu, nv, su, sv) whose estimate reaches least, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = [np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(b.num_rows, -1) for i in (4, 5)]
                good = estimate(*regs, b.column(2).to_numpy(), b.column(3).to_numpy()) >= least
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], names=["u", "v"])

    return pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


def signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """(rep, sig) for (__rid, t): the upper halves of the least SIGNATURE hashes of the set, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for b in batches:
            sigs = [np.unique((make(t)[:SIGNATURE] >> np.uint64(32)).astype("<u4")).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary())], names=["rep", "sig"])

    return texts.select("__rid", "t").mapInArrow(run, "rep long, sig binary")


def _may_reach(a: np.ndarray, b: np.ndarray, whole: bool, percent: int) -> bool:
    """Whether sets with these signatures may have the similarity; whole: the signatures hold the sets.

    Four hashes a pair may meet in their upper halves by chance."""
    slack, margin = 4, 0.0
    common = np.intersect1d(a, b, assume_unique=True)
    union = len(a) + len(b) - len(common)
    if not whole and union > SIGNATURE:
        last = np.partition(np.union1d(a, b), SIGNATURE - 1)[SIGNATURE - 1]
        common, union = common[common <= last], SIGNATURE
    if not whole:
        margin = 600 * (percent / 100 * (1 - percent / 100) / SIGNATURE) ** 0.5
    return 100 * (len(common) + slack) >= (percent - margin) * (union - slack)


def _likely(least: float, percent: int):
    """Arrow function over rows (band, settle, major, m, c): likely pairs (u, v) of members m and centres c.

    A pair that shares several bands is returned for the first of them only. Where a
    bucket doesn't settle but is searched, a member keeps its NEAREST likeliest centres."""

    def parts(column):
        ints = lambda name: np.array([x[name] for x in column], dtype=np.int64)
        regs = np.frombuffer(b"".join(x["sketch"] for x in column), "<u2").reshape(len(column), -1)
        return ints("rep"), ints("n"), ints("comp"), regs, [np.frombuffer(x["sig"], "<u4") for x in column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index
            us, vs = [], []
            for band, settle, major, m, c in zip(*(b.column(at(x)) for x in ("band", "settle", "major", "m", "c")), strict=True):
                (rep, n, comp, regs, sigs), (rep_c, n_c, comp_c, regs_c, sigs_c) = parts(m.as_py()), parts(c.as_py())
                band, settle, major = band.as_py(), settle.as_py(), major.as_py()
                for low in range(0, len(rep), 64):
                    part = slice(low, low + 64)
                    fits = (comp[part, None] != comp_c) & (rep[part, None] != rep_c)
                    fits &= 100 * np.minimum(n[part, None], n_c) >= percent * np.maximum(n[part, None], n_c)
                    if settle:  # centres are members too, but for the main component
                        fits &= (comp[part, None] == major) | (rep[part, None] < rep_c)
                    if not fits.any():
                        continue
                    same = (regs[part, None, :] == regs_c[None]).sum(axis=2)
                    i, j = np.nonzero(fits & (same >= least * REGISTERS))
                    if not settle:
                        order = np.lexsort((-same[i, j], i))
                        i, j = i[order], j[order]
                    i = i + low
                    bands = (regs[i].reshape(len(i), BANDS, ROWS) == regs_c[j].reshape(len(j), BANDS, ROWS)).all(axis=2)
                    good = (bands.argmax(axis=1) == band) & (estimate(regs[i], regs_c[j], n[i], n_c[j]) >= least)
                    i, j = i[good], j[good]
                    whole = np.maximum(n[i], n_c[j]) <= SIGNATURE
                    good = np.array([_may_reach(sigs[x], sigs_c[y], w, percent) for x, y, w in zip(i, j, whole, strict=True)], dtype=bool)
                    i, j = i[good], j[good]
                    if not settle and len(i):
                        near = np.arange(len(i)) - np.searchsorted(i, i, side="left") < NEAREST
                        i, j = i[near], j[near]
                    us.append(rep[i])
                    vs.append(rep_c[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _linked(pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (u, v, tu, tv) with 100 * intersection >= percent * union of the full sets, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held = Shingler(shingle), OrderedDict()

        def of(key, text):
            if key not in held:
                held[key] = make(text)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[key]

        for b in batches:
            us, vs = b.column(0).to_pylist(), b.column(1).to_pylist()
            good = []
            for u, v, tu, tv in zip(us, vs, b.column(2), b.column(3), strict=True):
                x, y = of(u, tu.as_py()) if u not in held else held[u], of(v, tv.as_py()) if v not in held else held[v]
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["u", "v"])

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


class NearDuplicates:
    """The steps over one table; see find()."""

    def __init__(self, docs: DataFrame, text: str = "text", shingle: int = 5, percent: int = 80):
        self.docs, self.text, self.shingle, self.percent = docs, text, shingle, percent
        self.least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
        self.made = stash(sketches(docs, text, shingle), "sketches")
        full = self.made.where("n > 0").groupBy("fp").agg(F.min("__rid").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.classes = stash(full, "classes")
        width = 2 * ROWS
        keys = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sketch, b * {width} + 1, {width})))")
        rows = self.classes.select("rep", "n", F.posexplode(keys).alias("band", "key"))
        busy = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("c")).where("size > 1")
        self.rows = stash(rows.join(busy, "key").select("key", "band", "rep", "n", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n")), "buckets")
        needed = self.rows.select(F.col("rep").alias("__rid")).distinct()
        self.texts = stash(docs.select("__rid", F.col(f"`{text}`").alias("t")).join(needed, "__rid", "left_semi"), "texts")
        self.sketches = self.classes.select("rep", "sketch")

    def _similar_size(self, a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def verified(self, likely: DataFrame) -> DataFrame:
        """Verified links among likely pairs (u, v)."""
        pairs = likely.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        t = self.texts
        both = pairs.join(t.select(F.col("__rid").alias("u"), F.col("t").alias("tu")), "u").join(t.select(F.col("__rid").alias("v"), F.col("t").alias("tv")), "v")
        with small_batches(both.sparkSession, 32):  # a row holds two texts, or two blocks of sketches
            return stash(_linked(both, self.percent, self.shingle), "verified")

    def first_links(self) -> DataFrame:
        """Every member of a bucket with the bucket's smallest one."""
        r = self.rows.where("rep <> center").where(self._similar_size("n", "center_n"))
        r = r.select(F.col("rep").alias("u"), F.col("center").alias("v"), F.col("n").alias("nu"), F.col("center_n").alias("nv")).distinct()
        s = self.sketches
        r = r.join(s.select(F.col("rep").alias("u"), F.col("sketch").alias("su")), "u").join(s.select(F.col("rep").alias("v"), F.col("sketch").alias("sv")), "v")
        return self.verified(_estimated(r, self.least))

    def round_rows(self, rows: DataFrame, data: DataFrame, search: bool) -> DataFrame:
        """rows (key, band, rep, n, comp, size) with sketch, sig, the bucket's main component (major, of share rows) and settle.

        A search settles buckets of at most SMALL members only. Written once, as members and centres are both taken from it."""
        shares = rows.groupBy("key", "comp").agg(F.count("*").alias("share"))
        major = shares.groupBy("key").agg(F.max(F.struct("share", "comp")).alias("top"))
        major = major.select("key", F.col("top.comp").alias("major"), F.col("top.share").alias("share"))
        settle = (F.col("size") <= SMALL) if search else F.lit(True)
        return stash(rows.join(data, "rep").join(major, "key").withColumn("settle", settle), "round")

    def round_pairs(self, full: DataFrame, search: bool) -> DataFrame:
        """Likely pairs (u, v) of one round over round_rows()."""
        one, outside = F.struct("rep", "n", "comp", "sketch", "sig"), F.col("comp") != F.col("major")
        chunk = F.pmod(F.xxhash64("rep"), F.ceil((F.col("size") - F.col("share")) / BLOCK))
        centers = full.where(F.col("settle") & outside).groupBy("key", chunk.alias("chunk")).agg(F.collect_list(one).alias("c")).select("key", "c")  # about BLOCK
        if search:
            h = F.xxhash64("rep", F.lit(1))
            picked = full.where("not settle").groupBy("key", F.pmod(h, F.lit(CENTERS)).alias("slot")).agg(F.min_by(one, h).alias("one"))
            centers = centers.union(picked.groupBy("key").agg(F.collect_list("one").alias("c")))  # CENTERS at most
        block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK))
        looking = full.where(F.col("settle") | outside)  # the main component of a searched bucket is looked for, it need not look
        members = looking.groupBy("key", block.alias("block")).agg(*(F.first(x).alias(x) for x in ("band", "settle", "major")), F.collect_list(one).alias("m"))
        return members.join(centers, "key").mapInArrow(_likely(self.least, self.percent), "u long, v long")

    def labels(self) -> DataFrame:
        """(id, label): representatives that have links, and the smallest representative of their component."""
        verified = self.first_links()
        labels = components(verified)
        spent = []
        rows = self.rows.where("rep <> center").select("key", "band", "rep", "n")  # a centre is finished in its bucket
        data, search, nth = None, True, 0
        while True:
            nth += 1
            named = rows.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("label", "rep").alias("comp"))
            open_keys = named.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "size")
            rows = stash(named.join(open_keys, "key"), "open-buckets")
            spent.append(rows)
            if rows.isEmpty():
                break
            if data is None:
                reps = rows.select("rep").distinct()
                texts = self.texts.join(reps.withColumnRenamed("rep", "__rid"), "__rid", "left_semi")
                data = stash(signatures(texts, self.shingle).join(self.sketches, "rep"), "signatures")
            full = self.round_rows(rows, data, search)
            more = self.verified(self.round_pairs(full, search))
            discard(full)
            found = more.count()
            if found:
                spent += [verified, more, labels]
                verified = stash(verified.union(more), "links-so-far")
                labels = components(verified)
            if not search:
                break
            rows = rows.where(f"size > {SMALL}").select("key", "band", "rep", "n", "comp")
            search = nth < SEARCHES and 4 * found > rows.agg(F.count_distinct("comp")).first()[0]
            rows = rows.drop("comp")
        discard(*spent, verified, self.rows, self.texts, *([data] if data is not None else []))
        return labels


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(__rid, key, n_shingles, component_id, kept, first) for each row of docs (with row numbers in __rid).

    component_id is the smallest key reachable over links, kept tells whether the
    row's key is that one; of rows that repeat a key, kept holds for each, and
    first for one row of a component only. Null, empty and wordless texts have
    the empty set, link with nothing, and are kept. A null key never is a
    component's id unless all keys of the component are null. Empty tables give no rows."""
    near = NearDuplicates(docs, text, shingle, percent)
    labels = near.labels().select(F.col("id").alias("rep"), "label")
    keyed = near.made.join(docs.select("__rid", F.col(f"`{key}`").alias("k")), "__rid").drop("sketch")
    least = keyed.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "__rid")).alias("least"))
    of_class = near.classes.select("fp", "rep").join(labels, "rep", "left").select("fp", F.coalesce("label", "rep").alias("label")).join(least, "fp")
    of_label = of_class.groupBy("label").agg(F.min("least").alias("least"))
    named = of_class.select("fp", "label").join(of_label, "label").select("fp", "least")
    out = keyed.join(named, "fp", "left")
    own = F.col("least").isNull()
    return out.select(
        "__rid", F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(own, F.col("k")).otherwise(F.col("least.k")).alias("component_id"),
        (own | F.col("k").eqNullSafe(F.col("least.k"))).alias("kept"), (own | (F.col("__rid") == F.col("least.__rid"))).alias("first"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest key."""
    rows = with_row_id(docs)
    gone = find(rows, text, key, shingle, percent).where("not first").select("__rid")
    return rows.join(gone, "__rid", "left_anti").drop("__rid")

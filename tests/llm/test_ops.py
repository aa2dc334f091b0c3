"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns, brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import decontaminate, language_id, near_dup, packing, sharding, suffix_dedup, topk, toxicity, url_filter, warc
from lodeweave.llm.common import with_row_id
from lodeweave.llm.queries import RULES

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, task int, rid long, sketch string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, 1, 2, "x") for i, t in texts], DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Añ 漢字 🙂 " * 3), (4, "Añ 漢字 🙂 " * 3), (None, "no key"), (5, "12 34 !!"), (6, "x" * 30_000), (7, words(1, 9_000))]


# --- 1 ---


def test_url_rules_and_nulls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Net/x?y#z", "https://example.net/en/1", "https://m.example.net/en", "http://example.com/de/1", "http://xexample.com/de/1", "http://a.org/fr/", "http://net", "a://b.net/", "a://b.net/"]
    x = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(x, "url", RULES).collect()}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("example.net", "/en/1", "example.net/en/"), ("m.example.net", "/en", "net/"),
        ("example.com", "/de/1", "example.com/de/"), ("xexample.com", "/de/1", None), ("a.org", "/fr/", "org/fr/"), ("net", "", None), ("b.net", "/", "net/"), ("b.net", "/", "net/"),
    ]
    assert out[3]["verdict"] == "block" and out[4]["verdict"] == "allow" and out[0]["verdict"] in ("allow", "block")
    assert url_filter.judge(x.limit(0), "url", RULES).count() == 0


def test_url_rule_table_equals_rule_list(spark):
    hosts = ["a.net", "example.net", "m.example.net", "example.com", "x.example.com", "b.org", "org", ""]
    x = spark.createDataFrame([(f"{h}{p}", h, p) for h in hosts for p in ("", "/", "/en/", "/de/x", "/fr/")], "k string, host string, path string")
    rules = spark.createDataFrame([(r.pattern, r.action) for r in RULES], "pattern string, action string")
    pattern, _ = url_filter.match_rules(RULES, F.col("host"), F.col("path"))
    listed = {(r["k"], r["p"]) for r in x.select("k", pattern.alias("p")).collect() if r["p"]}
    assert {(r["k"], r["rule"]) for r in url_filter.match_rule_table(x, "k", rules).collect()} == listed


def test_url_trees_learn(spark):
    rows = [(f"http://{'spam' if i % 2 else 'ok'}{i}.{'biz' if i % 2 else 'org'}/{'9' * 8 if i % 2 else 'news'}?q={i}", i % 2) for i in range(400)]
    x = spark.createDataFrame(rows, "url string, y int")
    model = url_filter.UrlClassifier.fit(x.where("pmod(hash(url), 4) <> 0"), "url", "y")
    held = model.scored(x.where("pmod(hash(url), 4) = 0"), "url").collect()
    assert np.mean([(r["block_score"] >= 0.5) == bool(r["y"]) for r in held]) > 0.95


# --- 2 ---


def test_decontamination(spark):
    item = "the quick gardener planted 12 roses near the old stone wall while Maria counted 12 birds before the long summer rain"
    changed = item.replace("12", "47").replace("Maria", "Jonas")
    mixed = item.replace("12 roses", "47 roses").replace("12 birds", "48 birds")
    texts = [(10, words(2, 50) + ". " + item + ". " + words(3, 50)), (11, words(4, 40) + ". " + changed + ". "), (12, words(5, 200)), (13, "Unrelated. " + mixed)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zq zr"), (5, item)], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(docs(spark, ODD + texts), bench).collect()}
    assert out == {(10, 1), (10, 5), (11, 1), (11, 5)}  # one value for two is a different question
    clashing = docs(spark, ODD + texts).withColumnsRenamed({"task": "row", "sketch": "item", "source": "item_id"})
    assert decontaminate.clean(clashing, bench).columns == clashing.columns
    assert decontaminate.report(docs(spark, [(1, "Bread is baked"), (2, "bread " * 20_000)]), spark.createDataFrame([(1, "bread")], "item_id long, text string")).count() == 0
    kept = decontaminate.clean(docs(spark, ODD + texts), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == len(ODD) + 2
    assert decontaminate.report(docs(spark, []), bench).count() == 0 == decontaminate.report(docs(spark, texts), bench.limit(0)).count()


def test_decontamination_by_windows(spark):
    item = "the quick gardener planted 12 roses near the old stone wall while Maria counted 12 birds before the long summer rain and then sold 12 of the roses to her best friend"
    apples = "Tom has 5 apples. Tom eats 3 of them. Tom buys 4 more. How many apples does Tom have?"
    ages = "if the older brother is 5 years old and the younger sister is 7 years old then how old are they together"
    texts = [
        (1, item.replace("12 birds", "48 birds")),  # one changed occurrence; the rest is verbatim
        (2, ages.replace("5", "4").replace("7", "4")),  # new values coincide
        (3, apples.replace("Tom", "Anna")), (4, "so he said tom has 5 apples " + words(6, 40)), (5, "Boxes. " + words(7, 60)),
        (6, "A. B. C. D. E. F. G. H. " * 9_000),  # every word begins a sentence
    ]
    bench = spark.createDataFrame([(1, item), (2, ages), (3, apples)], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in decontaminate.report(docs(spark, texts), bench).collect()}
    assert set(out) == {(1, 1), (2, 2), (3, 3)}
    assert (out[2, 2]["matched"], out[2, 2]["windows"], out[2, 2]["first_pos"]) == (17, 17, 0)
    whole = decontaminate.report(docs(spark, [(1, "Now. " + apples)]), bench).first()
    assert whole["matched"] == whole["windows"] and whole["first_pos"] == 1


def test_decontamination_of_items_without_words(spark):
    items = ["12 + 7 = 19, 30 + 4 = 34, 8 x 9 = 72", "ALL CAPS TITLES ARE NAMES TO THIS TEMPLATE TOO", "Ada Lovelace 1815, Alan Turing 1912, Grace Hopper 1906", "77 88",
             "then we add the number 5 and 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    texts = [(i, f"{words(i, 30)}: see {t} {words(i + 50, 30)}") for i, t in enumerate(items, 1)]
    texts += [(10, "12 + 8 = 20, 31 + 4 = 35, 8 x 8 = 64"), (11, "77 89"), (12, "OTHER CAPS WORDS THAT ARE NOT IN ANY OF THE ITEMS"), (13, "then we add the number 6 and 9 9 1")]
    out = {(r["doc_id"], r["item_id"]): r for r in decontaminate.report(docs(spark, texts), bench).collect()}
    assert set(out) == {(i, i) for i in range(1, 6)} | {(13, 5)}  # the last by its templates alone
    assert all(out[i, i]["matched"] == out[i, i]["windows"] for i in range(1, 6))


# --- 3 ---


def test_toxicity(spark):
    texts = [(i, words(i, 60) + (" vileword " if i % 3 == 0 else " ") + words(i + 999, 20)) for i in range(300)]
    x = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(x, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(x, weights).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in range(200, 300)]) > 0.95
    assert 0 < len(weights.slots) < 20_000
    odd = toxicity.score(docs(spark, ODD), weights).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    empty = toxicity.fit(x.limit(0), labels.limit(0))
    assert toxicity.score(x.limit(0), empty).count() == 0 and toxicity.score(x.limit(2), empty).count() == 2


# --- 4 ---


def test_sharding(spark):
    table = sharding.fill_table([f"s{i}" for i in range(7)], 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1 and sum(counts) == 1009
    assert sharding.movement(table, sharding.fill_table([f"s{i}" for i in range(8)], 1009)) < 0.3
    x = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "doc_id long, shard string")
    rows = sharding.assign(x, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    want = int(hashlib.md5(b"2").hexdigest()[:15], 16) % 101
    assert [r["slot"] for r in rows if r["doc_id"] == 2] == [want]
    assert sharding.assign(x.limit(0), "doc_id", ["a"], 101).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


# --- 5 ---


def test_letters_decide():
    assert not len(language_id.presence("² ½ Ⅳ ① 12 _")) and len(language_id.presence("ª")) and len(language_id.presence("漢"))
    assert (language_id.presence("½hello²") == language_id.presence("!hello!")).all()


def test_language_id(spark):
    base = {"en": "the and of with from this that have", "de": "der die und mit nicht werden über", "fr": "le les des être avec pour où ça"}
    texts, langs = [], []
    for i in range(150):
        r, lang = random.Random(i), ("en", "de", "fr")[i % 3]
        texts.append((i, " ".join(r.choices(base[lang].split(), k=8))))
        langs.append(lang)
    x = docs(spark, texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    model = language_id.fit(x.where("doc_id < 90"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(x.where("doc_id >= 90"), model).collect()}
    assert all(got[i] == langs[i] for i in range(90, 150))
    odd = {r["text"]: r for r in language_id.predict(docs(spark, ODD), model).collect()}
    for t in (None, "", " \n\t ", "12 34 !!"):
        assert odd[t]["lang_pred"] == "und" and odd[t]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    nothing = language_id.fit(x.limit(0))
    assert language_id.predict(x.limit(2), nothing).collect()[0]["lang_pred"] == "und" and language_id.predict(x.limit(0), model).count() == 0


# --- 6 ---


def brute_spans(rows, length):
    seen = {}
    for b in rows:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    for b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield [m.span() for m in re.finditer(b"\1+", bytes(gone))]


def brute_repeats(rows, length):
    out = []
    for b, spans in zip(rows, brute_spans(rows, length), strict=True):
        kept = b"".join(b[lo:hi] for lo, hi in zip([0, *(hi for _, hi in spans)], [*(lo for lo, _ in spans), len(b)], strict=True))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
@pytest.mark.parametrize("length", [400, 24])
def test_suffix_dedup_equals_brute_force(spark, hot, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 5_000)  # long texts are cut into overlapping blocks
    passage, edge = words(77, 120), words(78, 90)
    texts = ODD[:-2] + [(20 + i, words(i, 60 + i) + passage + words(100 + i, 30)) for i in range(6)]
    texts += [(30, "ab" * 700), (31, words(9, 150)), (31, words(9, 150)), (32, edge + "ñ" + edge), (33, edge[:399]), (34, edge[:400]), (35, "y" * 401), (36, "z" * 400)]
    texts += [(37, words(37, 2_500) + passage), (38, words(38, 55)), (39, words(38, 55) + " end")]
    got = sorted(tuple(r)[1:] for r in suffix_dedup.digest(docs(spark, texts), length=length, hot=hot).collect())
    raw = [(t or "").encode() for _, t in texts]
    assert [r[:4] for r in got] == sorted(brute_repeats(raw, length))
    short, want = min(length, 200), []
    for data, spans in zip(raw, brute_spans(raw, short), strict=True):
        long = [(lo, hi) for lo, hi in spans if len(data[lo:hi].split()) >= 50]
        want.append((len(data), len(long), sum(hi - lo for lo, hi in long)))
    assert sorted((r[0], r[4], r[5]) for r in got) == sorted(want)
    assert suffix_dedup.digest(docs(spark, []), length=length).count() == 0


def test_multikey_ties():
    r = np.random.default_rng(4)
    keys = r.integers(0, 3, (400, 5))
    got = suffix_dedup.multikey_ties(keys[:, 0].astype(np.uint64), lambda d, rows: keys[rows, d + 1], 4)
    _, back, count = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
    assert sorted(got.tolist()) == np.flatnonzero(count[back.ravel()] > 1).tolist()
    assert len(suffix_dedup.multikey_ties(np.zeros(0, np.uint64), None, 2)) == 0


def test_suffix_clean_keeps_columns(spark):
    passage = "ñandú " * 90
    x = docs(spark, [(1, "α" + words(1, 20) + passage), (2, "β" + words(2, 20) + passage), (3, None)])
    out = suffix_dedup.clean(x)
    assert out.columns == x.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[3] is None and got[1].startswith("α") and "ñandú ñandú" not in got[1]


# --- 7 ---


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 700_000
    rows = [(1, "http://a", "same"), (2, "http://b\r\nx", "same"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", long), (7, "u", "a\r\n\r\nWARC/1.0\r\nContent-Length: 3"), (7, "u", "twin"), (7, "u", "twin"), (None, "u", "solo")]
    x = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, size int")
    out = warc.round_trip(x, path=str(tmp_path / "w")).collect()
    assert len(out) == len(rows)
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    by = {r["page_id"]: r for r in out}
    for i, _, html in rows[:7]:
        if i != 7:
            assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len((html or "").encode()), sha(html))
    assert [(by[i]["record_type"], by[i]["refers_to"]) for i in (1, 2, 3, 4, 5, 6)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("revisit", 5)]
    assert {r["record_type"] for r in out if r["page_id"] in (7, None)} == {"response"}
    assert {r["record_type"] for r in warc.round_trip(x, min_bytes=5, path=str(tmp_path / "v")).collect() if r["page_id"] in (1, 2, 3, 4)} == {"response"}
    assert warc.round_trip(x.limit(0), path=str(tmp_path / "e")).count() == 0
    import gzip

    plain = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("archive=*/part-*"))
    records = list(warc.parse(plain))
    assert sum(h["WARC-Type"] == "continuation" for h, _ in records) == 5 and all(len(c) <= warc.CHUNK_BYTES + len(warc.HEAD) for _, c in records)
    names = {h["WARC-Record-ID"]: h for h, _ in records}
    assert len(names) == len(records)
    for h, _ in records:  # references resolve, and to equal payloads
        if h["WARC-Type"] == "revisit":
            assert names[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and h["WARC-Profile"] == warc.PROFILE
        if h["WARC-Type"] == "continuation":
            assert h["WARC-Segment-Origin-ID"] in names


def test_warc_archives_end_between_records(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "é" * n) for i, n in enumerate([10, 95, 3, 250, 100, 0])]
    x = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for name, bound, archives in (("w", {"per_archive": 2}, 3), ("v", {"archive_bytes": 300}, 4)):
        warc.write(warc.records(x, "page_id", "url", "html", chunk_bytes=60, **bound), str(tmp_path / name))
        parts = list((tmp_path / name).glob("archive=*/part-*"))
        out = {r["page_id"]: r["payload_bytes"] for r in warc.read(spark, str(tmp_path / name)).collect()}
        assert len(parts) >= 3 and (name == "v" or len(parts) >= archives)
        assert out == {i: len(html.encode()) for i, _, html in rows}


# --- 8 ---


def test_packing(spark):
    x = docs(spark, ODD + [(50, "a"), (51, "a")])
    out = packing.pack(x, TOKENIZER, capacity=64).collect()
    encoder = packing.Encoder(TOKENIZER, check=True)
    want = {}
    for k, t in ODD + [(50, "a"), (51, "a")]:
        ids = (encoder.encode(t) if t else b"") + b"\0\0\0\0"
        want.setdefault(k, []).append([(i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(packing.cut(len(ids) // 4, 64))])
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted((str(k), *p) for k, all_ in want.items() for pieces in all_ for p in pieces)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in out) // 64) + 1
    assert packing.pack(x.limit(0), TOKENIZER).count() == 0


def test_encoder_equals_the_files_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    e = packing.Encoder(TOKENIZER, check=True)
    for text in ["", " ", "a  b\n\n c\t", "it's DON'T 12,3", "ñ 漢字🙂\u2009x\u3000", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|end", "\x1c\x85 y", "x" * 3000]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_minimum_bin_slack_is_tight():
    r = random.Random(3)
    counts = {}
    for _ in range(5000):
        n = r.randint(1, 100)
        counts[n] = counts.get(n, 0) + 1
    bins = packing.plan(counts, 100)
    used = {}
    for times, content in bins:
        assert sum(n * k for n, k in content) <= 100
        for n, k in content:
            used[n] = used.get(n, 0) + times * k
    assert used == counts and sum(t for t, _ in bins) <= 1.01 * sum(n * c for n, c in counts.items()) / 100
    assert packing.plan({}, 10) == [] and packing.fullest({4: 3, 3: 1}, 4, 7) in ([(3, 1), (4, 1)], [(4, 1), (3, 1)])


# --- 9 ---


def test_top_k_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(300)] + [(i, [0.1] * 8) for i in range(300, 340)]
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0, 2.0]), (None, [1.0] * 8)]
    x = spark.createDataFrame([(*row, 0) for row in rows], "vec_id long, embedding array<float>, score int")
    out = topk.top_k(x, x.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20)
    q = {i: [int(np.floor(64 * float(np.float32(c)))) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for a in sorted(q):
        if a % 20 == 0:
            scores = sorted((-sum(u * w for u, w in zip(q[a], q[b])), b) for b in q if b != a)[:20]
            want += [(a, n, b, -s) for n, (s, b) in enumerate(scores, 1)]
    assert sorted(tuple(row) for row in out.collect()) == sorted(want)
    assert topk.top_k(x.limit(0), x.limit(0), "vec_id", "embedding").count() == 0


# --- 10 ---


def brute_components(texts, n, percent):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    keys = {}
    for i, (k, _) in enumerate(texts):
        keys.setdefault(root(i), []).append(k)
    return sorted((str(k), len(sets[i]), str(min((x for x in keys[root(i)] if x is not None), default=None))) for i, (k, _) in enumerate(texts))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    r = random.Random(8)
    base = words(40, 120, 5000).split()
    texts = list(ODD)
    for i in range(45):  # one large group, some of it only linked through others
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        texts.append((1000 + i, " ".join(copy).upper() if i % 5 == 0 else " ".join(copy)))
    texts += [(2000 + i, words(500 + i, 80)) for i in range(20)] + [(3000, "One Two"), (3001, "one two"), (3002, "two one")]
    for small, centers in ((32, 64), (4, 24)):  # the second settles every bucket by rounds of centres
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "CENTERS", centers)
        out = near_dup.find(with_row_id(docs(spark, texts)), shingle=4).collect()
        assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == brute_components(texts, 4, 80)
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in out)
    kept = near_dup.keep_one(docs(spark, texts), shingle=4)
    assert kept.columns == docs(spark, []).columns
    assert kept.count() == sum(x["first"] for x in out)
    assert near_dup.find(with_row_id(docs(spark, []))).count() == 0


def test_sketch_estimate():
    a = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(1000 * share)
        b = np.concatenate([a[:n], np.random.default_rng(2).integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
        x, y = near_dup.sketch(np.sort(a)), near_dup.sketch(np.sort(b))
        assert abs(near_dup.estimate(x[None], y[None], np.array([1000]), np.array([1000]))[0] - n / (2000 - n)) < 0.15
        assert (np.maximum(x, y) == near_dup.sketch(np.unique(np.concatenate([a, b])))).all()  # sketches merge


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    passage = words(900, 100)
    item = "she placed 14 wooden boxes behind the tall green hedge and then walked slowly towards the village market square"
    text = {1: "the house " + words(1, 150), 2: "the house " + words(1, 150), 3: words(3, 80) + " " + passage, 4: words(4, 80) + " " + passage, 5: words(5, 60) + ". " + item, 6: "123 !!", 7: None, 8: words(8, 90)}
    rows = [(k, t, None if k == 8 else "en", "s", len(t or "")) for k, t in text.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, 3, 4, 8}
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5

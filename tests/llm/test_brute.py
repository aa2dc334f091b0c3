"""Plain loops beside the operators: rules, lexical features, FTRL, kernel, template windows, and odd tables in the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import DOCS, ODD, docs, words

import corpus_pipeline
from lodeweave.llm import decontaminate, language_id, toxicity, url_filter
from lodeweave.llm.queries import RULES


# --- 1 ---


def plain_url(url):
    """(host, path, rule, action) by reading the contract word for word."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
    best = None
    for r in RULES:
        h, _, p = r.pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return host, path, best and best.pattern, best and best.action


def test_urls_equal_plain_reading(spark):
    r = random.Random(11)
    bits = ["http", "https", "://", "://", "/", "?", "#", "NET", "net", "example.net", "Example.com", "org", ".", "x.", "/en/", "/de/", "/fr/", "É", "\n", " ", "a", "%20", ":80", "@"]
    urls = sorted({"".join(r.choices(bits, k=r.randrange(9))) for _ in range(800)}) + [None, "http://" + "a/" * 40_000, "same", "same"]
    for scheme in ("http://", "HTTP://a://"):
        urls += [f"{scheme}{h}{p}" for h in ("net", "a.NET", "anet", "example.net", "m.example.com", "b.org") for p in ("", "/", "/en", "/en/", "/de/x?/fr/", "#/fr/", "/fr/#")]
    x = spark.createDataFrame([(i, u, "old", "old", 9.0, "s", 1.0, 2) for i, u in enumerate(urls)], "page_id int, url string, rule string, verdict string, block_score double, suffix string, entropy double, y int")
    out = {v["page_id"]: v for v in url_filter.judge(x, "url", RULES).collect()}
    assert len(out) == len(urls) and set(out[0].asDict()) == {*x.columns, "host", "path"}
    for i, u in enumerate(urls):
        host, path, rule, action = plain_url(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["suffix"], out[i]["entropy"]) == (host, path, rule, "s", 1.0), u
        assert out[i]["verdict"] == (action or ("block" if out[i]["block_score"] >= 0.5 else "allow"))
    same = [out[i]["block_score"] for i, u in enumerate(urls) if u == "same"]
    assert same[0] == same[1] and all(0 <= v["block_score"] <= 1 for v in out.values())


def test_trees_equal_plain_boosting(spark):
    r = random.Random(12)
    rows = [(float(r.randrange(9)), float(r.randrange(4))) for _ in range(300)]
    rows = [(a, b, int((a > 4) != (b > 1) if r.random() < 0.9 else r.random() < 0.5)) for a, b in rows]
    model = url_filter.BoostedTrees(["a", "b"], rounds=3, depth=2)
    x = spark.createDataFrame(rows, "a double, b double, y int")
    model.fit(x, "y")
    got = sorted((v["a"], v["b"], round(v["p"], 9)) for v in x.select("a", "b", model.score().alias("p")).collect())
    ones = sum(y for *_, y in rows)
    margin = [math.log((ones + 1) / (len(rows) - ones + 1))] * len(rows)
    gain = lambda g, h: g * g / (h + model.ridge)

    def grow(part, depth, grad, hess):
        g, h = sum(grad[i] for i in part), sum(hess[i] for i in part)
        best = (1e-6, None)
        if depth:
            for k in (0, 1):
                for cut in model.cuts[k]:
                    left = [i for i in part if rows[i][k] <= cut]
                    gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                    won = gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h)
                    if 0 < len(left) < len(part) and won > best[0] + 1e-9:
                        best = (won, left)
        if best[1] is None:
            return {i: -model.rate * g / (h + model.ridge) for i in part}
        left = set(best[1])
        return grow(best[1], depth - 1, grad, hess) | grow([i for i in part if i not in left], depth - 1, grad, hess)

    for _ in range(model.rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        step = grow(range(len(rows)), model.depth, [q - y for q, (*_, y) in zip(p, rows, strict=True)], [q * (1 - q) for q in p])
        margin = [m + step[i] for i, m in enumerate(margin)]
    assert got == sorted((a, b, round(1 / (1 + math.exp(-m)), 9)) for (a, b, _), m in zip(rows, margin, strict=True))


# --- 2 ---


def test_template_windows_equal_plain_windows():
    """Every reading of every window by a loop over placeholders; equal forms have equal hashes and others don't."""
    text = "Tom has 5 apples and 12 kg of flour. Tom paid 3 dollars; then Ada and Tom went home. In 7 days 8 8 9 10 11 12 they come. " * 2
    make = decontaminate.Templates()
    tokens, codes, initial = make.codes(text)
    n, seen = decontaminate.WINDOW, {}

    def form(i, name):
        t = tokens[i].lstrip(decontaminate.MARK)
        if name or (tokens[i][0] != decontaminate.MARK and t[0].isupper()):
            return "<name>"
        if t[0].isdigit():
            return "<number>"
        return "<unit>" if i and tokens[i - 1][0].isdigit() and t.lower() in decontaminate.UNITS else t.lower()

    got = Counter()
    for at, h, names in make.readings(tokens, codes, initial):
        for a, value, read in zip(at.tolist(), h.tolist(), names.tolist(), strict=True):
            shape = ("literal", *(t.lstrip(decontaminate.MARK).lower() for t in tokens[a : a + n])) if read < 0 else tuple(form(a + k, read >> k & 1) for k in range(n))
            assert seen.setdefault(value, shape) == shape
            got[a] += 1
    assert len(set(seen.values())) == len(seen)
    for a in range(len(tokens) - n + 1):
        choices = [[form(a + k, False)] + (["<name>"] if initial[a + k] else []) for k in range(n)]
        shapes = [[]]
        for c in choices:
            shapes = [s + [v] for s in shapes for v in c]
        good = [s for s in shapes if 2 * sum(v[0] != "<" for v in s) >= n]
        assert got[a] == len(good) + (len(good) < len(shapes))


def test_decontamination_recall_and_precision(spark):
    """Verbatim and re-parameterised copies between other text are found; texts of the same words in another order are not."""
    r, items, texts = random.Random(21), [], []
    for i in range(25):
        base = ["".join(r.choices("bcdfgklmnprst", k=2)) + r.choice("aeiou") + r.choice("bdlnrst") for _ in range(24)]
        base[5], base[15] = str(r.randrange(10, 50)), str(r.randrange(50, 99))
        items.append((i, " ".join(base)))
        changed = list(base)
        changed[5], changed[15] = str(r.randrange(100, 200)), str(r.randrange(200, 300))
        loose = r.sample(base, len(base))
        texts += [(3 * i, words(i, 40) + " " + " ".join(base) + " " + words(i + 70, 40)), (3 * i + 1, " ".join(changed)), (3 * i + 2, " ".join(loose))]
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")  # a repeated item
    got = [(v["doc_id"], v["item_id"]) for v in decontaminate.report(docs(spark, texts), bench).collect()]
    assert set(got) == {(3 * i + k, i) for i in range(25) for k in (0, 1)}


# --- 3 ---


def test_ftrl_equals_plain_loop():
    r = np.random.default_rng(5)
    rows = [(np.unique(r.integers(0, 60, 12)), int(r.random() < 0.4)) for _ in range(80)]
    model = toxicity.Ftrl(l1=0.3, epochs=2).fit(rows)
    z, n = Counter(), Counter()

    def weight(j):
        l1 = 0.0 if j == toxicity.SLOTS else model.l1
        if abs(z[j]) <= l1:
            return 0.0
        return -(z[j] - math.copysign(l1, z[j])) / ((model.beta + math.sqrt(n[j])) / model.alpha + model.l2)

    for _ in range(model.epochs):
        for slots, y in rows:
            at = [*slots.tolist(), toxicity.SLOTS]
            w = {j: weight(j) for j in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for j in at:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / model.alpha * w[j]
                n[j] += g * g
    small = model.compact()
    assert np.allclose(small.dense()[:60], [weight(j) for j in range(60)], atol=1e-6) and abs(small.bias - weight(toxicity.SLOTS)) < 1e-9
    assert any(weight(j) == 0 for j in range(60)) and len(small.slots) < 60


def test_features_equal_plain_windows(monkeypatch):
    make, mask = toxicity.Features(), (1 << 64) - 1
    text = "One two, THREE four two one Two " * 4
    h = [zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 & mask for w in toxicity.WORD.findall(text.lower())]
    want = set()
    for gap in (0, 1, 2):
        for i in range(len(h) - gap):
            y = h[i] * (2 * gap + 1) + (h[i + gap] * 0xC2B2AE3D27D4EB4F if gap else 0) & mask
            y = (y ^ (y >> 31)) * 0x94D049BB133111EB & mask
            want.add(y >> 45)
    assert make(text).tolist() == sorted(want)
    long = " ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx") + " "
    whole = make(long).tolist()
    monkeypatch.setattr(toxicity, "BLOCK", 7)  # blocks of a long text lose no pair
    assert make(long).tolist() == whole


def test_toxicity_of_odd_rows(spark):
    texts = [(i, words(i, 30) + (" vileword" if i % 2 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0)], "doc_id long, toxic int")
    x = docs(spark, texts + [(1, texts[1][1]), (61, "z " * 60_000)])  # a repeated row and one too long to teach
    weights, again = toxicity.fit(x, labels), toxicity.fit(x.repartition(5), labels.repartition(3))
    assert (weights.slots == again.slots).all() and (weights.values == again.values).all() and weights.bias == again.bias
    out = toxicity.score(docs(spark, ODD + [(1, texts[1][1]), (1, texts[1][1])]), weights)  # DOCS has a column named score
    assert out.columns == [c for c in docs(spark, []).columns if c != "score"] + ["score"]
    got = [v["score"] for v in out.collect()]
    assert len(got) == len(ODD) + 2 and got[-1] == got[-2] and got[0] == got[1]


# --- 5 ---


def test_language_scores_equal_the_kernel():
    """The folded table gives what kernels with the landmarks, root and ridge give one by one."""
    r = random.Random(6)
    texts = ["".join(r.choices("abcdeé " if i % 2 else "mnopqü ", k=40)) for i in range(40)]
    langs = ["x" if i % 2 else "y" for i in range(40)]
    marks = [language_id.presence(t) for t in texts]
    model = language_id.KernelRidge.fit(marks, langs, landmarks=12, ridge=0.05)
    sets = [set(m.tolist()) for m in marks]
    cos = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    chosen = np.unique(np.linspace(0, 39, 12).astype(int)).tolist()
    values, vectors = np.linalg.eigh(np.array([[cos(sets[i], sets[j]) for j in chosen] for i in chosen]))
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = np.hstack([np.array([[cos(s, sets[j]) for j in chosen] for s in sets]) @ root, np.ones((40, 1))])
    y = np.array([[1.0 if a == n else -1.0 for n in ("x", "y")] for a in langs])
    alpha = np.linalg.solve(z.T @ z + 0.05 * 40 * np.diag([1.0] * (z.shape[1] - 1) + [1e-6]), z.T @ y)
    fresh = ["abc dé mno", "üqp", "é"]
    k = np.array([[cos(set(language_id.presence(t).tolist()), sets[j]) for j in chosen] for t in fresh])
    got, known = model.scores([*fresh, "12"])
    assert model.langs == ["x", "y"] and known.tolist() == [True, True, True, False]
    assert np.allclose(got[:3], np.hstack([k @ root, np.ones((3, 1))]) @ alpha, atol=1e-3)


def test_language_of_clashing_columns(spark):
    x = docs(spark, [(1, "the and of"), (2, "der die und"), (2, "der die und"), (3, "x" * 600_000), (4, "²½")]).withColumns(
        {"lang": F.expr("case doc_id when 1 then 'en' when 2 then 'de' end"), "lang_pred": F.lit("old"), "held_out": F.lit(True), "t": F.lit(1), "h": F.lit(2), "nth": F.lit(3)})
    out = language_id.predict(x, language_id.fit(x)).collect()
    got = Counter((v["doc_id"], v["lang_pred"]) for v in out)
    assert got[1, "en"] == 1 and got[2, "de"] == 2 and got[4, "und"] == 1 and len(out) == 5
    assert all(v["held_out"] is True and v["t"] == 1 and v["h"] == 2 for v in out)


# --- pipeline ---


@pytest.mark.parametrize("filled", [True, False])
def test_pipeline_of_odd_tables(spark, tmp_path, filled):
    """Every odd row of the operators' tests, repeated keys, extra columns of clashing names; then empty tables."""
    rows = [(i, t, None if n % 2 else "en", None, None, 0.5, 1, 2, "x", 7, "old") for n, (i, t) in enumerate([*ODD, (7, "twin of another key " + words(70, 60)), (90, words(90, 60_000))])]
    kind = DOCS + ", __rid int, sequence_id string"
    spark.createDataFrame(rows if filled else [], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, str(tmp_path))
        if len(counts) < 4:
            assert docs_.columns == corpus_pipeline.COLUMNS
        counts.append(docs_.count())
    # letters: rows 4 (twice), null key, 6, 7 (twice), 90; of the repeated row 4 one stays
    assert counts[:4] == ([7, 6, 6, 6] if filled else [0, 0, 0, 0])
    assert (counts[4] > 6) is filled

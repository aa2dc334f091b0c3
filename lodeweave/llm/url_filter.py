"""URL filters: longest-match host rules, and boosted trees over lexical features for the rest.

All of it is DataFrame expressions. Training gathers gradient histograms
(nodes x features x bins, a fixed size) per tree level; the fitted trees become
one SQL expression, so judging is a projection without shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else ''."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


def match_rules(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(pattern, action) of the longest rule that fits host (or a subdomain) and path; else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; pass them as a table to match_rule_table")
    pattern, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        action = F.when(fits, F.lit(rule.action)).otherwise(action)
    return pattern, action


def match_rule_table(urls: DataFrame, key: str, rules: DataFrame, max_labels: int = 16) -> DataFrame:
    """(key, rule, action) for rule tables of any size (columns pattern, action).

    Host suffixes of up to max_labels labels are joined with the rules' hosts. A
    rule host with more labels raises an error. urls has columns key, host, path, keys unique."""
    rules = rules.select(
        "pattern", "action", F.substring_index("pattern", "/", 1).alias("rule_host"),
        F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)").alias("rule_path"),
    ).where("pattern is not null")
    rules = rules.withColumn("rule_host", F.when(F.size(F.split("rule_host", r"\.")) > max_labels, F.raise_error(F.lit("a rule host has too many labels"))).otherwise(F.col("rule_host")))
    labels = "split(host, '[.]')"
    tails = f"array_distinct(transform(sequence(1, {max_labels}), n -> array_join(slice({labels}, greatest(1, size({labels}) - n + 1), n), '.')))"
    suffixes = urls.select(key, "path", F.explode(F.expr(tails)).alias("rule_host"))
    best = suffixes.join(rules, "rule_host").where("startswith(path, rule_path)")
    best = best.groupBy(key).agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("best"))
    return best.select(key, F.col("best.pattern").alias("rule"), F.col("best.action").alias("action"))


# --- lexical features -------------------------------------------------------

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&:%#"
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens", "fragment", "secure", "suffix_rate"]


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def lexical(df: DataFrame, url: str) -> DataFrame:
    """df with one double column per lexical feature and suffix (the host's last label)."""
    whole = F.lower(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    df = df.withColumn("__u", whole).withColumn("__h", host_of(F.col("__u"))).withColumn("__p", path_of(F.col("__u")))
    u, h, p = F.col("__u"), F.col("__h"), F.col("__p")
    n = F.greatest(F.length(u), F.lit(1))
    counts = F.array(*[_count(u, c) for c in ALPHABET])
    entropy = F.aggregate(counts, F.lit(0.0), lambda total, k: total - F.when(k > 0, (k / n) * F.log2(k / n)).otherwise(0.0))
    made = {
        "length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "depth": _count(p, "/"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / n, "entropy": entropy,
        "params": F.when(F.instr(u, "?") > 0, _count(u, "&") + 1).otherwise(0), "labels": _count(h, ".") + 1,
        "hyphens": _count(u, "-"), "fragment": (F.instr(u, "#") > 0).cast("int"), "secure": u.startswith("https:").cast("int"),
    }
    df = df.withColumn("suffix", F.substring_index(h, ".", -1)).withColumns({k: v.cast("double") for k, v in made.items()})
    return df.drop("__u", "__h", "__p")


# --- boosted trees ------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Second-order gradient boosting for binary labels, fitted from SQL histograms."""

    features: list[str]
    rounds: int = 6
    depth: int = 3
    bins: int = 16
    rate: float = 0.4
    ridge: float = 1.0
    prior: float = 0.0
    cuts: list[list[float]] = field(default_factory=list)
    trees: list[dict[int, tuple]] = field(default_factory=list)

    def _bin(self, k: int) -> Column:
        value = F.coalesce(F.col(self.features[k]), F.lit(0.0))
        return reduce(lambda a, b: a + b, [(value > c).cast("int") for c in self.cuts[k]], F.lit(0))

    def _walk(self, tree: dict[int, tuple], node: int, go) -> Column:
        kind, *rest = tree.get(node, ("open",))
        if kind == "split":
            return F.when(go(rest[0], rest[1]), self._walk(tree, 2 * node, go)).otherwise(self._walk(tree, 2 * node + 1, go))
        return F.lit(float(rest[0])) if kind == "leaf" else F.lit(node)

    def fit(self, df: DataFrame, label: str) -> BoostedTrees:
        """df: rows with double features and an int label 0/1. No rows, or one class: the prior decides alone."""
        grid = [i / self.bins for i in range(1, self.bins)]
        got = df.agg(F.count("*").alias("n"), F.sum(label).alias("ones"), *[F.percentile_approx(f, grid, 1000).alias(f) for f in self.features]).first()
        n, ones = got["n"], got["ones"] or 0
        self.prior, self.trees = log((ones + 1) / (n - ones + 1)), []
        self.cuts = [sorted(set(got[f] or [])) for f in self.features]
        if not 0 < ones < n:
            return self
        binned = df.groupBy(*[self._bin(k).alias(f"b{k}") for k in range(len(self.features))]).agg(F.count("*").alias("w"), F.sum(label).alias("y")).persist()
        go = lambda k, b: F.col(f"b{k}") <= b
        margin = F.lit(self.prior)
        for _ in range(self.rounds):
            tree: dict[int, tuple] = {}
            p = 1 / (1 + F.exp(-margin))
            base = binned.select("*", (F.col("w") * p - F.col("y")).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
            for level in range(self.depth):
                rows = base.select(self._walk(tree, 1, go).cast("double").alias("node"), "g", "h", F.posexplode(F.array(*[f"b{k}" for k in range(len(self.features))])).alias("f", "b"))
                hist: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
                for r in rows.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                    hist.setdefault(int(r["node"]) if r["node"] == int(r["node"]) else -1, {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
                for node in [x for x in range(2**level, 2 ** (level + 1)) if x in hist and x not in tree]:
                    self._grow(tree, node, hist[node], last=level == self.depth - 1)
            self.trees.append(tree)
            margin = margin + self._walk(tree, 1, go)
        binned.unpersist()
        return self

    def _grow(self, tree: dict[int, tuple], node: int, hist: dict, last: bool) -> None:
        """Split the node at its best cut, or make it a leaf; on the last level both children get their values."""
        one = next(iter(hist.values()))
        G, H = sum(g for g, _ in one.values()), sum(h for _, h in one.values())
        gain = lambda g, h: g * g / (h + self.ridge)
        value = lambda g, h: -self.rate * g / (h + self.ridge)
        best = (1e-6, None)
        for k in sorted(hist):
            g = h = 0.0
            for b in sorted(hist[k])[:-1]:
                g, h = g + hist[k][b][0], h + hist[k][b][1]
                won = gain(g, h) + gain(G - g, H - h) - gain(G, H)
                if won > best[0] + 1e-9:
                    best = (won, (k, b, g, h))
        if best[1] is None:
            tree[node] = ("leaf", value(G, H))
            return
        k, b, g, h = best[1]
        tree[node] = ("split", k, b)
        if last:
            tree[2 * node], tree[2 * node + 1] = ("leaf", value(g, h)), ("leaf", value(G - g, H - h))

    def score(self) -> Column:
        """Probability of label 1 as one expression over the feature columns."""
        cut = lambda k, b: F.coalesce(F.col(self.features[k]), F.lit(0.0)) <= self.cuts[k][b]
        margin = reduce(lambda a, b: a + b, [self._walk(t, 1, cut) for t in self.trees], F.lit(self.prior))
        return 1 / (1 + F.exp(-margin))


@dataclass
class UrlClassifier:
    """Boosted trees plus the suffix table they were fitted with (bounded by max_labelled rows)."""

    trees: BoostedTrees
    suffixes: dict[str, float]
    default: float

    @classmethod
    def fit(cls, df: DataFrame, url: str, label: str, max_labelled: int = 20_000) -> UrlClassifier:
        """Learn from at most max_labelled labelled rows (the first by a hash of the url); label 1 means block."""
        rows = df.where(F.col(label).isNotNull()).select(F.col(f"`{url}`").alias("url"), F.col(label).cast("int").alias("y"))
        rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled)
        rows = lexical(rows, "url").persist()
        stats = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
        total, ones = sum(r["n"] for r in stats), sum(r["ones"] for r in stats)
        default = (ones + 1) / (total + 2)
        suffixes = {r["suffix"]: (r["ones"] + 10 * default) / (r["n"] + 10) for r in stats if r["n"] >= 20}
        made = cls(BoostedTrees(list(FEATURES)), suffixes, default)
        made.trees.fit(made._with_rate(rows), "y")
        rows.unpersist()
        return made

    def _with_rate(self, df: DataFrame) -> DataFrame:
        rate = F.lit(self.default)
        if self.suffixes:
            table = F.create_map(*[x for k in sorted(self.suffixes) for x in (F.lit(k), F.lit(self.suffixes[k]))])
            rate = F.coalesce(F.try_element_at(table, F.col("suffix")), rate)
        return df.withColumn("suffix_rate", rate)

    def scored(self, df: DataFrame, url: str, name: str = "block_score") -> DataFrame:
        """df with a score from 0 to 1; a null url scores as the empty one."""
        kept = [F.col(f"`{c}`") for c in df.columns if c != name]
        inner = df.select(F.struct(*kept).alias("__row"), F.col(f"`{url}`").alias("__url"))
        out = self._with_rate(lexical(inner, "__url")).select("__row", self.trees.score().alias(name))
        return out.select("__row.*", name)


def judge(df: DataFrame, url: str, rules: Sequence[Rule], model: UrlClassifier | None = None, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict and block_score (columns of those names are replaced).

    The longest fitting rule decides; where none fits, the classifier does, fitted
    on the urls that the rules do decide unless one is given. A null url, or one
    without '://', has empty host and path and is judged by the classifier.
    Repeated rows get the same verdict; an empty table stays empty."""
    made = ("host", "path", "rule", "verdict", "block_score")
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, action = match_rules(rules, F.col("host"), F.col("path"))
    base = base.withColumn("rule", rule).withColumn("__action", action)
    if model is None:
        model = UrlClassifier.fit(base.withColumn("__y", F.expr("case __action when 'block' then 1 when 'allow' then 0 end")), url, "__y")
    out = model.scored(base, url)
    verdict = F.coalesce(F.col("__action"), F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("__action")

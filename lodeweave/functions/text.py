"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import lexicon as L


def compare_form(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks to a blank, blanks squeezed, trimmed."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def token_count(text: Column) -> Column:
    """Estimated tokens: letters 1 a piece up to four of them, else a quarter of the length; digits a third; marks 1."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(L.PIECE), F.lit(0))
    n = lambda p: F.length(p)
    cost = lambda p: (
        F.when(p.rlike("^[A-Za-z]"), F.greatest(F.lit(1), F.ceil(n(p) / 4))).when(p.rlike("^[0-9]"), F.greatest(F.lit(1), F.ceil(n(p) / 3))).otherwise(1)
    ).cast("long")
    return F.aggregate(F.transform(pieces, cost), F.lit(0).cast("long"), lambda a, x: a + x)


def truncate_to_tokens(text: Column, budget: int) -> Column:
    """The longest run of leading words (blank-separated) within the budget."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))
    step = lambda s, w: F.when(s["open"] & (s["used"] + token_count(w) <= budget), F.struct((s["used"] + token_count(w)).alias("used"), F.concat(s["kept"], F.array(w)).alias("kept"), F.lit(True).alias("open"))).otherwise(F.struct(s["used"].alias("used"), s["kept"].alias("kept"), F.lit(False).alias("open")))
    return F.array_join(F.aggregate(words, start, step)["kept"], " ")


def singular(token: Column) -> Column:
    """A cautious plural rule; tokens without a last s are left as they are at once."""
    n = F.length(token)
    cut = (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & token.endswith("sses"), F.substring(token, F.lit(1), n - 2))
        .when((n > 3) & ~token.endswith("ss") & ~token.endswith("us") & ~token.endswith("is"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )
    return F.when(token.endswith("s"), cut).otherwise(token)


def families(spark: SparkSession) -> DataFrame:
    """(token, canonical): the word families, a fixed small table to broadcast."""
    rows = ", ".join(f"('{word}', '{family[0]}')" for family in L.FAMILIES for word in family)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(token, canonical)")


def canonical_term(token: Column) -> Column:
    """Family canonical form, else a cautious plural rule, else the token. The table is searched for family words only."""
    table = F.create_map(*[F.lit(x) for family in L.FAMILIES for word in family for x in (word, family[0])])
    words = [word for family in L.FAMILIES for word in family]
    return F.when(token.isin(words), F.try_element_at(table, token)).otherwise(singular(token))


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Lexical tokens in order, as they stand (text already in NFKC form where that matters)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(L.TOKEN), F.lit(0))
    return found if keep_stopwords else F.filter(found, lambda t: ~t.isin(L.STOPWORDS))


def terms(text: Column, keep_stopwords: bool = False) -> Column:
    """Canonical lexical tokens in order."""
    return F.transform(tokens(text, keep_stopwords), canonical_term)


def term_rows(df: DataFrame, text: Column, keep: list[str], length: str | None = None) -> DataFrame:
    """A row per lexical token: the columns of keep, optionally how many there are, and term.

    Tokens are rows before they are canonicalised, by a broadcast join with the
    families, so the work per token is generated code."""
    found = df.select(*keep, tokens(text).alias("__t"))
    sized = [F.size("__t").alias(length)] if length else []
    rows = found.select(*keep, *sized, F.explode("__t").alias("token"))
    rows = rows.join(F.broadcast(families(df.sparkSession)), "token", "left")
    return rows.select(*keep, *([length] if length else []), F.coalesce("canonical", singular(F.col("token"))).alias("term"))


def repair_characters(text: Column) -> Column:
    """Ligatures, smart punctuation, invisible and control characters, line ends."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "�+", "")
    for glyph, plain in (L.LIGATURES | L.PUNCTUATION).items():
        out = F.replace(out, F.lit(glyph), F.lit(plain))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def repair_lines(text: Column) -> Column:
    """Words hyphenated over a line end are joined; ends that only wrap a sentence become blanks."""
    joined = F.regexp_replace(text, r"(\w)[-‐‑]\s*\n\s*([a-z])", "$1$2")
    return F.regexp_replace(joined, r"(?<![.:;!?•])\n(?!\s*\n)(?=[a-z(\"'])", " ")


def tidy_blanks(text: Column) -> Column:
    """Runs of blanks to one, at most one empty line, none before punctuation or at line ends."""
    out = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r" +([,;:.)\]])", "$1")
    out = F.regexp_replace(out, r"(?m)[ \t]+$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def is_page_number(line: Column) -> Column:
    out = F.lit(False)
    for pattern in L.PAGE_NUMBERS:
        out = out | line.rlike(pattern)
    return out & (F.trim(line) != "")


def is_noise(line: Column) -> Column:
    """No letter or digit; up to two characters that aren't digits; eight or more with under 35 % letters and digits."""
    s = F.trim(line)
    alnum = F.length(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    return (s != "") & ((alnum == 0) | ((F.length(s) <= 2) & ~s.rlike("^[0-9]+$")) | ((F.length(s) >= 8) & (alnum / F.length(s) < 0.35)))


def fingerprint(line: Column) -> Column:
    """Lower-cased, blanks squeezed; '' unless 4 to 120 characters."""
    key = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    return F.when(F.length(key).between(4, 120), key).otherwise("")


def masked_fingerprint(line: Column, words: int = 6) -> Column:
    """With digits masked, where the line says page or has few words; else ''."""
    s = F.trim(line)
    marker = s.rlike("[0-9]") & (s.rlike(r"(?i)\b(page|p\.|pg)\b") | (F.size(F.split(s, r"\s+")) <= words))
    key = F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")), "[0-9]+", "#")
    return F.when(marker & F.length(key).between(4, 120), key).otherwise("")


def section_label(line: Column) -> Column:
    """The heading's label, or null where the line isn't a heading."""
    s = F.trim(line)
    words = F.size(F.split(s, r"\s+"))
    first = F.rtrim(F.lower(F.substring_index(s, " ", 1)), F.lit(":."))
    prose = s.endswith(";") | s.endswith(",") | (s.endswith(".") & (words > 8) & ~s.rlike(L.NUMBERED_HEADING))
    heading = (
        s.rlike(L.LABELLED_HEADING) | s.rlike(L.NUMBERED_HEADING) | s.rlike(L.BARE_HEADING) | (s.rlike(L.CAPITAL_HEADING) & (words <= 12))
        | F.rtrim(F.lower(s), F.lit(":.")).isin(L.SECTION_NAMES) | (s.endswith(":") & (words <= 8) & s.rlike(r"^\p{Lu}"))
    )
    usable = (s != "") & (F.length(s) <= 120) & (words <= 14) & ~first.isin(L.FURNITURE_WORDS) & ~prose
    label = F.rtrim(F.substring(F.trim(F.regexp_replace(s, r"\s+", " "), F.lit(" :.–-")), 1, 100))
    return F.when(usable & heading & (label != ""), label)


def document_type(name: Column, text: Column) -> Column:
    """First kind in order of precedence one of whose hints occurs in the name or the first 800 characters."""
    hay = F.lower(F.concat(F.lit(" "), name, F.lit(" "), F.substring(text, 1, 800), F.lit(" ")))
    out = F.lit("unknown")
    for kind, hints in reversed(L.TYPE_HINTS):
        found = F.lit(False)
        for hint in hints:
            found = found | hay.contains(hint)
        out = F.when(found, kind).otherwise(out)
    return out


def mentions_reference(text: Column, number: str) -> Column:
    """Whether text has the clause number as a number: not within a word, a longer number or a decimal."""
    escaped = "".join("\\" + c if not c.isalnum() else c for c in number)
    return F.coalesce(text, F.lit("")).rlike(rf"(?<![\w.]){escaped}(?!\w)(?!\.\d)")


def clean_social(text: Column, stopwords: list[str]) -> Column:
    """Lower case without links, mentions and tags; repeats squeezed to two; punctuation, stopwords and single letters out."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)https?://\S+|www\.\S+|[@#]\w+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(.)\1{2,}", "$1$1"), r"(?U)[^\w\s]|\d|_", " ")
    words = F.filter(F.split(F.trim(out), r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.isin(stopwords))
    return F.array_join(words, " ")


def char_shingles(text: Column, size: int = 5) -> Column:
    """Distinct character n-grams of the compare form; a shorter text is its own only one."""
    n = F.lit(size)

    def grams(form: Column) -> Column:
        split = lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - size + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
        whole = F.get(F.transform(F.array(F.split(form, "")), split), F.lit(0))
        return F.when(form == "", F.array().cast("array<string>")).when(F.length(form) <= size, F.array(form)).otherwise(F.array_distinct(whole))

    # arrays of one bind the form and its characters once, not once a gram
    return F.get(F.transform(F.array(compare_form(text)), grams), F.lit(0))

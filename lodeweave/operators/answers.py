"""Extractive answers, reply parsing, citation and quotation checks, chat history."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import segments as sg
from lodeweave.functions import text as tx

NO_ANSWER = "The retrieved passages do not contain anything that answers this question. No answer can be given from the available evidence."


def split_sentences(text: Column) -> Column:
    """Abbreviation-aware sentences as an array (Arrow batches)."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sg.sentences(t or ""))

    return split(text)


def extractive_answers(sources: DataFrame, questions: DataFrame, max_sentences: int = 4, max_sources: int = 3) -> DataFrame:
    """(query_id, answer, cited, insufficient): best sentences by covered question terms, in source order.

    sources: (query_id, number, text), a few rows a query; questions: (query_id, terms)."""
    s = sources.select("query_id", "number", F.posexplode(split_sentences(F.col("text"))).alias("position", "sentence"))
    asked = questions.select("query_id", F.array_distinct("terms").alias("asked"))
    s = s.join(asked, "query_id").withColumn("shared", F.size(F.array_intersect("asked", tx.terms(F.col("sentence")))))
    s = s.where("shared > 0").withColumn("score", F.col("shared") / F.greatest(F.lit(1), F.size("asked")) - F.col("position") * 0.001)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "number", "position")
    s = s.withColumn("at", F.row_number().over(best)).withColumn("first", F.min("at").over(Window.partitionBy("query_id", "number")))
    s = s.withColumn("nth_source", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("nth_source") <= max_sources)
    s = s.withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("pick") <= max_sentences)
    made = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "position", "sentence"))).alias("x"))  # max_sentences at most
    made = made.select("query_id", F.array_join(F.transform("x", lambda r: r["sentence"]), " ").alias("answer"), F.array_sort(F.array_distinct(F.transform("x", lambda r: r["number"]))).alias("cited"))
    out = questions.select("query_id").join(made, "query_id", "left")
    return out.select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"), F.coalesce("cited", F.array().cast("array<int>")).alias("cited"), F.col("answer").isNull().alias("insufficient"))


def source_blocks(evidence: DataFrame) -> DataFrame:
    """(query_id, number, text) from rendered evidence blocks; only the shortening mark is dropped from a text."""
    rows = evidence.select("query_id", F.explode(F.split("evidence", "\n\n---\n\n")).alias("block"))
    number = F.regexp_extract("block", r"(?m)^Source (\d+):", 1)
    body = F.regexp_replace(F.regexp_extract("block", r"(?s)\nText:\n(.*)$", 1), r"(?m)\n?^\[… passage shortened;.*\]$", "")
    return rows.where(number != "").select("query_id", number.cast("int").alias("number"), body.alias("text"))


# --- replies ---------------------------------------------------------------------

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
# Characters that prose puts for JSON's own.
SMART = {"“": '"', "”": '"', "‘": "'", "’": "'", " ": " "}
REPLY = "answer string, cited array<int>, insufficient boolean, interpretation string, recovered boolean, error string"


def source_number(value) -> int | None:
    """A positive source number from a number or from text that holds one; else None."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        digits = re.search(r"\d+", value)
        value = int(digits[0]) if digits else None
    if isinstance(value, (int, float)) and value > 0 and value == int(value):
        return int(value)
    return None


def parse_reply(text: str | None) -> dict:
    """A reply's object, recovered from fences or prose where need be; error says why there is none."""
    out = {"answer": None, "cited": [], "insufficient": False, "interpretation": "", "recovered": False, "error": None}
    raw = (text or "").strip().translate(str.maketrans(SMART))
    fenced = _FENCE.search(raw)
    body = fenced[1].strip() if fenced else raw
    out["recovered"] = bool(fenced)
    found = None
    try:
        found = json.loads(body)
    except ValueError:
        at = body.find("{")
        if at >= 0:
            try:  # the decoder itself knows where the first object ends
                found, _ = json.JSONDecoder().raw_decode(body, at)
                out["recovered"] = True
            except ValueError:
                pass
    if not raw or not isinstance(found, dict) or "answer" not in found:
        return out | {"error": "empty reply" if not raw else "no 'answer' field" if isinstance(found, dict) else "no JSON object"}
    answer = found["answer"]
    if not isinstance(answer, str):
        answer = " ".join(map(str, answer)) if isinstance(answer, list) else "" if answer is None else str(answer)
        out["recovered"] = True
    flag = found.get("insufficient_evidence")
    out |= {"answer": answer.strip(), "insufficient": flag.strip().lower() in ("true", "yes", "1") if isinstance(flag, str) else bool(flag), "interpretation": str(found.get("interpretation") or "").strip()}
    given = found.get("citations")
    for entry in given if isinstance(given, list) else ():
        value = next((entry[k] for k in ("source", "source_number", "id") if k in entry), None) if isinstance(entry, dict) else entry
        number = source_number(value)
        if number is not None and number not in out["cited"]:
            out["cited"].append(number)
    if not out["answer"] and not out["insufficient"]:
        out["error"] = "empty answer"
    return out


def parse_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """replies plus a struct parsed (REPLY); a malformed reply is a row with an error, never an exception."""

    @F.pandas_udf(REPLY)
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_reply(t) for t in s], columns=[x.split()[0] for x in REPLY.split(", ")])

    return replies.withColumn("parsed", parse(F.col(text)))


def cited_numbers(answers: DataFrame) -> DataFrame:
    """(query_id, number, inline): what an answer lists, and what its prose mentions besides."""
    listed = answers.select("query_id", F.explode("cited").alias("number"), F.lit(False).alias("inline"))
    said = F.transform(F.regexp_extract_all("answer", F.lit(r"(?i)\bsources?\s*#?\s*(\d{1,3})\b"), F.lit(1)), lambda x: x.cast("int"))
    prose = answers.select("query_id", F.explode(said).alias("number"), F.lit(True).alias("inline"))
    return listed.union(prose).groupBy("query_id", "number").agg(F.min("inline").alias("inline"))


def check_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, number, inline, chunk_id, status): citations matched with the sources given; unknown ones rejected.

    Metadata comes from the source record, never from the answer."""
    known = sources.select("query_id", "number", "chunk_id", F.lit(True).alias("known"))
    out = cited_numbers(answers).join(known, ["query_id", "number"], "left")
    status = F.when(F.col("known"), "ok").when(F.col("inline"), "unknown_source_in_answer").otherwise("unknown_source")
    return out.select("query_id", "number", "inline", "chunk_id", status.alias("status"))


def check_quotes(answers: DataFrame, sources: DataFrame, min_words: int = 4) -> DataFrame:
    """(query_id, quote, verified): quotations of 12 to 400 characters and min_words words, looked for in all evidence."""
    hay = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", tx.compare_form(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("hay"))
    spans = answers.select("query_id", F.explode(F.regexp_extract_all("answer", F.lit('["“]([^"”]{12,400})["”]'), F.lit(1))).alias("quote"))
    spans = spans.withColumn("quote", F.trim("quote")).where(F.size(F.split("quote", r"\s+")) >= min_words)
    form = tx.compare_form(F.col("quote"))
    return spans.join(hay, "query_id", "left").select("query_id", "quote", ((form != "") & F.coalesce(F.contains("hay", form), F.lit(False))).alias("verified"))


def grounded(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, citations, rejected, unverified, grounded): the verdict on each answer."""
    c = check_citations(answers, sources).groupBy("query_id").agg(F.count_if(F.col("status") == "ok").alias("citations"), F.count_if(F.col("status") != "ok").alias("rejected"), F.count_if(F.col("status") == "unknown_source_in_answer").alias("invented"))
    q = check_quotes(answers, sources).groupBy("query_id").agg(F.count_if(~F.col("verified")).alias("unverified"))
    x = answers.select("query_id", "answer", "insufficient").join(c, "query_id", "left").join(q, "query_id", "left").na.fill(0, ["citations", "rejected", "invented", "unverified"])
    empty = (F.coalesce("answer", F.lit("")) != "") & ~F.col("insufficient") & (F.col("citations") == 0)
    return x.select("query_id", "citations", "rejected", "unverified", ((F.col("invented") == 0) & (F.col("unverified") == 0) & ~empty).alias("grounded"))


# What a caller may branch on.
OK, INSUFFICIENT, UNAVAILABLE, MISCONFIGURED, MALFORMED = "ok", "insufficient_evidence", "llm_unavailable", "llm_configuration_error", "malformed_response"
FAILURES = {"unavailable": UNAVAILABLE, "configuration": MISCONFIGURED}


def answer_status(answers: DataFrame) -> DataFrame:
    """answers (query_id, sources, failure, error, answer, insufficient) with status, and the fixed text where there is no evidence.

    No sources: insufficient, the model's reply isn't looked at. failure: what the
    provider ran into ('unavailable' or 'configuration'); error: why a reply isn't readable."""
    none = F.col("sources") == 0
    failed = F.coalesce(*[F.when(F.col("failure") == k, v) for k, v in FAILURES.items()])
    status = F.when(none, INSUFFICIENT).when(F.col("failure").isNotNull(), F.coalesce(failed, F.lit(UNAVAILABLE))).when(F.col("error").isNotNull(), MALFORMED).when(F.col("insufficient"), INSUFFICIENT).otherwise(OK)
    text = F.when(none, NO_ANSWER).when(status.isin(OK, INSUFFICIENT), F.coalesce("answer", F.lit(NO_ANSWER)))
    return answers.withColumn("status", status).withColumn("answer", text)


def answer_all(questions: DataFrame, evidence: DataFrame, provider, retries: int = 1) -> DataFrame:
    """(query_id, answer, cited, insufficient, status) of a batch of questions.

    provider: a function of a prompt Column that gives a reply Column (a registered
    one or your own). A reply that can't be read is asked for once more with a note on
    the format; questions without evidence never reach the provider."""
    asked = questions.select("query_id", "question").join(evidence.select("query_id", "evidence", "sources"), "query_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    ready = asked.withColumn("prompt", prompt(F.col("question"), F.coalesce("evidence", F.lit(""))))
    out = parse_replies(ready.withColumn("reply", F.when(F.col("sources") > 0, provider(F.col("prompt")))))
    for _ in range(retries):
        bad = F.col("parsed.error").isNotNull() & (F.col("sources") > 0)
        again = provider(F.concat("prompt", F.lit("\n\nReply with one JSON object only.")))
        out = parse_replies(out.withColumn("reply", F.when(bad, again).otherwise(F.col("reply"))))
    flat = out.select("query_id", "sources", F.lit(None).cast("string").alias("failure"), "parsed.*")
    return answer_status(flat).select("query_id", "answer", "cited", "insufficient", "status")


PROVIDERS: dict = {}


def register_provider(name: str, provider) -> None:
    """provider: prompt Column -> reply Column."""
    PROVIDERS[name] = provider


def provider(name: str):
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def prompt(question: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nEvidence:\n"), evidence)


# --- chat --------------------------------------------------------------------------


def trim_history(messages: DataFrame, limit: int = 6000, least: int = 2, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages whose estimated tokens (a quarter of the characters, 1 at least) fit the limit; always the last few."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    cost = F.greatest(F.lit(1), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4))
    x = messages.withColumn("__suffix", F.sum(cost).over(w)).withColumn("__back", F.row_number().over(w))
    return x.where((F.col("__suffix") <= limit) | (F.col("__back") <= least)).drop("__suffix", "__back")


def retrying(call: Callable, tries: int = 3, wait: float = 1.5, transient: tuple = (ConnectionError, TimeoutError), sleep: Callable = time.sleep) -> Callable:
    """call, asked again after transient errors, waiting twice as long each time; the last error is raised."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except transient:
                if i + 1 == tries:
                    raise
                sleep(wait * 2**i)

    return run


def chat_turn(history: DataFrame, said: DataFrame, provider, limit: int = 6000) -> DataFrame:
    """history (conv_id, turn, role, text) with what each user said and the reply to it.

    said: (conv_id, text), one row a conversation. The provider, prompt Column to reply
    Column, sees the trimmed history; where its reply is null the user's turn is taken back."""
    names = ["conv_id", "turn", "role", "text"]
    last = history.groupBy("conv_id").agg(F.max("turn").alias("last"))
    turn = (F.coalesce("last", F.lit(-1)) + 1).cast(history.schema["turn"].dataType)
    new = said.join(last, "conv_id", "left").select("conv_id", turn.alias("turn"), F.lit("user").alias("role"), "text")
    seen = trim_history(history.select(*names).join(new, "conv_id", "left_semi").unionByName(new), limit)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))  # limit bounds the list
    asked = seen.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))
    replied = asked.select("conv_id", provider(F.col("prompt")).alias("reply")).where("reply is not null")
    both = new.join(replied, "conv_id").select("conv_id", F.inline(F.array(
        F.struct("turn", F.lit("user").alias("role"), "text"),
        F.struct((F.col("turn") + 1).cast(history.schema["turn"].dataType).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")),
    )))
    return history.select(*names).unionByName(both)


def language_tags(text: Column, hindi: list[str], english: list[str]) -> Column:
    """(word, lang) structs of the blank-separated words: HI, EN or UNK."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"(?U)[^\w]", "")
    tag = lambda w: F.when(bare(w).isin(hindi), "HI").when(bare(w).isin(english), "EN").otherwise("UNK")
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("word"), tag(w).alias("lang")))


def sentence_report(text: Column, probability: Column, labels: list[str], hindi: list[str], english: list[str]) -> Column:
    """A struct (label, confidence, scores, word_tags, mix, error) of a sentence and its class probabilities; a blank text only has an error."""
    p = F.transform(probability, lambda x: F.round(x.cast("double"), 3))
    best = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(probability, F.array_max(probability)).cast("int"))
    tags = language_tags(text, hindi, english)
    share = lambda lang: F.round(F.size(F.filter(tags, lambda t: t["lang"] == lang)) / F.size(tags), 3)
    full = F.struct(
        best.alias("label"), F.array_max(p).alias("confidence"), F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p).alias("scores"), tags.alias("word_tags"),
        F.struct(share("HI").alias("hi"), share("EN").alias("en"), share("UNK").alias("unk")).alias("mix"), F.lit(None).cast("string").alias("error"),
    )
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(~blank, full).otherwise(F.named_struct(*[x for n in ("label", "confidence", "scores", "word_tags", "mix") for x in (F.lit(n), F.lit(None))], F.lit("error"), F.lit("no text")))


def language_mix(words: Column, hindi: list[str], english: list[str]) -> Column:
    """Shares of words tagged hi, en and unknown."""
    share = lambda test: F.size(F.filter(words, test)) / F.greatest(F.lit(1), F.size(words))
    hi, en = share(lambda w: w.isin(hindi)), share(lambda w: ~w.isin(hindi) & w.isin(english))
    return F.struct(hi.alias("hi"), en.alias("en"), (1 - hi - en).alias("unk"))

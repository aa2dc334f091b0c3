"""Python text splitting and token counting for the sequential operators."""

from __future__ import annotations

import re
from functools import lru_cache

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "Art Arts Sec Secs Cl Sch Ex Para Paras No Nos Fig pp p vs v cf al seq "
    "Inc Ltd LLC LLP Plc Co Corp Pvt Pte GmbH Mr Mrs Ms Dr Prof Hon St Jr Sr "
    "approx est incl excl min max Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec"
).split()
_STOP = re.compile(r"[.!?][\"')\]]*\s+(?=[\"'(\[]*[A-Z0-9])")
_LAST_WORD = re.compile(r"([A-Za-z](?:[A-Za-z.]*[A-Za-z])?)\.$")
_ITEM = re.compile(r"(?:^|(?<=[;:\n]))\s*(?=(?:\(\s*(?:[a-zA-Z]|[ivxlcdm]{1,7}|\d{1,3})\s*\)|(?:[a-z]|[ivx]{1,6})\)|\d{1,2}(?:\.\d{1,3}){1,3}[.)]?|\d{1,3}[.)]|[•▪-])\s)", re.M)


# PIECE with letters in parts of four, so that most pieces count by being found; only digit runs are measured
_COUNTED = re.compile(r"[A-Za-z]{1,4}|(\d[\d.,]*)|[^\sA-Za-z\d]")


@lru_cache(maxsize=8192)
def count(text: str) -> int:
    """Estimated tokens; the same rule as the Column function."""
    found = _COUNTED.findall(text or "")
    return len(found) + sum((len(digits) - 1) // 3 for digits in found if digits)


def surely_over(text: str, budget: int) -> bool:
    """Whether the length alone tells that count is over budget: a token has four characters at most, none of them blank."""
    return len(text) > 4 * budget and len("".join(text.split())) > 4 * budget


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n+", text or "") if p.strip()]


def items(text: str) -> list[str]:
    """Enumerated items, each starting at its mark."""
    return [p.strip() for p in _ITEM.split(text) if p and p.strip()]


def sentences(text: str) -> list[str]:
    """Sentence texts; stops of abbreviations and initials don't split."""
    out, start = [], 0
    for m in _STOP.finditer(text or ""):
        if m[0][0] == ".":
            before = _LAST_WORD.search(text[max(0, m.start() - 24) : m.start() + 1])
            if before and (before[1] in ABBREVIATIONS or re.fullmatch(r"(?:[A-Z]\.)*[A-Z]", before[1])):
                continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, (text or "")[start:].strip()] if s]


def within(text: str, budget: int) -> str:
    """The longest run of leading words within the budget."""
    used, kept = 0, []
    for word in text.split():
        used += count(word)
        if used > budget:
            break
        kept.append(word)
    return " ".join(kept)


def tail(text: str, budget: int) -> str:
    """Trailing whole sentences within the budget, else trailing words (one at least)."""
    if budget <= 0:
        return ""
    for parts, least in ((sentences(text), 0), (text.split(), 1)):
        used, kept = 0, []
        for part in reversed(parts):
            used += count(part)
            if used > budget and len(kept) >= least:
                break
            kept.append(part)
        if kept:
            return " ".join(reversed(kept))
    return ""

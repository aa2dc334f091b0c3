"""The kernels over every text of the pipeline against plain versions of them: equal results in less time."""

import random
import re
import time

import numpy as np
import xxhash

from lodeweave.llm import decontaminate, near_dup

ODD = ["", "a", "7", "A a", "x " * 50, "Ünï.\n Ëx 𝐀𝐁c 漢字𠀀. 𠀀 ٣٤ x_y _Z a1b2 3.A 1:2:b", "𝐀 12.5 ab", "." * 9, "_A:_b;C", "a\0A. \0b", "\ud800 x. Y z"]


def plain_shingles(text, n, known):
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    n, short = min(n, len(h)), len(h) < n
    out = np.full(len(h) - n + 1, n if short else 0, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * near_dup.PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out)


def plain_codes(text, known):
    marked = re.sub(r"((?:\A|[.!?:;\n])\W*)([^\W\d_])", "\\1\0\\2", text.replace("\0", "\1"))
    tokens = re.findall(r"\d+(?:[.,:/]\d+)*|\0?[^\W\d_]+", marked)
    codes = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    initial = codes >= decontaminate.INITIAL
    codes &= np.uint64(decontaminate.INITIAL - 1)
    after = np.zeros(len(codes), dtype=bool)
    after[1:] = codes[:-1] == decontaminate.NUMBER
    return tokens, np.where(after & (codes >= 64) & (codes & np.uint64(1) == 1), np.uint64(decontaminate.UNIT), codes), initial


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopéüß", k=rng.randint(2, 9))) for _ in range(3000)] + ["12", "3.5", "km", "Paris"]
    return [" ".join(w + rng.choice(["", "", "", "", ",", ". A"]) for w in rng.choices(words, k=500)) for _ in range(200)]


def seconds(*jobs):
    """The least CPU time of each job among rounds in turn."""
    best = [float("inf")] * len(jobs)
    for _ in range(7):
        for i, job in enumerate(jobs):
            began = time.thread_time()
            job()
            best[i] = min(best[i], time.thread_time() - began)
    return best


def test_shingles_are_the_plain_ones_in_less_time():
    made, known, docs = near_dup.Shingler(5), {}, texts()
    for text in docs + ODD:
        np.testing.assert_array_equal(made(text), plain_shingles(text, 5, known))
    fast, plain = seconds(lambda: [made(t) for t in docs], lambda: [plain_shingles(t, 5, known) for t in docs])
    assert fast < 0.92 * plain


def test_template_codes_are_the_plain_ones_in_less_time():
    made, known, docs = decontaminate.Templates(), decontaminate._Known(), texts()
    for text in docs + ODD:
        (tokens, *found), (expected, *plain) = made.codes(text), plain_codes(text, known)
        assert tokens == expected
        for a, b in zip(found, plain, strict=True):
            np.testing.assert_array_equal(a, b)
    fast, plain = seconds(lambda: [made.codes(t) for t in docs], lambda: [plain_codes(t, known) for t in docs])
    assert fast < 0.92 * plain

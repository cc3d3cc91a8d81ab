"""Features of one text: by plain loops over characters, and in linear time on single hard rows."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from sylvameter.llm import toxicity
from sylvameter.llm.toxicity import INSULTS, SECOND_PERSON, Lexicon

LEXICON = Lexicon({"zob": 2.0, "you": 1.6}, {"gram": 1.7, "gramp": 2.5})


def _runs(text, belongs):
    """(start, stop) of the runs of characters that belong."""
    out, start = [], None
    for i, c in enumerate(text + "\0"):
        if belongs(c) and i < len(text):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    return out


def _letter(c):
    return re.fullmatch(r"[^\W\d_]", c) is not None


def _masked(text):
    """Letter runs joined by runs of marks alone, two letter runs or more, as long as possible."""
    runs, out, i = _runs(text, _letter), [], 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and all(c in "0123456789@$*!|.-_" for c in text[runs[j][1] : runs[j + 1][0]]):
            j += 1
        if j > i:
            out.append(text[runs[i][0] : runs[j][1]])
        i = j + 1
    return out


def _plain(text):
    low = text.lower()
    words = [low[a:b] for a, b in _runs(low, _letter)]
    masked = _masked(text)
    leet = dict(zip("013457@$!|", "oieastasil", strict=True))
    seen = words + ["".join(c for c in "".join(leet.get(c, c) for c in m.lower()) if c.isalnum()) for m in masked]

    def lifts(w):
        return LEXICON.words.get(w, 0.0), max(LEXICON.starts.get(w[:4], 0.0), LEXICON.starts.get(w[:5], 0.0)) if len(w) > 3 else 0.0

    each = [lifts(w) for w in seen]
    hit = [i for i, w in enumerate(seen) if w in INSULTS or w in LEXICON.words or w[:4] in LEXICON.starts or w[:5] in LEXICON.starts]
    at = [min(i, len(words)) for i in hit]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(any(0 <= a - s <= 5 for a in at) or any(0 < s - a <= 5 for a in at) for s in second)
    n, size = max(1, len(words)), max(1, len(text))
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text)
    drawn = sum(text[i] == text[i - 1] == text[i - 2] and ord(text[i]) | 32 >= 97 and text[i] != "|" for i in range(2, len(text)))
    shouted = sum(b - a > 2 and text[a:b].isupper() for a, b in _runs(text, _letter)) if upper > size // 20 else 0
    by_word, by_start = sum(a > 0 for a, _ in each), sum(b > 0 for _, b in each)
    best = [max(x) for x in each] or [0.0]
    return [
        np.log1p(len(words)), sum(w in INSULTS for w in seen) / n, by_word / n, by_start / n, np.log1p(by_word), np.log1p(by_start), max(best),
        sum(best) / np.sqrt(n), len(second) / n, near / n, upper / size, shouted / n, sum(c in "!?" for c in text) / size, len(masked) / n, drawn / n,
    ]


def test_features_are_those_of_plain_loops():
    rng = random.Random(3)
    parts = ["you ", "zob", "Gramps", "g.r@m", "idiot", "1d10t", "ID!OT", " ", "..", "a-b", "_", "7", "é", "ÀÉÎ", "!!!", "?", "aaa", "||| ", "\n", "z0b ", "日本"]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert toxicity.features(text, LEXICON) == pytest.approx(_plain(text)), text


def test_one_row_of_any_kind_takes_linear_time():
    n = 1_000_000
    began = time.perf_counter()
    for text in ("well-known " + "x" * n, "." * n, "a" + "." * n + " b-c", "a." * (n // 2), "a1" * (n // 2) + "!", "é" * n, "!" * n + " a-b"):
        assert len(toxicity.features(text, LEXICON)) == toxicity.FEATURES
    assert time.perf_counter() - began < 30

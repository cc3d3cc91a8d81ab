"""The rule ledger against plain counting, and its policies and ablations on stored bits."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from sylvameter.llm import quality, queries
from sylvameter.llm.quality import POLICIES, RULES, Policy, Rule

DOCS = "doc_id long, text string, lang string, n_words int, failed string, kept string"


def _plain(text):
    """MEASURES by the words of the contract, quadratic."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bare = [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in lines]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
        sum(any(c.isalpha() for c in w) for w in words), sum(bool(re.match(r"[•‣▶●]|[-*] ", x)) for x in bare), sum(x.endswith(("...", "…")) for x in bare),
    )


TEXTS = [
    None, "", " \t\n\x0b\f\r", "a b c", "a b c a b c", "a a a a", "a a a", "one two three four", "x\n\nx\n x\nx ", "- item\n* item\n-\n- \n•x\n…\nend...\n ..", "日本 語\x00 𝒳𝒳 <#|>*$%&",
    "12 34 5a", "a b c d a b x b c d", "\x1c \x85 a", "w " * 49, "w1 " * 49 + "w2", " ".join(f"w{i}" for i in range(50)), "same line\n" * 60,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", None, "")[i % 3], 1, "clash", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "orphan", None, None, None, None), (1, "", "fr", 0, "", ""), (1, "", "fr", 0, "", "")], DOCS)


def test_measures(spark, odd):
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 80))) for _ in range(400)]:
        assert quality.measures(text or "") == _plain(text), text
    got = Counter(tuple(r) for r in quality.measure(odd, "doc_id").collect())
    assert got == Counter((r.doc_id, *_plain(r.text)) for r in odd.collect())


def test_repeated_words_are_exact_for_any_window():
    rng = np.random.default_rng(2)
    for window in (2, 3, 5):
        ids = rng.integers(0, 3, 60)
        seen = Counter(tuple(ids[i : i + window]) for i in range(61 - window))
        covered = {i + d for i in range(61 - window) if seen[tuple(ids[i : i + window])] > 1 for d in range(window)}
        assert quality.repeated_words(ids, 3, window) == len(covered)


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    assert quality.measures("x" * 3_000_000)[:2] == (1, 3_000_000)
    assert quality.measures("7 " * 500_000)[5:7] == (500_000, 0)
    assert quality.measures("a\n" * 500_000)[4] == 499_999
    assert time.perf_counter() - began < 20


def test_bits_and_policies(odd):
    stored = quality.ledger(odd)
    rows = quality.judge(stored).collect()
    assert len(rows) == odd.count()
    for r in rows:
        m = dict(zip(quality.MEASURES, (r[c] for c in quality.MEASURES), strict=True))
        fails = [eval(rule.fails, {}, m) for rule in RULES]  # noqa: S307 - arithmetic of this package
        assert r.failed == sum(1 << i for i, f in enumerate(fails) if f)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not any(fails))
    for p in POLICIES:
        names = {i for i, rule in enumerate(RULES) if rule.name in p.rules}
        assert stored.where(quality.passes(p)).count() == sum(not any(r.failed >> i & 1 for i in names) for r in rows)
    assert quality.ledger(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Policy("x", ("no_such_rule",)).mask()


def test_ablations_are_those_of_refiltering(odd):
    stored = quality.ledger(odd, RULES, "lang")
    rows = [(r.lang or "", r.failed) for r in stored.collect()]
    found = {(r.part, r.policy, r.rule): r for r in quality.ablations(stored, part="lang").collect()}
    assert len(found) == len({p for p, _ in rows}) * sum(len(p.rules) for p in POLICIES)
    for (part, version, rule), r in found.items():
        policy = next(p for p in POLICIES if p.version == version)
        without = Policy("w", tuple(x for x in policy.rules if x != rule)).mask()
        own = [f for p, f in rows if p == part]
        assert (r.n_docs, r.kept, r.kept_without, r.kept_alone) == (
            len(own), sum(not f & policy.mask() for f in own), sum(not f & without for f in own), sum(not f & Policy("a", (rule,)).mask() for f in own)
        )
        assert r.n_failed == r.n_docs - r.kept_alone and r.n_only == r.kept_without - r.kept
        assert (r.any_failed, r.all_failed) == (int(np.bitwise_or.reduce(own)) & policy.mask(), int(np.bitwise_and.reduce(own)) & policy.mask())
    assert quality.ablations(stored.limit(0)).count() == 0


def test_rules_are_a_parameter(odd):
    rules = (Rule("empty", "n_words = 0", True), Rule("long", "n_words > 10"))
    kept = quality.judge(quality.ledger(odd, rules), Policy("v", ("long",)), rules).where("kept")
    assert kept.count() == sum(0 < _plain(r.text)[0] <= 10 for r in odd.collect())


def test_queries(spark, data, same_rows):
    for name in ("op12_quality_rules", "quality_ablations"):
        same_rows(queries.QUERIES[name](spark, data), queries.ORACLE_SQL[name])

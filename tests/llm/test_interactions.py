"""The filter audit against plain application of every order, and on odd rows."""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

import pytest

from sylvameter.llm import interactions, queries

DOCS = "doc_id long, text string, lang string, A boolean, part string, n long, digest string"


def _failures(rows):
    """Per row: part, the letters that fail; by the words of the contract."""
    out = []
    for r in rows:
        text = r.text or ""
        words = [w.decode() for w in text.encode().split()]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in rows):
            fails.add("E")
        out.append((r.lang or "", r.doc_id, fails))
    return out


def _audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for part, doc_id, fails in _failures(rows):
        parts[part].append((doc_id, fails))
    out, shapley = {}, defaultdict(int)
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                redundant = sum(f in fails for _, fails in docs) - len(gone)
                alone = sum(fails == {f} for _, fails in docs)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _rows(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, copies across parts, repeated rows, names that clash."""
    prose = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, prose, "en"), (2, prose, "fr"), (2, prose, "fr"), (0, "", "en"), (3, None, None), (4, "", ""), (None, "", "en"), (None, prose, None),
        (5, "ABC " * 300, "en"), (6, "a b c " * 150, "de"), (7, prose + " #", "en"), (8, " \t\n\x0b\f\r", "en"),
        (9, "\x0b" + prose + "\f", "en"), (10, " ".join(f"v{i % 40_000}" for i in range(100_000)), "de"), (11, "É" * 33 + "A", "de"), (12, "É" * 32 + "A", "de"),
        (5, prose, "en"), (-1, prose + " #", "es"),
    ]
    return spark.createDataFrame([(*r, True, "clash", 1, "z") for r in rows], DOCS)


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (8, None, None)]


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert _rows(interactions.audit(odd, labels)) == _audit(odd.collect(), LABELS)


def test_audit_of_no_rows(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert interactions.audit(odd.limit(0), labels).count() == 0
    assert _rows(interactions.audit(odd, labels.limit(0))) == _audit(odd.collect(), [])


def test_flags_are_those_of_the_contract(odd):
    got = sorted((r.part, r.doc_id is None, r.doc_id or 0, *(r[c] for c in "ABCDE")) for r in interactions.failing(odd).collect())
    wanted = sorted((p, i is None, i or 0, *(c in f for c in "ABCDE")) for p, i, f in _failures(odd.collect()))
    assert got == wanted


def test_inversion_of_three_filters(spark):
    """Any number of filters: survivors of all sets, failures of one alone, and shares that add up."""
    flags = spark.createDataFrame([("p", bool(m & 1), bool(m & 2), bool(m & 4), m % 3 == 0, False) for m in (0, 1, 1, 3, 5, 7, 7, 4)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    joint = interactions.joint_failures(flags, "ABC")
    r = joint.select("n", interactions.survivors("n", 3).alias("left"), interactions.alone("n", 3).alias("alone"), interactions.shapley_sums("n", 3).alias("shares")).first()
    assert r.n == [8, 6, 3, 3, 4, 3, 2, 2]
    assert r.left == [8, 2, 5, 2, 4, 1, 3, 1]
    assert r.alone == [2, 0, 1]
    assert sum(r.shares) == 6 * 7  # what all filters remove, in each of six orders
    assert interactions.by_order(joint, "ABC").count() == 18


def test_query(spark, data, same_rows):
    same_rows(queries.op13_filter_interactions(spark, data), queries.ORACLE_SQL["op13_filter_interactions"])

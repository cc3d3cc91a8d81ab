"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from sylvameter.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows, least=0.8):
    sets = {i: _shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        common = len(sets[i] & sets[j])
        if common >= least * (len(sets[i]) + len(sets[j]) - common):
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    return {i for i in up if top(i) == i}


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, data):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice((60, 150, 400)))]
        for share in (0, 0, 0.01, 0.015, 0.02, 0.03, 0.05):
            rows.append((len(rows), " ".join(word() if rng.random() < share else w for w in base)))
    drifting = [word() for _ in range(200)]  # neighbours are similar, the ends are not
    for _ in range(25):
        rows.append((len(rows), " ".join(drifting)))
        drifting[rng.randrange(200)] = word()
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b", "a b", "a c", "x " * 50, "x " * 90, "x " * 50 + "y"])]
    wanted = _kept(rows)
    assert len(wanted) < len(rows) - 80
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(4)
    got = corpus_pipeline.near_dedup(spark, df, data)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(wanted)
    assert {r.doc_id for r in neardup.representatives(df, large=2).collect()} == wanted


def test_every_row_counts_by_itself(spark, data):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = [" ".join(word() for _ in range(40)) for _ in range(5)]
    rows = [(None, text[0]), (7, text[1]), (7, text[2]), (8, text[3]), (8, text[3]), (None, text[3]), (None, text[4]), (None, text[4]), (9, None), (3, " \n")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, data).collect()), key=repr)
    assert got == sorted([(None, text[0]), (7, text[1]), (7, text[2]), (8, text[3]), (None, text[4]), (3, " \n")], key=repr)
    assert neardup.representatives(df.limit(0)).count() == 0


def test_nodes_of_the_main_component_do_not_ask(spark):
    """One bucket with a large component and a few others: as many rows as it has, and all links across are found."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 100).astype(np.uint8)
    rows = [(i, base.tobytes(), 1 if i < 300 else i) for i in range(310)]
    schema = "bucket long, outside boolean, n long, node long, component long, sketch binary, buckets array<long>"
    df = spark.createDataFrame([(5, c != 1, 10, i, c, bytearray(s), [5]) for i, s, c in rows], schema)
    dealt = []

    def search(members, asks):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([len(members)]), pa.array([int(asks.sum())])], ["n", "asks"])

    dealt = [(r.n, r.asks) for r in neardup._by_bucket(df, 4, search, "n long, asks long").collect()]
    assert len(dealt) == 3 and all(n == 310 for n, _ in dealt) and sum(a for _, a in dealt) == 10
    texts = spark.createDataFrame([(i, "a b c d e f g") for i in range(310)], "node long, text string")
    found = neardup._across(df, lambda wanted: neardup._shingles(texts.join(wanted, "node"), 5), 0.8, 4).collect()
    assert {i for r in found for i in (r.a, r.b) if i >= 300} == set(range(300, 310))

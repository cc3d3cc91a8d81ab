"""The kept index after any changes against an index made anew, counted in plain Python."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylvameter.functions import text as text_functions
from sylvameter.operators.termindex import State, TermIndex

DOCS = "doc_id long, text string, tags array<string>, project string"
SITES = [
    (1, "canopy canopy mangrove water restoration site", ["canopy", "mangrove", "water"], "KEN-08"),
    (2, "canopy canopy canopy mangrove water", ["canopy", "mangrove", "WATER"], "KEN-08"),
    (3, "canopy mangrove mangrove water tidal", ["canopy", "mangrove", "water", "tidal"], "KEN-08"),
    (4, "canopy forest dryland pine", ["canopy", "forest", "dryland"], "TUR-101"),
    (5, "forest bare soil overcast pine", ["forest", "bare_soil", "overcast"], "TUR-101"),
    (6, "infrastructure urban harsh sun", ["infrastructure", "urban"], "ESP-200"),
    (7, "infrastructure sky bare soil", ["infrastructure", "sky"], None),
]


def _terms(text, tags=()):
    out = []
    for source in (text or "", " ".join(tags or [])):
        word = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in source.lower())
        out = [text_functions.SYNONYMS.get(w, w) for w in word.split() if len(w) > 1 and w not in text_functions.STOP_WORDS]
        if out:
            break
    return out


class _Anew:
    """The scores of an index of ``docs`` {id: (text, tags, project)}."""

    def __init__(self, docs):
        self.docs = docs
        self.tf = {i: Counter(_terms(t, tags)) for i, (t, tags, _) in docs.items()}
        self.df = Counter(t for tf in self.tf.values() for t in tf)

    def _vector(self, tf):
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(self.docs)) / (1 + self.df[t])) + 1 if t in self.df else 1.0) for t, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    def scores(self, tf, without=None):
        asked = self._vector(tf)
        found = {i: sum(asked.get(t, 0.0) * w for t, w in self._vector(own).items()) for i, own in self.tf.items() if i != without}
        return {i: (round(s, 8), tuple(sorted(set(tf) & set(self.tf[i]))[:12])) for i, s in found.items() if s > 0}


def _same(index, anew, queries=("mangrove water canopy forest", "tidal zeppelin river photo")):
    assert len(index) == len(anew.docs) == index.documents().count()
    assert {r.term: r.df for r in index.vocabulary().collect()} == dict(anew.df)
    for q in queries:
        got = {r.doc_id: (round(r.score, 8), tuple(r.matched)) for r in index.search(q, 100).collect()}
        want = anew.scores(Counter(_terms(q)))
        assert set(got) == set(want) and all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0], abs=2e-8) for i in got), q
        assert {r.term for r in index.unmatched(q).collect()} == set(_terms(q)) - set(anew.df)
    for i in list(anew.docs)[:1]:
        got = {r.doc_id: r.score for r in index.similar_to(i, 100).collect()}
        assert got == pytest.approx({j: s for j, (s, _) in anew.scores(anew.tf[i], i).items()}, abs=2e-8)


def _plain(rows):
    return {r[0]: r[1:] for r in rows if r[0] is not None}


def test_changes_equal_an_index_made_anew(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "index"), buckets=4)
    assert len(index) == 0 and index.search("mangrove").count() == 0 and index.similar_to(1).count() == 0
    index.add(spark.createDataFrame(SITES[:4], DOCS))
    now = _plain(SITES[:4])
    # more documents; one replaced, one by its tags, one without a term, one without an id
    more = [*SITES[4:], (2, "tidal forest", ["canopy"], "KEN-08"), (8, " the of ", ["Creek", "drone"], "X"), (9, None, None, None), (None, "mangrove", None, None)]
    index.add(spark.createDataFrame(more, DOCS))
    now |= _plain(more)
    _same(index, _Anew(now))
    index.remove(spark.createDataFrame([(1,), (8,), (99,), (1,)], "doc_id long"))
    del now[1], now[8]
    _same(index, _Anew(now))
    index.add(spark.createDataFrame([SITES[0]], DOCS))  # one that was there before
    now |= _plain([SITES[0]])
    index.compact()
    _same(index, _Anew(now))
    assert len(index.state().generations) == 1
    index.remove(index.documents())
    _same(index, _Anew({}), ("mangrove",))
    again = TermIndex(spark, index.folder, buckets=4)
    again.add(spark.createDataFrame(SITES, DOCS))
    _same(again, _Anew(_plain(SITES)))


def test_behaviour_of_a_search(spark):
    index = TermIndex(spark, buckets=3)
    index.add(spark.createDataFrame(SITES, DOCS))
    hits = index.search("mangrove water canopy").orderBy(F.desc("score")).collect()
    assert {h.doc_id for h in hits[:3]} == {1, 2, 3} and hits[0].score > 4 * hits[3].score
    assert {h.doc_id for h in index.search("canopy soil sky", project="ESP-200").collect()} == {7}  # of the project, or of none
    assert {h.doc_id for h in index.search("canopy", tags=["Water"]).collect()} == {1, 2, 3}
    assert {h.doc_id for h in index.similar_to(1, 2).collect()} == {2, 3} and index.similar_to(99).count() == 0
    assert index.search("  ").count() == 0 and index.search("rhizophora").count() == 3
    assert index.search("sapling", 1).collect()[0].excerpt == SITES[3][1]


def test_change_that_fails_counts_for_nothing(spark, monkeypatch):
    index = TermIndex(spark, buckets=2)
    index.add(spark.createDataFrame(SITES[:4], DOCS))
    with monkeypatch.context() as patch:
        patch.setattr(TermIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.add(spark.createDataFrame(SITES[4:], DOCS))
    _same(index, _Anew(_plain(SITES[:4])), ("forest canopy",))
    index.add(spark.createDataFrame(SITES[5:], DOCS))  # writes over what was left behind
    _same(index, _Anew(_plain(SITES[:4] + SITES[5:])), ("forest canopy",))


def test_question_reads_its_terms_alone(spark):
    index = TermIndex(spark, buckets=8)
    index.add(spark.createDataFrame(SITES, DOCS))
    plan = index._scores(index.state(), {"mangrove": 1})._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "tf" in x)
    assert "bucket" in scan[scan.index("PartitionFilters") :] and "In(bucket" not in scan[scan.index("PushedFilters") :]
    assert index._read("postings", [1]).where(index._bucket(F.lit("mangrove")) == F.col("bucket")).select("term").distinct().count() < 6
    assert index.state() == State((1,), 7)

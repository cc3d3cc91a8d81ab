"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The features of a text are densities of two lexicons, how near the second person stands to their words, shares of
capitals, of exclamation and question marks and of obfuscated or drawn-out words, and its length. One lexicon is a short fixed list.
The other holds words and word beginnings that labelled training rows show mostly in toxic texts. Both the lexicon
and the trees are fitted on a bounded sample: at most about ``sample`` rows of each label. Training rows get their
lexicon features from a lexicon that did not see their fold. Rows that the trees did not see calibrate the margin, and
sampled rows weigh as many as they stand for. Every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.boosting import Boosted, boost, isotonic
from sylvameter.llm.common import slices, unit_hash, unused
from sylvameter.session import materialise

#: A short general list of insults, and words of the second person in four languages.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers trash scum worthless pathetic disgusting clown dumb imbecile fool "
    "garbage filth vermin scumbag bastard crap hate ugly freak coward liar retard dumbass asshole bitch fuck shit "
    "imbécile crétin connard salaud ordure abruti dummkopf arschloch drecksack abschaum trottel depp "
    "estúpido imbécil basura idiota asqueroso tonto gilipollas cabrón".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ur tu te toi ton tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tus "
    "usted ustedes vosotros contigo".split()
)
#: Characters that stand for letters in disguised words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_WORD = re.compile(r"[^\W\d_]+")
# both begin at the first character of a run and give nothing back, so that a run of any length is read once
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!|.\-_]++[^\W\d_]++)++")
_BETWEEN = re.compile(r"(?<![0-9@$*!|.\-_])[0-9@$*!|.\-_]++(?=[^\W\d_])")
_NEAR = 5
FEATURES = 15
FOLDS = 2


def terms(text: str) -> set[str]:
    """The words of a text, with their beginnings of four and five letters marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words if len(w) > 3 for n in (4, 5) if len(w) >= n}


@dataclass(frozen=True)
class Lexicon:
    """Log odds of words and of word beginnings."""

    words: dict[str, float]
    starts: dict[str, float]

    @classmethod
    def of(cls, toxic: Counter, clean: Counter, n_toxic: float, n_clean: float, least: int = 3, z: float = 2.5, odds: float = 1.5) -> Lexicon:
        """Terms of at least ``least`` toxic rows whose log odds are at least ``odds`` and ``z`` standard errors."""
        words, starts = {}, {}
        for term, n in toxic.items():
            if n < least:
                continue
            m = clean.get(term, 0)
            lift = float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((m + 0.5) / (n_clean + 1)))
            if lift >= odds and lift >= z * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)):
                (starts if term[-1] == "*" else words)[term.rstrip("*")] = lift
        return cls(words, starts)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The FEATURES numbers of one whole text."""
    words = _WORD.findall(text.lower())
    masked = _MASKED.findall(text) if _BETWEEN.search(text) else []
    plain = [re.sub(r"[\W_]", "", x.lower().translate(_LEET)) for x in masked]
    n = max(1, len(words))
    known, starts = lexicon.words, lexicon.starts
    hits = {w for w in {*words, *plain} if w in known or w[:4] in starts or w[:5] in starts or w in INSULTS}
    at, fixed, by_word, by_start, best, total = [], 0, 0, 0, 0.0, 0.0
    if hits:
        for i, w in enumerate(words + plain):
            if w in hits:
                lift = known.get(w, 0.0)
                first = max(starts.get(w[:4], 0.0), starts.get(w[:5], 0.0)) if len(w) > 3 else 0.0
                fixed += w in INSULTS
                by_word += lift > 0
                by_start += first > 0
                lift = max(lift, first)
                total += lift
                best = max(best, lift)
                at.append(min(i, len(words)))
    near, second = 0, [i for i, w in enumerate(words) if w in SECOND_PERSON] if not SECOND_PERSON.isdisjoint(words) else []
    if at and second:
        places = np.searchsorted(at, second)
        for s, p in zip(second, places, strict=True):
            near += (p < len(at) and at[p] - s <= _NEAR) or (p > 0 and s - at[p - 1] <= _NEAR)
    size = max(1, len(text))
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper = int(np.count_nonzero((c >= 65) & (c <= 90) | (c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)))
    drawn = int(np.count_nonzero((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & ((c[2:] | 32) >= 97) & (c[2:] != 124)))
    shouted = sum(1 for w in _WORD.findall(text) if len(w) > 2 and w.isupper()) if upper > size // 20 else 0
    return [
        np.log1p(len(words)), fixed / n, by_word / n, by_start / n, np.log1p(by_word), np.log1p(by_start), best,
        total / np.sqrt(n), len(second) / n, near / n, upper / size, shouted / n,
        (text.count("!") + text.count("?")) / size, len(masked) / n, drawn / n,
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.array([features(t or "", self.lexicon) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.update((t, toxic, fold) for t in terms(text))
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()),
         pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())],
        ["term", "toxic", "fold", "n"],
    )


def train(docs: DataFrame, labels: DataFrame, learns: Column, sample: int = 10_000) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text) that have a label (doc_id, toxic) and that ``learns`` selects.

    At most about ``sample`` rows of each label are used. A document with several labels is toxic if one says so; null
    labels are none. None where a label is missing altogether, as it is where either table is empty.
    """
    spark = docs.sparkSession
    marks = labels.where(learns & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    held = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(held) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample / held[1])).otherwise(min(1.0, sample / held[0]))
    chosen = marks.where(unit_hash(F.col("doc_id")) < share)  # at most about 2 * sample rows
    rows = materialise(
        docs.join(F.broadcast(chosen), "doc_id").select(
            F.coalesce("text", F.lit("")).alias("text"), "toxic",
            F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"),
            (F.pmod(F.xxhash64("text", F.lit("calibrate")), F.lit(4)) == 0).alias("calibrates"),
        )
    )
    n = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    if len({toxic for toxic, _ in n}) < 2:  # no document has one of the labels
        return None
    counted = rows.select("text", "toxic", "fold").mapInArrow(_count_terms, "term string, toxic int, fold int, n long")
    by_term = counted.groupBy("term").agg(
        *[F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}{k}") for y in (0, 1) for k in range(FOLDS)]
    )
    # only terms of several sampled toxic rows come to the driver: bounded by the sample
    used = by_term.where(sum(F.col(f"n1{k}") for k in range(FOLDS)) >= 3).toPandas()

    def lexicon(folds: list[int]) -> Lexicon:
        total = [dict(zip(used.term, used[[f"n{y}{k}" for k in folds]].sum(axis=1), strict=True)) for y in (0, 1)]
        return Lexicon.of(total[1], total[0], *(sum(n.get((y, k), 0) for k in folds) for y in (1, 0)))

    unseen = spark.sparkContext.broadcast([lexicon([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [[float(v) for v in features(t, unseen.value[k])] for t, k in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), *batch.columns[2:]], ["x", "toxic", "calibrates"])

    measured = rows.select("text", "fold", "toxic", "calibrates").mapInArrow(measure, "x array<double>, toxic int, calibrates boolean")
    table = measured.toPandas()
    order = np.lexsort([*np.array(table.x.tolist()).T, table.toxic])  # rows come in no fixed order
    x, y = np.array(table.x.tolist())[order], table.toxic.to_numpy(np.float64)[order]
    c = table.calibrates.to_numpy()[order]
    weight = np.where(y > 0, held[1] / max(1, y.sum()), held[0] / max(1, (1 - y).sum()))
    weight /= weight.mean()
    if len(set(y[c])) < 2 or len(set(y[~c])) < 2:
        c = np.zeros(len(y), bool)
    trees = boost(x[~c], y[~c], weight[~c])
    at = c if c.any() else ~c
    return Model(lexicon(list(range(FOLDS))), trees, isotonic(trees.margin(x[at]), y[at], weight[at]))


def score_toxicity(docs: DataFrame, model: Model | None, *carried: str) -> DataFrame:
    """The ``carried`` columns with score and predicted for each row of ``docs``; only ``text`` is looked at.

    A null text counts as empty; every row has a score, a text of any length is read whole, and repeated rows get the
    same one. Without a model (no labels) the score is 0. No rows give no rows. Where a carried column has one of these
    names, the new one gets an underscore.
    """
    columns = [F.col(f"`{c}`") for c in carried]
    names = [*carried, *(unused(k, list(carried)) for k in ("score", "predicted"))]
    schema = docs.select(*columns).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = shared.value.scores(texts) if shared.value else np.zeros(len(texts))
            new = [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    out = schema.add(names[-2], "double").add(names[-1], "integer")
    return docs.select(*columns, F.col("text").alias(unused("text", docs.columns))).mapInArrow(score, out)

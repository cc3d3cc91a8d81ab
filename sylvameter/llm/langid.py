"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts are learned from a bounded sample of labelled rows for each language (``sample`` rows each, chosen by a hash
of the id and text); the priors are those of all rows. The log-probability matrix, buckets by languages, goes to the
executors as a broadcast whose size is ``buckets`` times the number of languages. A batch of texts is one sparse matrix
of n-gram counts, held as rows and buckets, whose product with the broadcast matrix scores every text whole. Log
probabilities are fixed-point numbers, so sums do not depend on how rows are batched.

A posterior says which language is nearest, not that a text is in any of them. ``fit`` says that: by how much the mean
log probability of the text's n-grams lies above the median of the language's own texts, which sampled rows show that
the counts did not see. Texts of other languages and scripts, encoded data and noise lie far below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import slices, unit_hash, unused
from sylvameter.llm.ngrams import batch_grams, codes

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
UNDETERMINED = "und"
_ONE = float(1 << 20)


def _sums(texts: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) sums of the weights of all n-grams, and the number of n-grams of each text."""
    total, n = np.zeros((len(texts), weights.shape[1]), np.int64), np.zeros(len(texts), np.int64)
    columns = list(np.ascontiguousarray(weights.T))
    for rows, buckets in batch_grams(texts, ORDERS, BUCKETS):
        if len(rows):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            for k, column in enumerate(columns):
                total[rows[first], k] += np.add.reduceat(column[buckets], first, dtype=np.int64)
            n[rows[first]] += np.diff(first, append=len(rows))
    return total, n


@dataclass(frozen=True)
class Model:
    """Languages in order, fixed-point log probabilities (buckets, languages), log priors, and what the mean log
    probability of an n-gram in a text of each language is."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray
    usual: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior and fit of each text; ``und``, 0 and NaN for those without a letter."""
        found = [codes(t) if t and any(map(str.isalpha, t)) else np.empty(0, np.uint32) for t in texts]
        sums, n = _sums(found, self.weights)
        total = sums / _ONE + self.priors
        best = total.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
        row = np.arange(len(texts))
        score = np.where(n > 0, 1 / np.exp(total - total[row, best][:, None]).sum(axis=1), 0.0)
        some = np.maximum(n, 1)
        fit = np.where(n > 0, sums[row, best] / _ONE / some - self.usual[best], np.nan)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)], score, fit


def _usual(lang: np.ndarray, mean: np.ndarray, n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """For each language the median of the means of the longer half of its texts; ``expected`` where there are few."""
    out = expected.copy()
    for k in range(len(expected)):
        m, size = mean[lang == k], n[lang == k]
        if len(m) >= 8:
            out[k] = np.median(m[size >= np.median(size)])
    return out


def train(docs: DataFrame, learns: Column, sample: int = 4000) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) where ``learns``; None where no row has a language.

    At most about ``sample`` rows for each language are read; with fewer, all of them. An eighth of these does not count
    n-grams but shows what is usual.
    """
    usable = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not held:
        return None
    languages = tuple(sorted(held))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / held[k])))])
    some = F.col("lang").isin([k for k in languages if held[k] >= 64])
    fits = (F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(8)) == 0) & some
    chosen = usable.where(unit_hash(F.col("doc_id"), F.col("text")) < F.element_at(share, F.col("lang")))
    chosen = chosen.select("text", "lang", fits.alias("fits"))
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(iter([batch]), 0):
                texts = [codes(t) for t in part.column(0).to_pylist()]
                langs = np.array([place[x] for x in part.column(1).to_pylist()], np.int64)
                for rows, buckets in batch_grams(texts, ORDERS, BUCKETS):
                    sums += np.bincount(langs[rows] * BUCKETS + buckets, minlength=sums.size).reshape(sums.shape)
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array(sums[which, bucket])], ["lang", "bucket", "n"])

    parts = chosen.where(~F.col("fits")).select("text", "lang").mapInArrow(count, "lang long, bucket long, n long")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages times buckets at most
    counts = np.zeros((len(languages), BUCKETS))
    counts[table.lang, table.bucket] = table.n
    smoothed = counts + 0.5
    weights = np.rint(np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T * _ONE).astype(np.int32)
    rows = np.array([held[k] for k in languages], float)
    priors = np.log((rows + 1) / (rows + 1).sum())
    weights = np.ascontiguousarray(weights)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            sums, n = _sums([codes(t) for t in batch.column(0).to_pylist()], shared.value)
            some = n > 0
            mean = sums[np.arange(len(n)), langs][some] / _ONE / n[some]
            yield pa.RecordBatch.from_arrays([pa.array(langs[some]), pa.array(mean), pa.array(n[some])], ["lang", "mean", "n"])

    shown = chosen.where("fits").select("text", "lang").mapInArrow(measure, "lang long, mean double, n long").toPandas()
    shown = shown.sort_values(["lang", "mean", "n"])  # three numbers for each row of the sample
    expected = (smoothed / smoothed.sum(axis=1, keepdims=True) * weights.T / _ONE).sum(axis=1)
    usual = _usual(shown.lang.to_numpy(), shown["mean"].to_numpy(), shown.n.to_numpy(), expected)
    return Model(languages, weights, priors, usual)


def identify(docs: DataFrame, model: Model | None, *carried: str) -> DataFrame:
    """The ``carried`` columns with lang_pred, score and fit, for each row of ``docs``; only ``text`` is looked at.

    Null and empty texts and those without a letter are ``und`` with score 0 and no fit, as is every text where no
    language was there to learn. A text of any length is scored whole; repeated rows get the same result each; no rows
    give no rows. Where a carried column has one of these names, the new one gets an underscore.
    """
    names = [*carried, *(unused(k, list(carried)) for k in ("lang_pred", "score", "fit"))]
    kept = docs.select(*[F.col(f"`{c}`") for c in carried])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = shared.value.predict(texts) if shared.value else ([UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan))
            new = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    out = kept.schema.add(names[-3], "string").add(names[-2], "double").add(names[-1], "double")
    columns = [F.col(f"`{c}`") for c in carried]
    return docs.select(*columns, F.col("text").alias(unused("text", docs.columns))).mapInArrow(score, out)


def in_a_language(docs: DataFrame, model: Model | None, least_score: float, least_fit: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a language that the model tells.

    Those without a letter go, those whose posterior is below ``least_score``, and those whose fit is below
    ``least_fit``. Without a model (no row says what languages there are) every text with a letter stays.
    """
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = batch.column(place).to_pylist()
            if shared.value is None:
                good = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
            else:
                langs, score, fit = shared.value.predict(texts)
                told = np.array([x != UNDETERMINED for x in langs], bool)
                good = told & (score >= least_score) & (np.nan_to_num(fit, nan=-np.inf) >= least_fit)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

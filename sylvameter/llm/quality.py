"""Quality rules as a ledger of bits: each rule is evaluated once, and policies are read off the bits.

One pass takes the measurements of every whole text. The rules are then evaluated on the measurements, each into a bit
of its own, and the ledger (measurements and bits) is stored. A policy is a version and a mask of rules; a document stays
if its bits and the mask have nothing in common, so a new version needs no text. What a policy loses by each of its rules
comes from one aggregation of the masked bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import slices
from sylvameter.session import materialise

#: Characters that separate words, and those that count as symbols.
SPACE, SYMBOLS = b" \t\n\x0b\f\r", b"#*$%&|<>"
#: In this order: words; code points in words; symbols; lines with a word; lines equal to an earlier one; words in
#: windows of three that occur twice or more; words with a letter; lines that begin as a list item; lines that end in dots.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_list_lines", "n_dotted_lines")
#: How a list item begins and how a line that was cut off ends.
_ITEM = tuple(x.encode() for x in ("•", "‣", "▶", "●", "- ", "* "))
_DOTS = tuple(x.encode() for x in ("...", "…"))


@dataclass(frozen=True)
class Rule:
    """A rule by name; ``fails`` is SQL over the measurements. Its bit is its place among the rules."""

    name: str
    fails: str
    base: bool = False


#: In bit order; new rules go to the end, so that stored bits stay true. Bounds are those of published web filters, but
#: for word length, which leaves room for languages with long words.
RULES = (
    Rule("few_words", "n_words < 50", True),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words", True),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("few_letters", "100 * n_letter_words < 80 * n_words"),
    Rule("list", "100 * n_list_lines > 90 * n_lines"),
    Rule("cut_off", "100 * n_dotted_lines > 30 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of its rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(name) for name in set(self.rules))


_BASE = tuple(r.name for r in RULES if r.base)
POLICIES = (
    Policy("base", _BASE),
    Policy("shape", (*_BASE, "short_words", "long_words", "symbols", "few_letters")),
    Policy("full", tuple(r.name for r in RULES)),
)


def repeated_words(ids: np.ndarray, n_distinct: int, window: int = 3) -> int:
    """How many words lie in a window that occurs twice or more; ``ids`` number the words, exactly.

    Windows grow by one word at a time and are renumbered, so that no number exceeds distinct windows times words.
    """
    if len(ids) <= window:
        return 0
    seen = ids
    for k in range(1, window):
        seen = seen[:-1] * n_distinct + ids[k:]
        _, seen, counts = np.unique(seen, return_inverse=True, return_counts=True)
    starts = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(counts[seen] > 1)
    starts[again] += 1
    starts[again + window] -= 1
    return int(np.count_nonzero(np.cumsum(starts)))


def measures(text: str) -> tuple[int, ...]:
    """The values of MEASURES for one text, in time that grows as n log n."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # by SPACE alone, as this is bytes
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lettered = np.fromiter((any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))) for w in number), bool, len(number))
    lines = [x for x in data.split(b"\n") if x.strip()]
    bare = [x.strip() for x in lines]
    return (
        len(words),
        len(text) - len(data) + len(data.translate(None, SPACE)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(number)),
        int(np.count_nonzero(lettered[ids])) if len(ids) else 0,
        sum(x.startswith(_ITEM) for x in bare),
        sum(x.endswith(_DOTS) for x in bare),
    )


def measure(docs: DataFrame, *carried: str) -> DataFrame:
    """The ``carried`` columns and MEASURES of each row of ``docs`` (text). A null text has zeros throughout."""
    kinds = docs.select(*[F.col(f"`{c}`") for c in carried], *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            found = [measures(t or "") for t in batch.column(n).to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + columns, [*carried, *MEASURES])

    return docs.select(*[F.col(f"`{c}`") for c in carried], F.col("text").cast("string")).mapInArrow(run, kinds)


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of the rules that fail, over columns of measurements."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(r.fails), 1 << i).otherwise(0).cast("long") for i, r in enumerate(rules)])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *carried: str) -> DataFrame:
    """The stored ledger: doc_id, ``carried``, MEASURES, and ``failed`` with a bit for each rule that fails.

    One row for each row of ``docs`` (doc_id, text): a null text counts as one without words, a null id and repeated rows
    stay, texts of any length are measured whole, other columns are ignored, and no rows give no rows.
    """
    return materialise(measure(docs, "doc_id", *carried).withColumn("failed", failures(rules)))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger stays under ``policy``."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(kept_ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES, part: str | None = None) -> DataFrame:
    """What each policy loses by each of its rules; one row for each part, policy and rule, zeros included.

    n_docs, kept (under the policy), n_failed (by the rule), n_only (by no other rule of the policy: what is gained if the
    rule goes), kept_without and kept_alone (if it is the only rule), any_failed and all_failed (bits of the policy's
    rules that any and that every document fails). Documents are first counted by their bits: at most two to the number
    of rules for each part.
    """
    label = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    patterns = kept_ledger.groupBy(label.alias("part"), "failed").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for p in policies for i, r in enumerate(rules) if r.name in p.rules]
    each = patterns.select("part", "failed", "n", F.inline(F.array(*rows))).withColumn("hit", F.col("failed").bitwiseAND(F.col("mask")))
    fails = F.col("hit").bitwiseAND(F.col("bit")) != 0

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return (
        each.groupBy("part", "policy", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            counted(F.col("hit") == 0).alias("kept"),
            counted(fails).alias("n_failed"),
            counted(F.col("hit") == F.col("bit")).alias("n_only"),
            F.bit_or("hit").alias("any_failed"),
            F.bit_and("hit").alias("all_failed"),
        )
        .withColumns({"kept_without": F.col("kept") + F.col("n_only"), "kept_alone": F.col("n_docs") - F.col("n_failed")})
    )


def judge(kept_ledger: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``, the verdict of the base rules and ``policy`` together."""
    base = Policy("base", tuple(r.name for r in rules if r.base))
    return kept_ledger.withColumns({"base_failed": ~passes(base, rules), "kept": passes(base, rules) & passes(policy, rules), "policy": F.lit(policy.version)})


def _ledger_sql() -> str:
    """The ledger in DuckDB as a list of common tables that ends in ``ledger``; measured by windows and joins of words."""
    ws, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    failed = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return f"""
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents
), words AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS v FROM texts
), per_word AS (
  SELECT r, count(*) AS n_words, sum(length(v)) AS word_chars, count(*) FILTER (regexp_matches(v, '\\p{{L}}')) AS n_letter_words FROM words GROUP BY r
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n
  FROM (SELECT r, i, v || ' ' || lead(v, 1) OVER own || ' ' || lead(v, 2) OVER own AS win FROM words WINDOW own AS (PARTITION BY r ORDER BY i))
  WHERE win IS NOT NULL
), per_window AS (
  SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM windows, generate_series(0, 2) AS s(d) WHERE n > 1 GROUP BY r
), lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{word}')
), per_line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^{ws}*([•‣▶●]|[-*]\\x20.*{word})')) AS n_list_lines,
         count(*) FILTER (regexp_matches(line, '(\\.\\.\\.|…){ws}*$')) AS n_dotted_lines
  FROM lines GROUP BY r
), measured AS (
  SELECT doc_id, lang, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_letter_words, 0) AS n_letter_words,
         coalesce(n_list_lines, 0) AS n_list_lines, coalesce(n_dotted_lines, 0) AS n_dotted_lines
  FROM texts LEFT JOIN per_word USING (r) LEFT JOIN per_window USING (r) LEFT JOIN per_line USING (r)
), ledger AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM measured)"""


def oracle_sql() -> str:
    """The rows of the query in DuckDB; the base rules are written out."""
    full = POLICIES[-1]
    return f"""
WITH {_ledger_sql()}, based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM ledger
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed & {full.mask()} = 0 AS kept, failed, '{full.version}' AS policy
FROM based
"""


def ablations_sql() -> str:
    """The rows of ``ablations`` by language in DuckDB, counted rule by rule on the documents."""
    rows = ", ".join(f"('{p.version}', {p.mask()}, '{r.name}', {1 << i})" for p in POLICIES for i, r in enumerate(RULES) if r.name in p.rules)
    return f"""
WITH {_ledger_sql()}, uses(policy, mask, rule, bit) AS (VALUES {rows}), each AS (
  SELECT coalesce(lang, '') AS part, policy, rule, bit, failed & mask AS hit FROM ledger, uses
)
SELECT part, policy, rule, count(*) AS n_docs, count(*) FILTER (hit = 0) AS kept, count(*) FILTER (hit & bit <> 0) AS n_failed,
       count(*) FILTER (hit = bit) AS n_only, CAST(bit_or(hit) AS BIGINT) AS any_failed, CAST(bit_and(hit) AS BIGINT) AS all_failed,
       count(*) FILTER (hit = 0 OR hit = bit) AS kept_without, count(*) FILTER (hit & bit = 0) AS kept_alone
FROM each GROUP BY part, policy, rule
"""

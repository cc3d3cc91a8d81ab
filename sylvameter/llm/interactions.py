"""How filters overlap: an audit of their order by inclusion and exclusion.

Every filter gives a document one flag. For each of the 32 sets of filters one aggregate counts, by part of the corpus,
the documents that fail all of the set: the sum of the product of their flags, also for the documents of good quality
and the toxic ones. From these joint counts everything else follows without another look at documents:

* survivors of a set of filters: the alternating sum of the joint counts of its subsets (Moebius inversion), and so what
  stays and what goes at each step of each order;
* failures of one filter alone: the alternating sum over the sets that hold it;
* the Shapley value: a set's Harsanyi dividend in "documents removed" is its joint count with the sign of its size, and
  each filter gets an equal share of the dividends of its sets. Summed over all orders instead of averaged, it is whole.

Identical texts meet as digests, so no text is exchanged. A group of copies that holds a third of all rows is reduced on
the map side to its least id, and rows meet that id in a join whose hot partition adaptive execution can split.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange
from sylvameter.session import materialise

#: The filters of ``failing``, in bit order.
LETTERS = "ABCDE"
#: Fixed value: what separates words.
SPACE = " \t\n\x0b\f\r"


def failing(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, and a flag for each filter that says whether the document fails it; one row for each row of ``docs``.

    A: fewer than 200 words. B: less than half of the words are distinct. C: more than 3 % of the code points are A-Z.
    D: one of #$%&*| occurs. E: a smaller doc_id has the same text, wherever in the table.

    A null text counts as empty and fails A, and E if a smaller id has an empty text; a null part is the part "". Rows
    without an id never fail E, nor make others fail; rows that share an id are no copies of each other. Texts of any
    length are read whole, other columns are ignored, and no rows give no rows.
    """
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    bare = F.btrim("text", F.lit(SPACE))
    words = given.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1)))
    n = F.size("words")
    measured = words.select(
        "doc_id",
        "part",
        F.sha2("text", 256).alias("digest"),
        (n < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 3 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    rows = materialise(measured)  # texts are read once; what follows works on digests
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    met = rows.join(own_exchange(copied, "digest"), "digest", "left")
    return met.select("doc_id", "part", *LETTERS[:4], F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with ``good`` (quality is 1) and ``toxic`` (toxic is 1); of several labels of an id, one that is 1 is enough."""
    by_id = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("doc_id is not null and (good or toxic)")
        .groupBy("doc_id")
        .agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    )
    joined = flags.join(own_exchange(by_id, "doc_id"), "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def joint_failures(flags: DataFrame, letters: str = LETTERS, weights: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, and arrays of joint counts: ``n`` of documents and one for each flag of ``weights``.

    Element m counts the documents that fail every filter whose bit is set in m; element 0 counts all.
    """
    whole = {c: F.col(c).cast("long") for c in (*letters, *weights)}

    def counts(weight: Column) -> Column:
        products = [weight]  # of set m: that of m without its highest filter, times that filter's flag
        for c in letters:
            products += [p * whole[c] for p in products]
        return F.array(*[F.sum(p) for p in products])

    return flags.groupBy("part").agg(
        counts(F.lit(1).cast("long")).alias("n"), *[counts(whole[w]).alias(w) for w in weights]
    )


def _signed(joint: str, terms: list[tuple[int, int]]) -> Column:
    """The sum of coefficient times element of the array ``joint``."""
    return F.expr(" + ".join(f"{k} * {joint}[{m}]" for m, k in terms))


def survivors(joint: str, n_filters: int) -> Column:
    """Array by set of filters of what fails none of them: the alternating sum of the joint counts of its subsets."""
    sets = range(1 << n_filters)
    return F.array(*[_signed(joint, [(m, (-1) ** m.bit_count()) for m in sets if m & s == m]) for s in sets])


def alone(joint: str, n_filters: int) -> Column:
    """Array by filter of what fails it and no other."""
    sets = range(1 << n_filters)
    return F.array(*[_signed(joint, [(m, (-1) ** (m.bit_count() - 1)) for m in sets if m >> i & 1]) for i in range(n_filters)])


def shapley_sums(joint: str, n_filters: int) -> Column:
    """Array by filter of its Shapley value times the number of orders: its share of its sets' Harsanyi dividends."""
    sets, orders = range(1 << n_filters), factorial(n_filters)
    return F.array(
        *[
            _signed(joint, [(m, (-1) ** (m.bit_count() - 1) * (orders // m.bit_count())) for m in sets if m >> i & 1])
            for i in range(n_filters)
        ]
    )


def by_order(joint: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the rows of ``joint_failures``.

    kept: left after the step; removed: gone at it; redundant: failing its filter, gone before; unique_fails: failing
    its filter alone; good_lost and toxic_lost: the good and the toxic among the removed; shapley: what the filter
    removes, summed over all orders.
    """
    size = len(letters)
    orders = F.lit(["".join(p) for p in permutations(letters)])
    steps = (
        joint.select(
            "part",
            F.col("n").alias("joint"),
            survivors("n", size).alias("left"),
            survivors("good", size).alias("good_left"),
            survivors("toxic", size).alias("toxic_left"),
            alone("n", size).alias("alone"),
            shapley_sums("n", size).alias("shares"),
            F.explode(orders).alias("filter_order"),
        )
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
        .withColumn("place", F.instr(F.lit(letters), F.col("filter_order").substr(F.col("step"), F.lit(1))) - 1)
    )
    before = reduce(lambda a, b: a + b, [F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(letters)])
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(size)]), F.col("place") + 1)
    steps = steps.withColumns({"before": before, "bit": bit}).withColumn("after", F.col("before") + F.col("bit"))

    def lost(left: str) -> Column:
        return F.col(left)[F.col("before")] - F.col(left)[F.col("after")]

    return steps.select(
        "part",
        "filter_order",
        "step",
        F.col("left")[F.col("after")].alias("kept"),
        lost("left").alias("removed"),
        (F.col("joint")[F.col("bit")] - lost("left")).alias("redundant"),
        F.col("alone")[F.col("place")].alias("unique_fails"),
        lost("good_left").alias("good_lost"),
        lost("toxic_left").alias("toxic_lost"),
        F.col("shares")[F.col("place")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters of ``failing`` on ``docs`` (doc_id, text, part) with ``labels`` (doc_id, quality, toxic)."""
    return by_order(joint_failures(with_labels(failing(docs, part), labels)))


def oracle_sql() -> str:
    """The rows of the query in DuckDB: every order applied step by step to the documents, counted by pattern of failures."""
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(LETTERS))
    names = [f"l{i}" for i in range(1, 6)]
    distinct = " AND ".join(f"{a}.c <> {b}.c" for i, a in enumerate(names) for b in names[:i])
    bits = ", ".join(f"{x}.bit" for x in names)
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failures AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM texts JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), patterns AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failures GROUP BY part, mask
), letters(c, bit) AS (VALUES {letters}
), orders AS (
  SELECT {" || ".join(f"{x}.c" for x in names)} AS filter_order, [{bits}] AS bits
  FROM {", ".join(f"letters {x}" for x in names)} WHERE {distinct}
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before
  FROM orders, generate_series(1, 5) AS s(step)
), counted AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(n) FILTER (mask & (coalesce(before, 0)::INTEGER + bit) = 0) AS BIGINT) AS kept,
         CAST(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INTEGER = 0) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INTEGER <> 0) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
         CAST(sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INTEGER = 0) AS BIGINT) AS good_lost,
         CAST(sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0)::INTEGER = 0) AS BIGINT) AS toxic_lost
  FROM patterns, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

"""Secret scanning with corpus-wide ownership frequency, on SQL functions alone.

Candidates are found by pattern. The SHA-256 of each candidate's value is then counted over the whole corpus by
distinct repositories and distinct owners. A value that many owners hold is a copied example; a value that one or two
owners hold looks live. Pattern kinds of the base are always reported, with that class beside them; candidates of
the ``opaque`` kind, long mixed tokens that stand alone, become spans only where the ownership count makes them live.

Positions are code points. They come from the lengths of what stands between matches, so no row-wise code is needed.
Every step after the scan works on candidate rows, without text. The frequency count adds up per (value, repository)
before it adds up per value, so that a value held by a third of all rows is reduced on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange
from sylvameter.session import materialise


@dataclass(frozen=True)
class Kind:
    """A candidate pattern in Java syntax. ``value`` is the group with the secret, ``least`` its least code points.

    ``mask`` is what replaces a match in redacted text; where it is empty, matches are not redacted.
    """

    name: str
    pattern: str
    value: int
    least: int
    base: bool
    mask: str = ""


#: The base kinds, in the order that breaks ties between spans that start together.
BASE_KINDS = (
    Kind(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
        "$1=[secret]",
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True, "[secret]"),
    # shorter runs fail anyway, and a run has one match whatever its least length
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True, "[secret]"),
)
#: Kinds that the ownership count decides on.
METHOD_KINDS = (
    Kind("opaque", r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}(?![A-Za-z0-9])", 0, 16, False),
)


def _found(text: Column, kind: Kind, order: int) -> Column:
    """Array of (order, k, gap, whole, value): all leftmost non-overlapping matches with the gap before each."""
    pattern = F.lit(kind.pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, kind.pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(kind.value)).alias("value"),
    )
    rows = F.transform(
        F.filter(zipped, lambda m: m["whole"].isNotNull()),
        lambda m, k: F.struct(
            F.lit(order).alias("kind"),
            k.alias("k"),
            m["gap"].cast("long").alias("gap"),
            F.length(m["whole"]).cast("long").alias("whole"),
            F.length(m["value"]).alias("n"),
            F.sha2(m["value"], 256).alias("hash"),
        ),
    )
    nothing = F.array().cast("array<struct<kind:int,k:int,gap:bigint,whole:bigint,n:int,hash:string>>")
    return F.when(text.rlike(kind.pattern), rows).otherwise(nothing)


def candidates(docs: DataFrame, repository: str, owner: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """One row for each candidate, and one without a kind for each document that has none.

    Columns: row (one value for each input row), doc_id, repository, owner, kind (index into ``kinds``), start, stop,
    hash. A null text counts as empty, a null repository or owner as an owner of its own name "".
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat(*[_found(text, kind, i) for i, kind in enumerate(kinds)]).alias("found"),
    ).select("row", "doc_id", "repository", "owner", F.explode_outer("found").alias("c"))
    before = Window.partitionBy("row", "c.kind").orderBy("c.k")
    stop = F.sum(F.col("c.gap") + F.col("c.whole")).over(before)
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("c.kind") + 1)
    placed = scanned.withColumn("stop", stop)
    passing = F.col("c.kind").isNotNull() & (F.col("c.n") >= least)
    return placed.select(
        "row", "doc_id", "repository", "owner",
        F.when(passing, F.col("c.kind")).alias("kind"),
        F.when(passing, F.col("stop") - F.col("c.whole")).alias("start"),
        F.when(passing, F.col("stop")).alias("stop"),
        F.when(passing, F.col("c.hash")).alias("hash"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners, n_uses: how widely each candidate value is held, exactly."""
    held = found.where("kind is not null").groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    repositories = held.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_uses"))
    return owners.join(repositories, "hash")


def scan_secrets(
    docs: DataFrame,
    repository: str = "doc_id",
    owner: str = "source",
    most_owners: int = 2,
    kinds: tuple[Kind, ...] = BASE_KINDS + METHOD_KINDS,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, and the repository and owner columns).

    Without other columns a document stands for a repository and its source for the owner.
    Returns doc_id; findings, an array of (kind, start, stop, live, n_repositories, n_owners, n_uses) by start and then
    kind order. ``live`` says that at most ``most_owners`` owners hold the value. Candidates of kinds that are not of
    the base are left out unless they are live. Documents without findings, with null or empty text, have an empty
    array; repeated rows are each reported; extra columns are ignored; an empty table gives no rows.
    """
    found = materialise(candidates(docs, repository, owner, kinds))
    wide = ownership(found)
    base = F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("kind") + 1)
    name = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.col("kind") + 1)
    judged = (
        found.where("kind is not null")
        .join(own_exchange(wide, "hash"), "hash")  # a hot value splits on the side of the candidates
        .withColumn("live", F.col("n_owners") <= most_owners)
        .where(base | F.col("live"))
        .select(
            "row",
            F.struct(
                "start", F.col("kind").alias("order"), name.alias("kind"), "stop", base.alias("base"), "live",
                "n_repositories", "n_owners", "n_uses",
            ).alias("finding"),
        )
    )
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    # one small row for each document: the window above left its candidates side by side
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    joined = rows.join(by_row, "row", "left")
    kind = by_row.schema["findings"].dataType
    return joined.select("doc_id", F.coalesce("findings", F.array().cast(kind)).alias("findings"))


def spans_text(findings: Column) -> Column:
    """The findings as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = BASE_KINDS) -> DataFrame:
    """``docs`` with all but the key words of matches in ``text`` replaced; other columns stay, null texts too.

    Matches whose value is too short stay as they are.
    """
    text = F.col("text")
    for kind in kinds:
        if kind.mask:
            value = kind.pattern.removesuffix(")").removesuffix("+") if kind.value else kind.pattern.removesuffix("+")
            least = kind.least - (len("AKIA") if kind.name == "access" else 0)
            long = kind.pattern if value == kind.pattern else f"{value}{{{least},}}" + (")" if kind.value else "")
            text = F.regexp_replace(text, long, kind.mask)
    return docs.withColumn("text", text)


def oracle_sql(most_owners: int = 2) -> str:
    """The columns of the query in DuckDB, for documents (doc_id, text, source); patterns in RE2 syntax, written out."""
    kinds = (
        (0, "assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        (1, "access", r"AKIA[A-Z0-9]+", 0, 20),
        (2, "hex", r"[0-9a-f]+", 0, 24),
        (3, "opaque", r"[A-Za-z0-9]+", 0, 16),
    )
    found = " UNION ALL ".join(
        f"""SELECT r, source, {i} AS kind, '{name}' AS name, {least} AS least, string_split_regex(t, '{p}') AS gaps,
        regexp_extract_all(t, '{p}', 0) AS wholes, regexp_extract_all(t, '{p}', {group}) AS vals FROM texts"""
        for i, name, p, group, least in kinds
    )
    return f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), found AS ({found}), matches AS (
  SELECT r, source, kind, name, least, generate_subscripts(wholes, 1) AS k, unnest(wholes) AS whole, unnest(vals) AS val,
         unnest(gaps[1:len(wholes)]) AS gap
  FROM found
), placed AS (
  SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS stop FROM matches
), passing AS (
  SELECT r, source, kind, name, stop - length(whole) AS start, stop, sha256(val) AS hash FROM placed
  WHERE length(val) >= least AND (kind < 3 OR regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]'))
), owned AS (
  SELECT hash, count(DISTINCT source) <= {most_owners} AS live FROM passing GROUP BY hash
), judged AS (
  SELECT r, kind, start, name || ':' || start || ':' || stop AS span, live FROM passing JOIN owned USING (hash) WHERE kind < 3 OR live
), per_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM texts LEFT JOIN per_row USING (r)
"""

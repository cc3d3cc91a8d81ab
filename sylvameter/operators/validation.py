"""Schema as data: rules on columns, the first broken one by rule order, and names that are safe to use."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What one column must be. A null counts as absent."""

    name: str
    mandatory: bool = False
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()
    date: bool = False


#: The fields of structured metadata.
METADATA: tuple[Rule, ...] = (
    Rule("esg_project_id", True, r"^[A-Z]{3,6}-[0-9]{3,5}$"),
    Rule("sustainability_domain", True, allowed=("reforestation", "mangrove_restoration", "clean_water", "solar_microgrid")),
    Rule("cadastral_polygon_id", True, r"^[A-Za-z0-9_-]{2,64}$"),
    Rule("capture_timestamp", True, date=True),
    Rule("solar_azimuth_error", low=-180, high=180),
    Rule("jev_triage_decision", allowed=("VERIFIED_PASS", "REVIEW_AMBIGUOUS", "QUARANTINE_FRAUD")),
    Rule("jev_confidence_score", low=0, high=100),
    Rule("c2pa_provenance", allowed=("C2PA_VERIFIED", "C2PA_MISSING", "C2PA_MUTATED")),
    Rule("sift_inlier_ratio", low=0, high=100),
    Rule("milestone_phase", True, allowed=("baseline_month_0", "progress_month_6", "progress_month_18", "certified_year_3")),
    Rule("canopy_delta_pct", low=-100, high=500),
)


def problem(rule: Rule, value: Column) -> Column:
    """The name of the rule's first broken part, or null."""
    broken = F.when(value.isNull(), F.lit(f"{rule.name}:missing") if rule.mandatory else F.lit(None))
    if rule.allowed:
        broken = broken.when(~value.isin(list(rule.allowed)), f"{rule.name}:not_allowed")
    if rule.pattern:
        broken = broken.when(~value.rlike(rule.pattern), f"{rule.name}:pattern")
    if rule.low is not None:
        broken = broken.when(value < rule.low, f"{rule.name}:too_low")
    if rule.high is not None:
        broken = broken.when(value > rule.high, f"{rule.name}:too_high")
    if rule.date:
        day = F.substring(value.cast("string"), 1, 10)
        broken = broken.when(~day.rlike(r"^\d{4}-\d{2}-\d{2}$"), f"{rule.name}:date")
    return broken


def validate(df: DataFrame, rules: Sequence[Rule] = METADATA) -> DataFrame:
    """``df`` with problems (all, in rule order) and first_problem; a column that is not there is null in every row."""
    found = [problem(r, F.col(r.name) if r.name in df.columns else F.lit(None).cast("string")) for r in rules]
    return df.withColumn("problems", F.array_compact(F.array(*found))).withColumn("first_problem", F.get("problems", F.lit(0)))


def unknown_fields(payload: Column, rules: Sequence[Rule] = METADATA) -> Column:
    """Keys of a map that no rule names, in order."""
    known = F.array(*[F.lit(r.name) for r in rules])
    return F.array_sort(F.array_except(F.map_keys(payload), known))


def safe_public_id(value: Column) -> Column:
    """Whether a public id has no leading slash, and 1 to 255 letters, digits, slashes, hyphens and underscores."""
    return value.rlike(r"\A[A-Za-z0-9_][A-Za-z0-9_/-]{0,254}\z")


def safe_overlay_text(value: Column) -> Column:
    """Whether a text can stand on an image: at most 240 characters, no control characters, backslash or slash."""
    return (F.length(value) <= 240) & ~value.rlike(r"[\x00-\x1F\x7F\\/]")


def safe_component(value: Column) -> Column:
    """Whether a structural value of a delivery address (gravity, colour, font, style) keeps to its plain alphabet."""
    return value.rlike(r"\A[A-Za-z0-9_:,.-]+\z")


def bootstrap(wanted: DataFrame, existing: DataFrame, key: str = "name", digest: str = "digest") -> DataFrame:
    """(name, action): created, updated or unchanged for each wanted field, extra for fields that only exist."""
    joined = wanted.select(key, F.col(digest).alias("w")).join(existing.select(key, F.col(digest).alias("e")), key, "full_outer")
    action = F.when(F.col("e").isNull(), "created").when(F.col("w").isNull(), "extra").when(F.col("w") == F.col("e"), "unchanged").otherwise("updated")
    return joined.select(key, action.alias("action"))


def schema_digest(rules: Sequence[Rule] = METADATA) -> str:
    """The first 16 hex digits of the SHA-256 of the rules as key-sorted JSON."""
    import hashlib
    import json
    from dataclasses import asdict

    return hashlib.sha256(json.dumps([asdict(r) for r in rules], sort_keys=True).encode()).hexdigest()[:16]

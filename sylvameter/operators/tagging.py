"""Rule-based tags with evidence, and their fusion with tags from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (tag, condition, confidence) over measured columns, in SQL.
PIXEL_RULES: tuple[tuple[str, str, str], ...] = (
    ("canopy", "detectable AND cover >= 0.18", "least(0.5 + cover, 0.99)"),
    ("forest", "green > 0.18 AND cover > 0.10", "least(0.5 + green / 2, 0.97)"),
    ("grassland", "yellow > 0.25 AND cover < 0.35", "least(0.5 + yellow / 2, 0.95)"),
    ("bare_soil", "brown > 0.30 AND cover < 0.20", "least(0.5 + brown / 2, 0.95)"),
    ("shrub", "magenta > 0.12", "least(0.45 + magenta / 2, 0.9)"),
    ("water", "water > 0.05", "least(0.55 + 2 * water, 0.98)"),
    ("wetland", "water > 0.01 AND cover > 0.05", "least(0.5 + 3 * water, 0.95)"),
    ("sky", "sky > 0.15", "least(0.5 + sky, 0.98)"),
    ("tidal", "sky > 0.05 AND water > 0.05", "least(0.55 + water, 0.95)"),
    ("flooded", "sky < 0.02 AND water < 0.01 AND cover > 0.5", "0.55"),
    ("urban", "edges > 0.16 AND cover < 0.20 AND water < 0.02", "least(0.5 + edges, 0.92)"),
    ("infrastructure", "edges > 0.16 AND cover < 0.20 AND water < 0.02", "least(0.45 + edges, 0.9)"),
    ("low_light", "luma_mean < 55", "least(0.6 + (55 - luma_mean) / 100, 0.95)"),
    ("overcast", "luma_std < 28", "least(0.55 + (28 - luma_std) / 60, 0.95)"),
    ("harsh_sun", "luma_std > 62", "least(0.5 + (luma_std - 62) / 100, 0.95)"),
)
#: What a tag of the first set, with and without others, lets infer.
INFERRED: tuple[tuple[str, tuple[str, ...], tuple[str, ...], float], ...] = (
    ("mangrove", ("canopy", "water", "sky"), (), 0.72),
    ("urban", ("canopy", "urban"), (), 0.6),
    ("infrastructure", ("water", "infrastructure"), (), 0.6),
    ("dryland", ("canopy", "sky"), ("water",), 0.55),
)
#: The closed vocabulary that outside tags map to.
VOCABULARY: dict[str, str] = {
    "forest": "forest", "tree": "forest", "trees": "forest", "plant": "canopy", "plants": "canopy", "vegetation": "canopy", "grass": "grassland",
    "mangrove": "mangrove", "wetland": "wetland", "swamp": "wetland", "water": "water", "river": "water", "sea": "water", "lake": "water",
    "beach": "bare_soil", "sand": "bare_soil", "desert": "bare_soil", "sky": "sky", "cloud": "overcast", "sunset": "sky", "city": "urban",
    "building": "urban", "bridge": "infrastructure", "road": "infrastructure", "construction": "infrastructure",
    "planting": "restoration_site", "nursery": "restoration_site",
}
_HIT = "array<struct<tag:string,confidence:double,evidence:string,basis:string>>"


def hit(tag: str, confidence: Column | float, evidence: str, basis: Column | str) -> Column:
    value = confidence if isinstance(confidence, Column) else F.lit(confidence)
    held = F.round(F.greatest(F.least(value.cast("double"), F.lit(1.0)), F.lit(0.0)), 3)
    text = basis if isinstance(basis, Column) else F.lit(basis)
    return F.struct(F.lit(tag).alias("tag"), held.alias("confidence"), F.lit(evidence).alias("evidence"), text.alias("basis"))


def _known(hits: list[Column]) -> Column:
    return F.array_compact(F.array(*hits)).cast(_HIT)


def pixel_tags() -> Column:
    """Tags of measured columns; each states the measures that its rule looked at, as name=value."""
    names = ("cover", "green", "yellow", "brown", "magenta", "water", "sky", "edges", "luma_mean", "luma_std")
    out = []
    for tag, condition, confidence in PIXEL_RULES:
        used = [n for n in names if n in condition]
        basis = F.concat_ws(", ", *[F.format_string(f"{n}=%.3f", F.col(n).cast("double")) for n in used])
        out.append(F.when(F.expr(condition), hit(tag, F.expr(confidence), "PIXEL", basis)))
    return _known(out)


def geometry_tags(width: Column, height: Column) -> Column:
    aspect = width / height
    basis = F.format_string("aspect=%.3f", aspect.cast("double"))
    return _known([
        F.when(aspect >= 1.4, hit("drone_aerial", 0.6, "GEOMETRY", basis)).otherwise(hit("ground_level", 0.55, "GEOMETRY", basis)),
        F.when(F.least(width, height) < 400, hit("close_up", 0.6, "GEOMETRY", F.format_string("side=%d", F.least(width, height)))),
    ])


def context_tags(phase: Column, domain: Column, media_type: Column, hour: Column) -> Column:
    basis = F.concat(F.lit("phase="), phase)
    return _known([
        F.when(phase.startswith("baseline"), hit("baseline", 0.95, "CONTEXT", basis)),
        F.when(phase.startswith("progress") | phase.startswith("certified"), hit("progress", 0.95, "CONTEXT", basis)),
        F.when(domain.contains("mangrove"), hit("mangrove", 0.7, "CONTEXT", F.concat(F.lit("domain="), domain))),
        F.when(domain.contains("mangrove") | domain.contains("reforestation"), hit("restoration_site", 0.8, "CONTEXT", F.concat(F.lit("domain="), domain))),
        F.when(media_type == "video", hit("video", 0.99, "CONTEXT", "media=video")).otherwise(hit("still", 0.99, "CONTEXT", "media=image")),
        F.when(hour.between(9, 17), hit("harsh_sun", 0.5, "CONTEXT", F.concat(F.lit("hour="), hour.cast("string")))),
    ])


def inferred_tags(hits: Column) -> Column:
    names = F.transform(hits, lambda h: h["tag"])
    out = []
    for tag, having, lacking, confidence in INFERRED:
        condition = F.lit(True)
        for n in having:
            condition = condition & F.array_contains(names, n)
        for n in lacking:
            condition = condition & ~F.array_contains(names, n)
        out.append(F.when(condition, hit(tag, confidence, "INFERRED", "from=" + "+".join(having))))
    return _known(out)


def external_tags(external: Column) -> Column:
    """(raw, tag, confidence) of a map of outside tags, unknown ones left out."""
    names = F.create_map(*[F.lit(x) for pair in VOCABULARY.items() for x in pair])
    rows = F.transform(
        F.map_entries(external), lambda e: F.struct(e["key"].alias("raw"), F.element_at(names, F.lower(F.trim(e["key"]))).alias("tag"), e["value"].cast("double").alias("confidence"))
    )
    return F.filter(rows, lambda e: e["tag"].isNotNull())


def fuse(hits: Column, external: Column) -> Column:
    """(merged, conflicts): outside tags are added where nothing local has them, at most 0.9 sure; a local tag stays
    where it meets one, and it is a conflict where the outside one has less than half of its confidence."""
    outside = F.coalesce(external_tags(external), F.array().cast("array<struct<raw:string,tag:string,confidence:double>>"))
    local = lambda e: F.filter(hits, lambda h: h["tag"] == e["tag"])
    new = F.transform(
        F.filter(outside, lambda e: F.size(local(e)) == 0),
        lambda e: F.struct(
            e["tag"].alias("tag"), F.round(F.least(e["confidence"], F.lit(0.9)), 3).alias("confidence"), F.lit("EXTERNAL").alias("evidence"),
            F.concat(e["raw"], F.lit("="), F.round(e["confidence"], 2).cast("string")).alias("basis"),
        ),
    )
    weak = F.filter(outside, lambda e: F.exists(local(e), lambda h: e["confidence"] < h["confidence"] * 0.5))
    conflicts = F.transform(
        weak, lambda e: F.struct(e["tag"].alias("tag"), F.get(local(e), F.lit(0))["confidence"].alias("local_confidence"), F.round(e["confidence"], 3).alias("external_confidence"))
    )
    return F.struct(F.concat(hits, new.cast(_HIT)).alias("merged"), conflicts.alias("conflicts"))


def grounded(hits: Column) -> Column:
    """Hits with a basis, which for pixel evidence must state a measure."""
    return F.filter(hits, lambda h: (F.length(F.trim(F.coalesce(h["basis"], F.lit("")))) > 0) & ((h["evidence"] != "PIXEL") | h["basis"].contains("=")))


def by_confidence(hits: Column) -> Column:
    """Hits by falling confidence, those of equal confidence in their order."""
    keyed = F.transform(hits, lambda h, i: F.struct((-h["confidence"]).alias("c"), i.alias("i"), h.alias("h")))
    return F.transform(F.array_sort(keyed), lambda k: k["h"])


def long_form(df: DataFrame, column: str, *keys: str, name: str = "h") -> DataFrame:
    """The keys and one struct ``name`` for each entry of an array column.

    The outer explode keeps Spark from putting the whole of the array's expression into a filter below it.
    """
    return df.select(*keys, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def enrich(df: DataFrame, external: str | None = None) -> DataFrame:
    """``df`` of measured assets with tags (surest first, repeats kept) and conflicts; one pass, no shuffle."""
    parts = [pixel_tags()]
    if {"width", "height"} <= set(df.columns):
        parts.append(geometry_tags(F.col("width"), F.col("height")))
    if {"milestone_phase", "sustainability_domain", "media_type", "hour"} <= set(df.columns):
        parts.append(context_tags(*[F.col(c) for c in ("milestone_phase", "sustainability_domain", "media_type", "hour")]))
    out = df.withColumn("__hits", F.concat(*parts))
    out = out.withColumn("__hits", F.concat("__hits", inferred_tags(F.col("__hits"))))
    other = F.col(external) if external else F.create_map().cast("map<string,double>")
    out = out.withColumn("__fused", fuse(F.col("__hits"), other))
    return out.select(*df.columns, by_confidence(F.col("__fused.merged")).alias("tags"), F.col("__fused.conflicts").alias("conflicts"))

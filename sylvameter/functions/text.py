"""Text functions on columns: terms, numbers, caption times, names and links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a term counts as.
SYNONYMS: dict[str, str] = {
    "rhizophora": "mangrove", "mangle": "mangrove", "avicennia": "mangrove", "acacia": "tree", "trees": "tree", "forest": "tree", "woodland": "tree",
    "sapling": "tree", "saplings": "tree", "seedling": "tree", "vegetation": "canopy", "foliage": "canopy", "greenery": "canopy",
    "erosion": "degradation", "deforestation": "degradation", "drought": "dryland", "arid": "dryland", "creek": "water", "river": "water",
    "estuary": "water", "sea": "water", "ocean": "water", "tidalflat": "tidal", "drone": "aerial", "satellite": "aerial", "photo": "image",
    "photograph": "image", "picture": "image", "video": "image", "footage": "image", "replanting": "restoration", "reforestation": "restoration",
    "rewilding": "restoration", "planting": "restoration",
}
#: Words that are no terms.
STOP_WORDS: tuple[str, ...] = tuple(
    "a an the of in on at to for with and or is are was were be been by from as that this it its me my we our you your show find give "
    "all any some more than then there here have has had do does did not but can will would should could i s t over under about into out "
    "up down very just also please".split()
)


def terms(text: Column, synonyms: Mapping[str, str] = SYNONYMS, stop_words: tuple[str, ...] = STOP_WORDS, least: int = 2, keep_joiners: bool = False) -> Column:
    """Terms of a text in order, repeats kept: runs of a-z and 0-9, lower-cased, without stop words and short ones.

    ``keep_joiners`` lets ``_`` and ``-`` stand inside a term, for identifiers.
    """
    pattern = "[a-z0-9_-]+" if keep_joiners else "[a-z0-9]+"
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    # both lists are hashed sets of literals; the map is looked into for the few terms that it has
    kept = F.filter(raw, lambda t: (F.length(t) >= least) & ~t.isin(*stop_words) if stop_words else F.length(t) >= least)
    if not synonyms:
        return kept
    names = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.transform(kept, lambda t: F.when(t.isin(*synonyms), F.element_at(names, t)).otherwise(t))


#: Labels whose digits are no measurement, in the order in which they are masked.
LABEL_PATTERNS: tuple[str, ...] = (
    r"\b(?:VM|C2PA|CSRD|EUDR|ESRS|ISO|IEC|ISSA|IPCC|GRI)(?:\s*/\s*(?:IEC|ISO|ISSA))?[-\s/]?[A-Z]?\d+[A-Za-z0-9.]*\b",
    r"\b[tT]?CO2e?",
    r"\b(?:Article|Section|Clause|Annex|Paragraph|Chapter|Schedule)\s+\d+(?:\.\d+)?",
    r"\bE[1-9]\b",
    r"\bC2PA\b",
    r"\b(?:cm2|m2|ha|kg|ms|fps|ppm)\b",
)
#: Fixed value: a figure, with its sign, thousands separators, decimals and per cent.
FIGURE_PATTERN = r"[+-]?\d[\d,]*(?:\.\d+)?\s*%?"


def figures(text: Column) -> Column:
    """The figures of a text in order, as they are written, labels masked."""
    masked = F.coalesce(text, F.lit(""))
    for pattern in LABEL_PATTERNS:
        masked = F.regexp_replace(masked, pattern, "~")
    return F.transform(F.regexp_extract_all(masked, F.lit(FIGURE_PATTERN), F.lit(0)), lambda x: F.trim(x))


def figure_value(figure: Column) -> Column:
    """The number of a written figure."""
    return F.regexp_replace(figure, r"[,%\s]", "").try_cast("double")


def caption_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm of a time in seconds, to the nearest millisecond; null, NaN and negative times are 0."""
    ms = F.floor(F.when(F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), 0.0).otherwise(F.coalesce(seconds, F.lit(0.0))) * 1000 + 0.5).cast("long")
    parts = [F.lpad((ms / unit).cast("long").cast("string") if span is None else F.pmod(F.floor(ms / unit), F.lit(span)).cast("string"), width, "0") for unit, span, width in ((60_000, 60, 2), (1000, 60, 2), (1, 1000, 3))]
    hours = F.floor(ms / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(hours, F.lit(":"), parts[0], F.lit(":"), parts[1], F.lit("."), parts[2])


def parse_caption_time(text: Column) -> Column:
    """Seconds of HH:MM:SS.mmm; null for all else."""
    part = [F.regexp_extract(text, r"^(\d{2,}):([0-5]\d):([0-5]\d)\.(\d{3})$", i).try_cast("double") for i in range(1, 5)]
    return part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000


def cue_text(tag: Column) -> Column:
    """A caption line: white space runs are one space. The arrow of cue times is no caption and gives null."""
    return F.when(tag.contains("-->"), F.lit(None)).otherwise(F.trim(F.regexp_replace(tag, r"\s+", " ")))


def slug(text: Column) -> Column:
    """Lower case, each character that is no letter or digit a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "-"), r"^-+|-+$", "")


def title(text: Column) -> Column:
    """A tag as a title: underscores are spaces, words are capitalised."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def layer_reference(public_id: Column) -> Column:
    """A public id inside a layer: slashes are colons."""
    return F.replace(public_id, F.lit("/"), F.lit(":"))


def percent_encode(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters, a space being %20."""
    encoded = F.url_encode(text)
    for plain, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(plain), F.lit(code))
    return encoded


def parent_folder(public_id: Column) -> Column:
    return F.regexp_extract(public_id, r"^(.*)/[^/]*$", 1)


def signed_percent(value: Column, text: str = "%+.1f%%") -> Column:
    return F.format_string(text, value)


def short_digest(text: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, length)

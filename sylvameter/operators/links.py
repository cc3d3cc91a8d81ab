"""Delivery links and report rows, composed as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.functions.text import layer_reference, parent_folder, percent_encode, short_digest, signed_percent
from sylvameter.operators.validation import safe_overlay_text, safe_public_id

FONT = "Arial"


def text_layer(text: Column, font: str, style: str, gravity: str, x: int, y: int) -> Column:
    """A text overlay; its text is percent-encoded, commas and slashes twice, as a path of layers needs it."""
    encoded = F.replace(F.replace(percent_encode(text), F.lit("%2C"), F.lit("%252C")), F.lit("%2F"), F.lit("%252F"))
    return F.concat(F.lit(f"l_text:{FONT}_{font}:"), encoded, F.lit(f",{style},g_{gravity},x_{x},y_{y}"))


def _link(base: str, kind: str, parts: list[Column | str], public_id: Column, suffix: str, sound: Column) -> Column:
    path = F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(sound, F.concat(F.lit(f"{base.rstrip('/')}/{kind}/upload/"), path, F.lit("/"), public_id, F.lit(suffix)))


def split_difference(base: str, before: Column, after: Column, change: Column, verified: Column, width: int = 1200, height: int = 800) -> Column:
    """Two captures side by side with the change burned in; null where an id is unsafe."""
    half = width // 2
    note = F.concat(signed_percent(change, "%+.1f%% CANOPY"), F.when(verified, " | PROVENANCE VERIFIED").otherwise(""))
    parts = [
        f"c_fill,w_{width},h_{height}", f"c_crop,w_{half},h_{height},g_west",
        F.concat(F.lit("l_"), layer_reference(after), F.lit(f"/c_fill,w_{width},h_{height}/c_crop,w_{half},h_{height},g_east")),
        text_layer(F.lit("BEFORE"), "22_bold", "co_white,b_rgb:00000080", "north_west", 30, 30),
        text_layer(F.lit("AFTER"), "22_bold", "co_white,b_rgb:05966990", "north_east", 30, 30),
        text_layer(note, "26_black", "co_white,b_rgb:064e3b95", "south", 30, 30), "f_auto,q_auto:good",
    ]
    return _link(base, "image", parts, before, ".jpg", safe_public_id(before) & safe_public_id(after))


def reel(base: str, video: Column, headline: Column, subline: Column, gravity: str = "center", preview_seconds: int = 0) -> Column:
    parts: list[Column | str] = [f"e_preview:duration_{preview_seconds}:max_seg_3"] if preview_seconds > 0 else []
    parts += [
        f"ar_9:16,c_fill,g_{gravity}", "e_sharpen:60", text_layer(headline, "34_black", "co_white,b_rgb:059669", "north", 0, 80),
        text_layer(subline, "24_bold", "co_white", "south", 0, 60), "f_auto,q_auto",
    ]
    return _link(base, "video", parts, video, ".mp4", safe_public_id(video) & safe_overlay_text(headline) & safe_overlay_text(subline))


def certificate(base: str, template: str, after: Column, project: Column, change: Column, root: Column, width: int = 1200, height: int = 630) -> Column:
    parts = [
        f"w_{width},h_{height},c_fill,b_rgb:030712", text_layer(F.concat(F.lit("Project: "), project), "24_bold", "co_rgb:10b981", "north", 0, 130),
        F.concat(F.lit("l_"), layer_reference(after), F.lit(",w_450,h_300,c_fill,r_12,g_west,x_60,y_40")),
        text_layer(signed_percent(change, "%+.1f%% CANOPY"), "36_black", "co_white,b_rgb:059669", "east", 120, 0),
        text_layer(F.concat(F.lit("Root hash: "), F.substring(root, 1, 16)), "18_mono", "co_rgb:9aa5b1", "south", 0, 40), "f_auto,q_auto",
    ]
    return _link(base, "image", parts, F.lit(template), ".png", safe_public_id(after) & safe_overlay_text(project))


def audit_document(base: str, template: str, after: Column, project: Column, tonnes: Column, error: Column, root: Column) -> Column:
    detail = F.concat(project, F.format_string(": gain %+.2f t by ha, sampling error %.1f%%", tonnes, error))
    parts = [
        text_layer(detail, "20", "co_white", "north", 0, 100), F.concat(F.lit("l_"), layer_reference(after), F.lit(",w_900,c_fit,g_center")),
        text_layer(F.concat(F.lit("Root hash: "), root), "16_mono", "co_white", "south", 0, 40),
    ]
    return _link(base, "image", parts, F.lit(template), ".pdf", safe_public_id(after) & safe_overlay_text(project) & safe_overlay_text(root))


def record_link(app: str, asset: Column) -> Column:
    """The address of a provenance record, the whole id encoded; null for blank ids."""
    return F.when(F.trim(asset) != "", F.concat(F.lit(f"{app.rstrip('/')}/api/v1/assets/"), percent_encode(asset), F.lit("/provenance")))


def campaign(assets: DataFrame, projects: DataFrame, base: str) -> DataFrame:
    """One row for each project with links made of its first and latest capture; projects without captures have nulls."""
    key = lambda f: f(F.struct("capture_timestamp", "public_id", "canopy_delta_pct", "c2pa_provenance"))
    ends = assets.groupBy("esg_project_id").agg(key(F.min).alias("first"), key(F.max).alias("last"))
    joined = projects.join(ends, projects["id"] == ends["esg_project_id"], "left")
    change = F.coalesce("last.canopy_delta_pct", F.lit(0.0))
    return joined.select(
        "id",
        split_difference(base, F.col("first.public_id"), F.col("last.public_id"), change, F.col("last.c2pa_provenance") == "C2PA_VERIFIED").alias("split_url"),
        reel(base, F.col("last.public_id"), F.upper("name"), F.lit("Verified evidence")).alias("reel_url"),
        certificate(base, "templates/certificate", F.col("last.public_id"), F.col("name"), change, short_digest(F.col("last.public_id"), 64)).alias("certificate_url"),
    )


def report(figures: DataFrame, base: str, app: str) -> DataFrame:
    """``figures`` (project_id, public_id, tonnes, error, root) with pdf_url, record_url, address and problem.

    A blank project or a null figure is a problem and leaves the links null.
    """
    blank = F.coalesce(F.trim("project_id"), F.lit("")) == ""
    missing = F.col("tonnes").isNull() | F.col("error").isNull()
    problem = F.when(blank, "blank_project").when(missing, "missing_figure")
    pdf = audit_document(base, "templates/dossier", F.col("public_id"), F.col("project_id"), F.col("tonnes"), F.col("error"), F.col("root"))
    return figures.withColumn("problem", problem).withColumn("pdf_url", F.when(problem.isNull(), pdf)).withColumn(
        "record_url", F.when(problem.isNull(), record_link(app, F.col("project_id")))
    ).withColumn("address", short_digest(F.concat_ws("|", "project_id", "public_id", F.col("tonnes").cast("string"), F.col("error").cast("string"))))


def provenance(assets: DataFrame, log: DataFrame, public_ids: DataFrame) -> DataFrame:
    """For each asked public_id: its asset (found or not), folder, and the number and list of derived files in the log.

    ``transformations`` has what the log says of each of them, its columns beside public_id, in their order; none is an
    empty list.
    """
    said = F.struct(*[c for c in log.columns if c != "public_id"]) if len(log.columns) > 1 else F.struct("public_id")
    listed = F.array_sort(F.collect_list(said)).alias("transformations")
    derived = log.groupBy("public_id").agg(F.count("*").alias("derived"), listed)
    nothing = F.array().cast(derived.schema["transformations"].dataType)
    found = public_ids.join(assets.select("public_id", "esg_project_id", "c2pa_provenance"), "public_id", "left").join(derived, "public_id", "left")
    return found.select(
        "public_id", parent_folder(F.col("public_id")).alias("folder"), "esg_project_id", "c2pa_provenance", F.coalesce("derived", F.lit(0)).alias("derived"),
        F.coalesce("transformations", nothing).alias("transformations"),
        F.when(F.col("esg_project_id").isNull(), "NOT_FOUND").otherwise("OK").alias("status"),
    )

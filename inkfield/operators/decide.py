"""Filters, routing, ranking and settings: one decision per row or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkfield.functions import colour, geometry as g
from inkfield.functions.text import trimmed
from inkfield.operators.ordered import ordered_scan

# Fixed values the results depend on.
DETECT_FLOOR = 0.05
DEFAULT_THRESHOLD = 0.6
THRESHOLD_MIN, THRESHOLD_MAX = 0.05, 0.95
SOURCES, TARGETS, PROVIDERS = ("ja", "zh", "ko"), ("en", "id"), ("local", "cloud")
WEAK_CONFIDENCE = -0.5
PLATE_COVERAGE = 0.73
SHORT_SIDE, LONG_SIDE = 300, 400
RETAINED_KEYS = 3
TARGET_COLUMNS = ["x", "y", "w", "h", "natural_width", "natural_height"]


def above_threshold(detections: DataFrame, threshold: float) -> DataFrame:
    """Filter over a floor-level result: detection runs once, any threshold above the floor is a view of it."""
    return detections.where(F.col("score") >= threshold)


def pages_without_regions(pages: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """Pages that keep no detection at the threshold: their run fails."""
    return pages.join(above_threshold(detections, threshold).select("page_id"), "page_id", "left_anti")


def clears_gate(width: Column, height: Column) -> Column:
    return (F.least(width, height) >= SHORT_SIDE) & (F.greatest(width, height) >= LONG_SIDE)


def has_pixels() -> Column:
    return (F.col("natural_width") > 1) & (F.col("natural_height") > 1)


def candidate_gate(tiles: DataFrame) -> DataFrame:
    return tiles.where(has_pixels() & clears_gate(F.col("w"), F.col("h")))


def clean_patch(patches: DataFrame) -> DataFrame:
    """Every field a settings change carries, made valid; fields it lacks stay null."""
    t = F.col("threshold")
    wild = F.isnan(t) | (F.abs(t) == float("inf"))

    def one_of(name: str, allowed: Sequence[str]) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | c.isin(*allowed), c).otherwise(allowed[0])

    return patches.withColumns({
        "threshold": F.when(t.isNull(), F.lit(None)).when(wild, DEFAULT_THRESHOLD)
        .otherwise(F.least(F.lit(THRESHOLD_MAX), F.greatest(F.lit(THRESHOLD_MIN), t))),
        "provider": one_of("provider", PROVIDERS),
        "api_key": trimmed(F.col("api_key")),
        "source": one_of("source", SOURCES),
        "target": one_of("target", TARGETS),
    })


def with_defaults(settings: DataFrame) -> DataFrame:
    return settings.fillna({
        "threshold": DEFAULT_THRESHOLD, "provider": PROVIDERS[0], "api_key": "",
        "source": SOURCES[0], "target": TARGETS[0],
    })


def clean_settings(settings: DataFrame) -> DataFrame:
    """Stored settings as loaded: valid values, defaults for what is missing."""
    return with_defaults(clean_patch(settings))


SETTING_FIELDS = ["threshold", "provider", "api_key", "source", "target"]


def settings_state(patches: DataFrame, bucket: Column) -> DataFrame:
    """Settings in force after every change of a user: later defined fields override."""
    cleaned = clean_patch(patches).withColumnsRenamed({f: f"_{f}" for f in SETTING_FIELDS})
    held = ordered_scan(
        cleaned, ["user_id"], ["at_us", "event_id"], bucket, last_known={f: f"_{f}" for f in SETTING_FIELDS}
    )
    return with_defaults(held.select("event_id", "user_id", "at_us", *SETTING_FIELDS))


def settings_changes(states: DataFrame, bucket: Column) -> DataFrame:
    """Whether each change rebuilds the translator or reloads the recogniser, against the row before."""
    fields = ["provider", "api_key", "source", "target"]
    paired = ordered_scan(
        states, ["user_id"], ["at_us", "event_id"], bucket,
        lag={f"before_{f}": f for f in fields},
    )
    first = F.col("before_provider").isNull()
    moved = F.lit(False)
    for field in fields:
        moved = moved | ~F.col(field).eqNullSafe(F.col(f"before_{field}"))
    return paired.select(
        "event_id", "user_id",
        (~first & moved).alias("rebuild"),
        (~first & ~F.col("source").eqNullSafe(F.col("before_source"))).alias("reload"),
    )


def clamp_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Rounded edges clamped to the page; boxes under one pixel are dropped."""

    def edge(value: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(limit, g.half_up(value)))

    b = g.box()
    left, top = edge(b.x, width), edge(b.y, height)
    right, bottom = edge(b.right, width), edge(b.bottom, height)
    return (
        boxes.withColumns({"_l": left, "_t": top, "_r": right, "_b": bottom})
        .where((F.col("_r") - F.col("_l") >= 1) & (F.col("_b") - F.col("_t") >= 1))
        .withColumns({
            "x": F.col("_l"), "y": F.col("_t"),
            "w": F.col("_r") - F.col("_l"), "h": F.col("_b") - F.col("_t"),
        })
        .drop("_l", "_t", "_r", "_b")
    )


def to_source_boxes(drawn: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rectangles drawn over placed images, in source pixels; ``clipped`` beyond one pixel outside."""
    fit = F.col("object_fit")
    inner_w = F.col("width") - 2 * F.col("border") - 2 * F.col("padding")
    inner_h = F.col("height") - 2 * F.col("border") - 2 * F.col("padding")
    nw, nh = F.col("natural_width"), F.col("natural_height")
    contain = F.least(F.col("inner_w") / nw, F.col("inner_h") / nh)
    cover = F.greatest(F.col("inner_w") / nw, F.col("inner_h") / nh)

    def scale(own: Column) -> Column:
        return (
            F.when(fit == "contain", contain).when(fit == "cover", cover).when(fit == "none", F.lit(1.0))
            .when(fit == "scale-down", F.least(F.lit(1.0), contain)).otherwise(own)
        )

    def offset(position: Column, free: Column) -> Column:
        number = F.regexp_extract(position, r"^(-?[0-9.]+)", 1).try_cast("double")
        return (
            F.when(position.endswith("%"), free * number / 100)
            .when(position.isin("left", "top"), F.lit(0.0))
            .when(position.isin("right", "bottom"), free)
            .when(position == "center", free / 2)
            .otherwise(F.coalesce(number, free / 2))
        )

    placed = (
        images.withColumns({"inner_w": inner_w, "inner_h": inner_h})
        .where("inner_w > 0 AND inner_h > 0 AND natural_width > 0 AND natural_height > 0")
        .withColumns({"paint_w": nw * scale(F.col("inner_w") / nw), "paint_h": nh * scale(F.col("inner_h") / nh)})
        .withColumns({
            "paint_x": F.col("left") + F.col("border") + F.col("padding")
            + offset(F.col("along_x"), F.col("inner_w") - F.col("paint_w")),
            "paint_y": F.col("top") + F.col("border") + F.col("padding")
            + offset(F.col("along_y"), F.col("inner_h") - F.col("paint_h")),
        })
    )
    sx, sy = nw / F.col("paint_w"), nh / F.col("paint_h")
    raw = drawn.join(placed, key).withColumns({
        "_l": (F.col("dx") - F.col("paint_x")) * sx, "_t": (F.col("dy") - F.col("paint_y")) * sy,
    }).withColumns({"_r": F.col("_l") + F.col("dw") * sx, "_b": F.col("_t") + F.col("dh") * sy})

    def inside(value: str, limit: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(limit, F.col(value)))

    return (
        raw.withColumns({"_x0": inside("_l", nw), "_y0": inside("_t", nh), "_x1": inside("_r", nw), "_y1": inside("_b", nh)})
        .where("_x1 - _x0 > 0 AND _y1 - _y0 > 0")
        .select(
            key,
            g.half_up(F.col("_x0")).alias("x"), g.half_up(F.col("_y0")).alias("y"),
            g.half_up(F.col("_x1") - F.col("_x0")).alias("w"), g.half_up(F.col("_y1") - F.col("_y0")).alias("h"),
            ((F.col("_l") < -1) | (F.col("_t") < -1) | (F.col("_r") > nw + 1) | (F.col("_b") > nh + 1)).alias("clipped"),
        )
    )


def weak_readings(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("confidence") < WEAK_CONFIDENCE)


def route_regions(regions: DataFrame, fields: DataFrame, balloons: DataFrame, key: str = "region_id") -> DataFrame:
    """Each region's treatment: fill when it has a balloon, label when its field is art, else erase."""
    return (
        regions.join(balloons.select(key, F.lit(True).alias("filled")), key, "left")
        .join(fields.select(key, "coverage"), key, "left")
        .withColumn(
            "route",
            F.when(F.col("filled"), "fill").when(F.col("coverage") < PLATE_COVERAGE, "label").otherwise("erase"),
        )
        .drop("filled")
    )


def classify_requests(settings: DataFrame) -> DataFrame:
    """Why a request cannot run with these settings, or ``ok``."""
    cloud = F.col("provider") == "cloud"
    return settings.withColumn(
        "reason",
        F.when(cloud & (F.col("api_key") == ""), "no-api-key").when(cloud, "ok")
        .when(F.col("target") != "en", "cloud-only-target")
        .when(~F.col("webgpu"), "no-webgpu").otherwise("ok"),
    )


def classify_failures(replies: DataFrame) -> DataFrame:
    """What an HTTP failure means to the user."""
    status = F.col("status")
    return replies.withColumn(
        "category",
        F.when((status == 400) & F.col("detail").rlike(r"(?i)api.?key"), "key-rejected")
        .when(status.isin(401, 403), "key-refused").when(status == 429, "rate-limit")
        .when(status >= 500, "server").otherwise("other"),
    )


def plate_styles(tones: DataFrame) -> DataFrame:
    """Ink and opacity of a caption plate of tone r, g, b."""
    r, gr, b = F.col("r"), F.col("g"), F.col("b")
    black = colour.relative_luminance(r, gr, b) > colour.INK_CROSSOVER
    toward = F.when(black, F.lit(0.0)).otherwise(F.lit(255.0))

    def mix(value: Column) -> Column:
        return colour.PLATE_ALPHA * value + (1 - colour.PLATE_ALPHA) * toward

    worst = colour.relative_luminance(mix(r), mix(gr), mix(b))
    legible = colour.contrast(worst, F.when(black, F.lit(0.0)).otherwise(F.lit(1.0)))
    return tones.withColumns({
        "ink": F.when(black, "#000000").otherwise("#ffffff"),
        "alpha": F.when(legible < colour.PLATE_MIN_CONTRAST, F.lit(1.0)).otherwise(F.lit(colour.PLATE_ALPHA)),
    })


def ranked(detections: DataFrame) -> DataFrame:
    """Best score first; the box decides ties. A range-partitioned sort."""
    return detections.orderBy(F.desc("score"), "det_id")


def best_targets(tiles: DataFrame, strips: DataFrame, viewport: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Per document the image most of the viewport shows: whole images first, then slices of a strip.

    ``strips`` have their tiles' columns (``keep`` of ``sequences.strips``), so the tiles are not joined with them.
    """
    vx, vy, vw, vh = viewport
    b = g.box()
    across = F.greatest(F.lit(0.0), F.least(b.right - vx, vw) - F.greatest(b.x - vx, F.lit(0.0)))
    down = F.greatest(F.lit(0.0), F.least(b.bottom - vy, vh) - F.greatest(b.y - vy, F.lit(0.0)))
    whole = clears_gate(b.w, b.h)

    def shown(found: DataFrame, wanted: Column) -> DataFrame:
        return found.where(has_pixels() & wanted).select("doc_id", "tile_id", (across * down).alias("visible_area"), whole.alias("whole")).where("visible_area > 0")

    rows = shown(tiles, whole).unionByName(shown(strips, ~whole & clears_gate(b.w, F.col("height"))))
    first = F.min_by(
        F.struct("tile_id", "visible_area", "whole"),
        F.struct(~F.col("whole"), -F.col("visible_area"), F.col("tile_id")),
    )
    return rows.groupBy("doc_id").agg(first.alias("best")).select("doc_id", "best.*")


def global_rank(df: DataFrame, column: str, name: str = "rank", buckets: int = 256) -> DataFrame:
    """Row number over the whole table in order of a unique numeric column, without a single-task sort.

    Rows are cut at quantiles of the column, ranked within their cut, and moved
    by the counts of the cuts before, of which there are at most ``buckets``.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(column, shares, 10_000)).first()[0] or []
    levels = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<long>")
    placed = df.withColumn("_cut", F.size(F.filter(levels, lambda c: c < F.col(column))))
    earlier = W.orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    before = (
        placed.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
        .select("_cut", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(W.partitionBy("_cut").orderBy(column))
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(before), "_cut")  # at most `buckets` rows
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_cut")
    )


def strided(df: DataFrame, column: str, stride: int = 5) -> DataFrame:
    """Every ``stride``-th row in order of a unique column, the first included."""
    return global_rank(df, column, "_rank").where((F.col("_rank") - 1) % stride == 0).drop("_rank")


def quota_head(pages: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` jobs (pages, then negatives) plus a tenth as many negatives.

    A negative can come twice when the limit reaches past the pages.
    """
    is_page = F.col("kind") == "page"
    ranked = global_rank(pages.where(is_page), order, "_rank")
    negatives = global_rank(pages.where(~is_page), order, "_rank")
    beyond = max(0, limit - pages.where(is_page).count())
    head = ranked.where(F.col("_rank") <= limit).unionByName(negatives.where(F.col("_rank") <= beyond))
    return head.unionByName(negatives.where(F.col("_rank") <= max(1, limit // 10))).drop("_rank")


def latest_keys(touches: DataFrame, group: str, key: str, at: Sequence[str], keep: int = RETAINED_KEYS) -> DataFrame:
    """The keys touched last, newest first. Touching a key again moves it to the front.

    The rank filter is pushed below the shuffle as a per-partition limit, so a
    busy group sends at most ``keep`` rows per task.
    """
    newest = touches.groupBy(group, key).agg(F.max(F.struct(*at)).alias("_at"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_at")))
    return newest.withColumn("place", place).where(F.col("place") <= keep).select(group, key, "place")

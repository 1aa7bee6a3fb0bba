"""Balloon windows: which regions sit in a flat balloon, what is painted, and where text may go.

A window is one row of dense arrays over the padded bounds of a region: its
pixel channels, its erase mask (``base``) and its certain text (``seed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkfield.functions.arrays import bind
from inkfield.operators import raster as rs
from inkfield.session import cut_lineage

# Fixed values the results depend on.
FIELD_COVERAGE = 0.73
COLOR_TOLERANCE = 40
INK_LUMA = 128
GUARD = 0.05
PAD_FRACTION, PAD_MIN = 0.5, 8
INTERIOR_MAX = 3.0
LOBE_MIN_SHARE, LOBE_INSET, LOBE_INSET_MIN, LOBE_MIN_SIDE, SECOND_LOBE = 0.15, 0.06, 2.0, 8.0, 0.35


def region_windows(cells: DataFrame, key: str, page_width: Column, page_height: Column) -> DataFrame:
    """Bounds of a region's set cells, padded by half the longest side or more, clipped to the page."""
    bounds = cells.groupBy(key).agg(
        F.min("row").alias("t"), (F.max("row") + 1).alias("b"), F.min("col").alias("l"), (F.max("col") + 1).alias("r"),
        F.max(page_width).alias("_pw"), F.max(page_height).alias("_ph"),
    )
    pad = F.floor(F.greatest(F.lit(PAD_MIN), PAD_FRACTION * F.greatest(F.col("b") - F.col("t"), F.col("r") - F.col("l"))))
    return bounds.select(
        key, F.greatest(F.lit(0), F.col("t") - pad).alias("y0"), F.least("_ph", F.col("b") + pad).alias("y1"),
        F.greatest(F.lit(0), F.col("l") - pad).alias("x0"), F.least("_pw", F.col("r") + pad).alias("x1"),
    )


def _both(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _count(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, v: s + v)


def _labels_where(labels: str, on: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(
        F.zip_with(F.col(labels), on, lambda label, v: F.when(v == 1, label)), lambda label: label.isNotNull() & (label >= 0)
    )))


def window_fields(windows: DataFrame, key: str) -> DataFrame:
    """Two-tone field of each window's sample: its certain text, or all of its mask when there is none."""
    chosen = windows.withColumn("_seed", _both("seed", "base")).withColumn(
        "_sample", F.when(F.array_contains("_seed", 1), F.col("_seed")).otherwise(F.col("base"))
    )
    pixels = chosen.select(key, F.explode(F.arrays_zip("r", "g", "b", "_sample")).alias("p")).where("p._sample = 1").select(
        key, "p.r", "p.g", "p.b"
    )
    return rs.fields(rs.dominant_tones(rs.luma_of(pixels), key), key)


def clip_to_balloon(windows: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions filled flat: (region with colour and painted cells, its lobes, closed parts as cells).

    A region is left out, to be erased the other way, when its sample is not a
    flat field, no field component meets its seed, or filling would lose more
    than a small share of its ink.
    """
    ground = window_fields(windows, key).withColumnsRenamed({"r": "gr", "g": "gg", "b": "gb"})
    near = F.transform(
        F.arrays_zip("r", "g", "b"),
        lambda p: ((F.abs(p["r"] - F.col("gr")) <= COLOR_TOLERANCE) & (F.abs(p["g"] - F.col("gg")) <= COLOR_TOLERANCE)
                   & (F.abs(p["b"] - F.col("gb")) <= COLOR_TOLERANCE)).cast("int"),
    )
    dark = F.transform(F.arrays_zip("r", "g", "b"), lambda p: (
        F.floor((p["r"] * 299 + p["g"] * 587 + p["b"] * 114) / 1000) < INK_LUMA).cast("int"))
    flat = cut_lineage(
        windows.join(ground, key).where(F.col("coverage") >= FIELD_COVERAGE)
        .withColumns({"near": near, "ink": dark, "_seed": _both("seed", "base")})
        .withColumns({"labels": rs.label_dense("near", "width"), "shapes": rs.label_dense("ink", "width")})
    )
    flat = cut_lineage(
        flat
        .withColumn("reached", _labels_where("labels", F.zip_with("_seed", "near", lambda s, n: s * n)))
        .where(F.size("reached") > 0)
        .withColumn("_reached_cells", bind(
            F.struct("labels", "reached"), lambda s: F.transform(s["labels"], lambda v: F.array_contains(s["reached"], v).cast("int"))))
    )
    # Cut here and below: the labelled windows are read several times, and a
    # checkpoint keeps the UDF results as columns instead of inlining them.
    filled = cut_lineage(rs.fill_holes(flat, "_reached_cells", "balloon").withColumn(
        "_leaving", _labels_where("shapes", F.zip_with("ink", "base", lambda i, b: i * (1 - b)))
    ).drop("near", "_seed", "_reached_cells", "coverage"))
    ink_total = _count(_both("ink", "base"))
    lost = bind(F.struct(F.arrays_zip("ink", "base", "shapes", "balloon").alias("cells"), "_leaving"), lambda s: F.size(F.filter(
        s["cells"],
        lambda c: (c["ink"] == 1) & (c["base"] == 1) & (c["balloon"] == 0) & ~F.array_contains(s["_leaving"], c["shapes"]),
    )))
    kept = filled.where((ink_total == 0) | (lost / ink_total <= GUARD)).withColumns({
        "_limit": INTERIOR_MAX * _count(F.col("base")), "paint": _both("base", "balloon"),
    })

    one = cut_lineage(
        kept.select(key, "width", "_limit", "labels", F.explode("reached").alias("label"))
        .withColumn("own", F.transform("labels", lambda v: (v == F.col("label")).cast("int")))
        .drop("labels")
    )
    parts = cut_lineage(
        rs.fill_holes(one, "own", "part").drop("own")
    ).withColumn("area", _count(F.col("part")))
    border = rs.on_border(F.size("part"), F.col("width"))
    clear = ~bind(F.struct("part", border.alias("border")), lambda s: F.exists(
        s["border"], lambda i: F.element_at(s["part"], (i + 1).cast("int")) == 1))
    closed = rs.explode_map(
        parts.where(clear & (F.col("area") <= F.col("_limit"))), [key, "label", "area"], "part", F.col("width"), "on"
    ).where("on = 1").drop("on")
    painted = rs.mask_union(
        [rs.explode_map(kept, [key], "paint", F.col("width"), "on").where("on = 1"), closed], [key]
    )
    fills = kept.select(
        key, "width", *(F.floor(F.col(c) + 0.5).cast("int").alias(n) for c, n in (("gr", "red"), ("gg", "green"), ("gb", "blue")))
    ).join(painted.groupBy(key).agg(F.count(F.lit(1)).alias("pixels")), key, "left").fillna(0, ["pixels"])
    return fills, lobes(closed, key), painted


def lobes(closed: DataFrame, key: str) -> DataFrame:
    """Up to two text rectangles per closed part, inset; small parts and small rectangles dropped."""
    areas = closed.select(key, "label", "area").distinct().groupBy(key).agg(F.sum("area").alias("closed_area"))
    large = closed.join(areas, key).where(F.col("area") >= LOBE_MIN_SHARE * F.col("closed_area"))
    keys = [key, "label"]
    first = rs.largest_rectangles(large, keys)
    named = first.withColumnsRenamed({c: f"f{c}" for c in "xywh"})
    inside = (F.col("col").between(F.col("fx"), F.col("fx") + F.col("fw") - 1)
              & F.col("row").between(F.col("fy"), F.col("fy") + F.col("fh") - 1))
    second = rs.largest_rectangles(large.join(named, keys).where(~inside), keys)
    follows = second.join(named, keys).where(F.col("w") * F.col("h") >= SECOND_LOBE * F.col("fw") * F.col("fh"))
    both = first.withColumn("place", F.lit(0)).unionByName(
        follows.select(*keys, "x", "y", "w", "h", F.lit(1).alias("place"))
    )
    short = F.least("w", "h")
    inset = F.greatest(F.lit(LOBE_INSET_MIN), LOBE_INSET * short)
    return both.where(short - 2 * inset >= LOBE_MIN_SIDE).select(
        *keys, "place", (F.col("x") + inset).alias("x"), (F.col("y") + inset).alias("y"),
        (F.col("w") - 2 * inset).alias("w"), (F.col("h") - 2 * inset).alias("h"),
    )

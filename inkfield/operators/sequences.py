"""Strips of touching tiles, segments at gaps, repeats, and order-dependent packing."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkfield.functions import geometry as g
from inkfield.operators.ordered import islands, ordered_scan
from inkfield.session import same_columns, spread

# Fixed values the results depend on.
EDGE_TOLERANCE = 2
MIN_TILES = 3
STRIP_CELL = 32  # of left edges; wider than the tolerance, so that few tiles are of two
INK_ACTIVE, INK_GAP, MIN_CELL = 0.03, 0.045, 0.3
MAX_REPEATS, MAX_LENGTH = 16, 300
START_TOKEN, END_TOKEN = 2, 3
CHUNK_CHARS = 18
VERTICAL_SHARE = 0.6


def strips(tiles: DataFrame, bucket_height: float = 4096.0, keep: Sequence[str] = ()) -> DataFrame:
    """Tiles that make up one long picture: at least three on top of each other without a gap, of one width and left edge; each with its place.

    A tile's column holds the tiles within the tolerance of *its* left edge and
    width. Tiles of equal left and width share a column, so columns are built
    per distinct (left, width), not per pair of tiles. ``keep`` are further
    columns of the tiles to come along.

    Tiles are dealt once, by document, cell of left edges and bucket of heights;
    one whose columns may be of the next cell goes there too. Runs are found
    inside a bucket. Only where a document's cell has several buckets are the
    first and last run of each put together with those of its neighbours.
    """
    t, spot = EDGE_TOLERANCE, ["doc_id", "_cell", "_bucket"]

    def cell(x: Column) -> Column:
        return F.floor(x / STRIP_CELL)

    placed = tiles.where("h > 0").select(
        *dict.fromkeys(["doc_id", "tile_id", "x", "y", "w", *keep]), (F.col("y") + F.col("h")).alias("bottom"),
        F.coalesce(F.floor(F.col("y") / bucket_height), F.lit(-(2**63))).alias("_bucket"),
    )
    # The columns of a cell, in each bucket of the cell.
    own = placed.where("w > 0").select("doc_id", cell(F.col("x")).alias("_cell"), F.col("x").alias("kx"), F.col("w").alias("kw")).distinct()
    reached = F.explode(F.sequence(cell(F.col("x") - t), cell(F.col("x") + t))).alias("_cell")
    dealt = spread(placed.select("*", reached), *spot)
    buckets = placed.select("doc_id", reached, "_bucket").groupBy("doc_id", "_cell").agg(F.collect_set("_bucket").alias("_buckets"))
    columns = own.join(buckets, ["doc_id", "_cell"]).select(
        "doc_id", "_cell", "kx", "kw", (F.size("_buckets") > 1).alias("_several"), F.explode("_buckets").alias("_bucket"))
    alike = (F.abs(F.col("x") - F.col("kx")) <= t) & (F.abs(F.col("w") - F.col("kw")) <= t)
    column = [*spot, "kx", "kw"]
    along, run = W.partitionBy(*column).orderBy("y", "tile_id"), W.partitionBy(*column, "_run")
    parted = F.col("above").isNull() | (F.abs(F.col("y") - F.col("above")) > t)
    paired = dealt.join(columns, spot).where(alike)

    def in_runs(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"place": F.row_number().over(along), "above": F.lag("bottom").over(along)}).withColumn(
            "_run", F.sum(F.when((F.col("place") > 1) & parted, 1).otherwise(0)).over(along.rowsBetween(W.unboundedPreceding, 0)))

    runs = in_runs(paired).withColumns({
        "tiles": F.count(F.lit(1)).over(run), "_first": F.min("place").over(run), "top": F.min("y").over(run),
        "last_bottom": F.max_by("bottom", "place").over(run),
    })
    pieces = _pieces(in_runs(paired.where(F.col("_several") & same_columns(dealt, "kx", "kw"))), column, t)
    theirs = pieces.withColumnsRenamed({c: f"_of_{c}" for c in pieces.columns})
    same = functools.reduce(lambda m, c: m & (F.col(c) == F.col(f"_of_{c}")), spot, F.lit(True))
    for c in ("kx", "kw", "_run"):  # by order: as keys of the join they would have the rows dealt again
        same = same & (F.col(c) <= F.col(f"_of_{c}")) & (F.col(c) >= F.col(f"_of_{c}"))
    joined = F.col("_of__run").isNotNull()

    def whole(name: str) -> Column:
        return F.when(joined, F.col(f"_of_{name}")).otherwise(F.col(name))

    return (
        runs.where((F.col("x") == F.col("kx")) & (F.col("w") == F.col("kw")))
        .join(theirs, same, "left")
        .select(
            "tile_id", "doc_id", *keep, whole("tiles").alias("tiles"),
            (F.col("place") - F.col("_first") + F.coalesce("_of_before", F.lit(0))).alias("position"),
            (whole("last_bottom") - whole("top")).alias("height"),
        )
        .where(F.col("tiles") >= MIN_TILES)
    )


def _pieces(rows: DataFrame, column: Sequence[str], tolerance: float) -> DataFrame:
    """The first and last run of each bucket with the extents of the whole run that each is part of; ``before``: its tiles above."""
    lowest = F.max("_run").over(W.partitionBy(*column))
    ends = (
        rows.withColumn("_last", lowest).where("_run = 0 OR _run = _last")
        .groupBy(*column, "_run").agg(
            F.count(F.lit(1)).alias("_n"), F.min("y").alias("_top"), F.min_by("y", "place").alias("_from"), F.max_by("bottom", "place").alias("_to"))
    )
    whole = [c for c in column if c != "_bucket"]
    down = W.partitionBy(*whole).orderBy("_bucket", "_run")
    opens = (F.col("_run") > 0) | F.col("_above").isNull() | (F.abs(F.col("_from") - F.col("_above")) > tolerance)
    joined = ends.withColumn("_above", F.lag("_to").over(down)).withColumn("_whole", F.sum(F.when(opens, 1).otherwise(0)).over(down))
    of = W.partitionBy(*whole, "_whole")
    return joined.select(
        *column, "_run", F.sum("_n").over(of).alias("tiles"), F.min("_top").over(of).alias("top"),
        F.max_by("_to", F.struct("_bucket", "_run")).over(of).alias("last_bottom"),
        F.sum("_n").over(of.orderBy("_bucket", "_run").rowsBetween(W.unboundedPreceding, -1)).alias("before"),
    )


def gap_segments(rows: DataFrame, group: str, bucket_rows: int = 4096) -> DataFrame:
    """Segments of active rows cut at gaps, per group of (row, count, width, rows).

    A row is active when its count passes ``max(1, 0.03 width)``. A run of
    ``max(1, round(0.045 width))`` inactive rows closes a segment at the run's
    start; the last open one runs to the end. Short segments go; a group left
    with none is one whole segment.
    """
    width = F.col("width")
    least_gap = F.greatest(F.lit(1), g.half_up(width * INK_GAP))
    active = rows.where(F.col("count") > F.greatest(F.lit(1.0), width * INK_ACTIVE))
    bucket = F.floor(F.col("row") / bucket_rows)
    seen = islands(
        active, [group], ["row"], bucket, lag={"before": "row"},
        opens=F.col("before").isNull() | (F.col("row") - F.col("before") - 1 >= least_gap),
    )
    segments = (
        seen
        .groupBy(group, "island", "width", "rows")
        .agg(F.min("row").alias("top"), (F.max("row") + 1).alias("end"))
        .withColumn("bottom", F.when(F.col("rows") - F.col("end") < least_gap, F.col("rows")).otherwise(F.col("end")))
        .where(F.col("bottom") - F.col("top") >= width * MIN_CELL)
        .select(group, "top", "bottom")
    )
    groups = rows.groupBy(group).agg(F.max("rows").alias("rows"), F.max("width").alias("width"))
    return groups.join(segments, group, "left").select(
        group, F.coalesce("top", F.lit(0)).cast("long").alias("top"),
        F.coalesce("bottom", "rows").cast("long").alias("bottom"), "width",
    )


def unroll_plan(segments: DataFrame, group: str) -> DataFrame:
    """Where each segment of a column goes in the strip: square cells left to right.

    A group has at most one segment per row of its image, so the window is bounded.
    """
    cell = F.row_number().over(W.partitionBy(group).orderBy("top")) - 1
    return segments.withColumn("cell", cell).withColumn("target_x", F.col("cell") * F.col("width"))


def best_class(probabilities: Column) -> Column:
    """Index of the greatest value of an array, the first on ties."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1


def collapse_repeats(symbols: DataFrame, group: str, order: Sequence[str], bucket: Column, blank: int = 0) -> DataFrame:
    """Steps whose class differs from the step before and is not blank."""
    seen = ordered_scan(symbols, [group], order, bucket, lag={"before": "class"})
    return seen.where((F.col("class") != blank) & ~F.col("class").eqNullSafe(F.col("before"))).drop("before")


def collapse_array(classes: Column, blank: int = 0) -> Column:
    """The same on an array of classes: positions that are kept, from 0."""
    positions = F.sequence(F.lit(0), F.size(classes) - 1)
    return F.filter(
        positions,
        lambda i: (F.element_at(classes, i + 1) != blank)
        & ((i == 0) | (F.element_at(classes, i + 1) != F.element_at(classes, F.greatest(i, F.lit(1))))),
    )


def repeat_guard(symbols: DataFrame, group: str, order: Sequence[str], bucket: Column, max_repeats: int = MAX_REPEATS, max_length: int = MAX_LENGTH) -> DataFrame:
    """Each sequence up to its end token, one repeat in a row more than ``max_repeats``, or ``max_length`` steps.

    The start token stands before the first step, so a leading run of it is one
    repeat ahead.
    """
    runs = islands(
        symbols, [group], order, bucket, lag={"before": "class"},
        opens=~F.col("class").eqNullSafe(F.col("before")), island="run", rank="place",
    )
    starts = runs.groupBy(group, "run").agg(F.min("place").alias("run_start"))
    marked = runs.join(starts, [group, "run"])
    ahead = F.when((F.col("run") == 1) & (F.col("class") == START_TOKEN), 1).otherwise(0)
    stops = (F.col("class") == END_TOKEN) | (F.col("place") - F.col("run_start") + ahead >= max_repeats)
    first_stop = marked.where(stops).groupBy(group).agg(F.min("place").alias("stop"))
    return (
        marked.join(first_stop, group, "left")
        .where((F.col("place") < F.coalesce("stop", F.lit(max_length + 1))) & (F.col("place") <= max_length))
        .drop("run", "run_start", "before", "stop")
    )


def running_best(epochs: DataFrame, run: str, order: str, metric: str, seconds: str, cap: float, bucket: Column) -> DataFrame:
    """Epochs that beat every earlier one, and the first epoch past a time cap."""
    timed = ordered_scan(epochs, [run], [order], bucket, total={"elapsed": seconds})
    # The best so far is a running maximum: within a bucket by window, across buckets by their maxima.
    cut = timed.withColumn("_b", bucket)
    inside = W.partitionBy(run, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    tops = cut.groupBy(run, "_b").agg(F.max(metric).alias("_top"))
    across = W.partitionBy(run).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(run, "_b", F.max("_top").over(across).alias("_above"))
    best_before = F.greatest(F.max(metric).over(inside), F.col("_above"))
    ranked = cut.join(tops, [run, "_b"]).withColumn("best_before", best_before)
    past = ranked.where(F.col("elapsed") > cap).groupBy(run).agg(F.min(order).alias("stop_at"))
    return ranked.join(past, run, "left").select(
        run, order, metric,
        (F.col("best_before").isNull() | (F.col(metric) > F.col("best_before"))).alias("is_best"),
        "stop_at", (F.col("stop_at").isNull() | (F.col(order) <= F.col("stop_at"))).alias("was_run"),
    )


def _row_fold(boxes: Column) -> Column:
    """Rows of boxes already sorted by centre: each box joins the first row close enough, else opens one."""
    empty = F.array().cast("array<struct<centre:double,thickness:double,ids:array<struct<along:double,id:string>>>>")

    def place(rows: Column, b: Column) -> Column:
        def near(row: Column) -> Column:
            return F.abs(b["centre"] - row["centre"]) < 0.5 * F.least(b["thickness"], row["thickness"])

        item = F.struct(b["along"].alias("along"), b["id"].alias("id"))
        hit = F.array_position(F.transform(rows, lambda r: near(r)), True)
        opened = F.struct(b["centre"].alias("centre"), b["thickness"].alias("thickness"), F.array(item).alias("ids"))
        grown = F.transform(
            rows,
            lambda r, i: F.when(
                i + 1 == hit,
                F.struct(
                    r["centre"].alias("centre"), F.least(r["thickness"], b["thickness"]).alias("thickness"),
                    F.concat(r["ids"], F.array(item)).alias("ids"),
                ),
            ).otherwise(r),
        )
        return F.when(hit == 0, F.concat(rows, F.array(opened))).otherwise(grown)

    return F.aggregate(boxes, empty, place)


def reading_order(lines: DataFrame, group: str, key: str, extent: float = 4096.0) -> DataFrame:
    """Lines of a group in reading order: rows by centre, then along the row.

    Vertical groups (half or more tall lines) read columns right to left. Rows
    cannot reach across a gap of half the thickest line between neighbouring
    centres, so groups are cut there and only such a block is folded.
    """
    tall = g.is_tall(F.col("w"), F.col("h"))
    shape = lines.groupBy(group).agg(
        (2 * F.count_if(tall) >= F.count(F.lit(1))).alias("vertical"),
        F.max("w").alias("_mw"), F.max("h").alias("_mh"),
    )
    v = F.col("vertical")
    axes = lines.join(shape, group).select(
        group, key, "vertical",
        F.when(v, F.col("x") + F.col("w") / 2).otherwise(F.col("y") + F.col("h") / 2).alias("centre"),
        F.when(v, F.col("w")).otherwise(F.col("h")).alias("thickness"),
        F.when(v, F.col("y")).otherwise(F.col("x")).alias("along"),
        F.when(v, F.col("_mw")).otherwise(F.col("_mh")).alias("thickest"),
    )
    bucket = F.floor(F.col("centre") / extent)
    blocks = islands(
        axes, [group], ["centre", key], bucket, lag={"before": "centre"},
        opens=F.col("before").isNull() | (F.col("centre") - F.col("before") >= 0.5 * F.col("thickest")), island="block",
    )
    # Vertical blocks and rows run in reverse: both are numbered in reading direction.
    sign = F.when(v, -1).otherwise(1)
    packed = (
        blocks.groupBy(group, "vertical", "block")
        .agg(F.array_sort(F.collect_list(F.struct("centre", F.col(key).alias("id"), "thickness", "along"))).alias("boxes"))
        .withColumn("_block", sign * F.col("block"))
    )
    earlier = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    rows = _row_fold(F.col("boxes"))
    ordered = F.flatten(F.transform(F.when(v, F.reverse(rows)).otherwise(rows), lambda r: F.array_sort(r["ids"])))
    return (
        packed.withColumn("_before", F.coalesce(F.sum(F.size("boxes")).over(earlier), F.lit(0)))
        .select(group, "vertical", "_before", F.posexplode(ordered).alias("_in", "item"))
        .select(group, F.col("item.id").alias(key), "vertical", (F.col("_before") + F.col("_in")).alias("position"))
    )


def column_packing(lines: DataFrame, group: str, key: str) -> DataFrame:
    """Chunk number of every line of a vertical region: columns right to left, 18 characters a chunk.

    Regions with fewer than two lines, too few tall ones, or a single chunk are
    read whole and give no rows. Packing is a fold in column order; its state is
    the running estimate and chunk number, one pair per line of the region.
    """
    estimate = g.column_characters(F.col("w"), F.col("h"))
    tall = g.is_tall(F.col("w"), F.col("h"))
    folded = (
        lines.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(tall).alias("tall"),
            F.array_sort(F.collect_list(
                F.struct((-(F.col("x") + F.col("w") / 2)).alias("from_right"), F.col(key).alias("id"), estimate.alias("chars"))
            )).alias("columns"),
        )
        .where((F.col("n") >= 2) & (F.col("tall") >= VERTICAL_SHARE * F.col("n")))
    )
    start = F.struct(
        F.lit(0.0).alias("chars"), F.lit(0).alias("chunk"), F.lit(True).alias("empty"),
        F.array().cast("array<struct<id:string,chunk:int>>").alias("out"),
    )

    def pack(state: Column, c: Column) -> Column:
        full = ~state["empty"] & (state["chars"] + c["chars"] > CHUNK_CHARS)
        chunk = F.when(full, state["chunk"] + 1).otherwise(state["chunk"])
        chars = F.when(full, F.lit(0.0)).otherwise(state["chars"]) + c["chars"]
        item = F.struct(c["id"].alias("id"), chunk.alias("chunk"))
        return F.struct(
            chars.alias("chars"), chunk.alias("chunk"), F.lit(False).alias("empty"),
            F.concat(state["out"], F.array(item)).alias("out"),
        )

    packed = folded.select(group, F.aggregate("columns", start, pack).alias("state"))
    return (
        packed.where("state.chunk > 0")
        .select(group, F.explode("state.out").alias("item"))
        .select(group, F.col("item.id").alias(key), F.col("item.chunk").alias("chunk"))
    )


def chunk_boxes(lines: DataFrame, chunks: DataFrame, group: str, key: str) -> DataFrame:
    """Floored hull of every chunk."""
    b = g.box()
    return (
        chunks.join(lines, [group, key])
        .groupBy(group, "chunk")
        .agg(
            F.floor(F.min(b.x)).alias("x0"), F.floor(F.min(b.y)).alias("y0"),
            F.floor(F.max(b.right)).alias("x1"), F.floor(F.max(b.bottom)).alias("y1"),
        )
    )


def lobe_order(lobes: DataFrame, group: str, key: str, extent: float = 64.0) -> DataFrame:
    """Lobes of a balloon in reading order; at most two rectangles per closed part.

    Ranked by ``ordered_scan`` in stretches of ``extent`` along the reading direction.
    """
    b = g.box()
    centre = F.when(F.col("vertical"), -(b.x + b.w / 2)).otherwise(b.y + b.h / 2)
    ranked = ordered_scan(lobes.withColumn("_centre", centre), [group], ["_centre", key], F.floor(F.col("_centre") / extent), rank="position")
    return ranked.drop("_centre").withColumn("position", F.col("position") - 1)

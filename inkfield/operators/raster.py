"""Raster cells: components, boxes, masks, holes, tones, rectangles, label targets.

Two forms of one raster are used. A *dense* map is one row with an array of
cells; it is as large as one image and is labelled in place, with no shuffle.
A *cell table* has one row per set cell and may hold rasters of any size;
``connected_components`` works on it with joins only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from inkfield.functions import colour, geometry as g
from inkfield.session import cut_lineage, spread

# Fixed values the results depend on.
BINARIZE = 0.3
MIN_CELLS = 3
LINE_SCORE, LINE_SIDE = 0.6, 3
ERASE_GROW = 0.75
MIN_CORE_SIDE = 2
DARK_LUMA = 80
TONE_BINS, TONE_TOLERANCE = 64, 24
FIELD_MARGIN = 6

ROW_BAND = 64  # rows of a mask that are one task's
PLACE_BITS = [sum(1 << i for i in range(64) if i >> k & 1) - (1 << 64) for k in range(6)]  # bits of a long whose place has bit k, as signed
GRID_CELLS = 1 << 23  # cells of painted rasters that are held together

NODE_SHIFT = 31  # a node id is row * 2^31 + column


# --- components ------------------------------------------------------------


@F.pandas_udf(ArrayType(IntegerType()))
def label_dense(cells: pd.Series, width: pd.Series) -> pd.Series:
    """4-connected labels of an array of 0/1 cells: the smallest cell index of the component, -1 where unset.

    Maps of one shape are labelled together: labels take the least of their
    neighbours' and jump to their label's label until nothing changes.
    """
    out = [None] * len(cells)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (c, w) in enumerate(zip(cells, width)):
        if c is not None:
            shapes.setdefault((len(c), int(w)), []).append(i)
    for (size, w), rows in shapes.items():
        on = np.stack([np.asarray(cells.iloc[i], dtype=bool) for i in rows]).reshape(len(rows), -1, w)
        labels = np.where(on, np.arange(size).reshape(-1, w), size)
        while size:
            least = labels.copy()
            np.minimum(least[:, 1:], labels[:, :-1], out=least[:, 1:])
            np.minimum(least[:, :-1], labels[:, 1:], out=least[:, :-1])
            np.minimum(least[:, :, 1:], labels[:, :, :-1], out=least[:, :, 1:])
            np.minimum(least[:, :, :-1], labels[:, :, 1:], out=least[:, :, :-1])
            least[~on] = size
            flat = np.concatenate([least.reshape(len(rows), size), np.full((len(rows), 1), size)], axis=1)
            jumped = np.take_along_axis(flat, flat, axis=1)[:, :size].reshape(labels.shape)
            if np.array_equal(jumped, labels):
                break
            labels = jumped
        labels[~on] = -1
        for i, one in zip(rows, labels):
            out[i] = one.ravel()
    return pd.Series(out)


def horizontal_runs(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set cells as runs along each row; a window is one row of one raster."""
    place = F.row_number().over(W.partitionBy(*keys, "row").orderBy("col"))
    return (
        cells.select(*keys, "row", "col").distinct()
        .withColumn("_run", F.col("col") - place)
        .groupBy(*keys, "row", "_run")
        .agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
        .drop("_run")
    )


def connected_components(cells: DataFrame, keys: Sequence[str], block: int = 64) -> DataFrame:
    """Cells with ``label_row, label_col``: the first cell, in row order, of their 4-connected component.

    Runs are the nodes; runs of neighbouring rows that share a column are
    linked. Labels spread by alternating large-star and small-star rounds
    (Kiveris et al., 2014), whose number grows with the logarithm of the
    component size; lineage is cut every round.
    """
    node = F.shiftleft(F.col("row").cast("long"), NODE_SHIFT) + F.col("c0")
    runs = cut_lineage(horizontal_runs(cells, keys).withColumn("_node", node))
    spans = runs.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block)))
    )
    above = spans.select(
        *keys, (F.col("row") + 1).alias("row"), "_block", F.col("c0").alias("a0"), F.col("c1").alias("a1"),
        F.col("_node").alias("_v"),
    )
    links = (
        spans.join(above, [*keys, "row", "_block"])
        .where((F.col("c0") <= F.col("a1")) & (F.col("a0") <= F.col("c1")))
        .select(*keys, F.col("_node").alias("_u"), "_v")
        .distinct()
    )
    labels = _star_labels(links, keys)
    named = (
        runs.join(labels, [*keys, "_node"], "left")
        .withColumn("label", F.coalesce("label", "_node"))
    )
    return named.select(
        *keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"),
        F.shiftright("label", NODE_SHIFT).cast("int").alias("label_row"),
        (F.col("label") - F.shiftleft(F.shiftright("label", NODE_SHIFT), NODE_SHIFT)).cast("int").alias("label_col"),
    )


def _star_labels(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node each linked node is connected to."""
    edges = cut_lineage(links)
    signature = None
    while True:
        both = edges.select(*keys, "_u", "_v").unionByName(edges.select(*keys, F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy(*keys, "_u").agg(F.least(F.min("_v"), F.first("_u")).alias("_m"))
        large = (
            both.join(least, [*keys, "_u"]).where("_v > _u")
            .select(*keys, F.col("_v").alias("_u"), F.col("_m").alias("_v")).where("_u <> _v").distinct()
        )
        low = large.groupBy(*keys, "_u").agg(F.min("_v").alias("_m"))
        small = (
            large.join(low, [*keys, "_u"])
            .select(*keys, F.explode(F.array(F.struct("_u", F.col("_m").alias("_v")), F.struct(F.col("_v").alias("_u"), F.col("_m").alias("_v")))).alias("_e"))
            .select(*keys, "_e._u", "_e._v").where("_u <> _v").distinct()
        )
        edges = cut_lineage(small)
        digest = F.xxhash64(*keys, "_u", "_v")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(digest, 20)), F.bit_xor(digest)).first()
        if now == signature:
            break
        signature = now
    return edges.select(*keys, F.col("_u").alias("_node"), F.col("_v").alias("label"))


def explode_map(maps: DataFrame, keys: Sequence[str], array: str, width: Column, value: str = "p") -> DataFrame:
    """Dense map to cell rows."""
    return maps.select(*keys, F.posexplode(array).alias("_pos", value), width.alias("_w")).select(
        *keys, F.floor(F.col("_pos") / F.col("_w")).cast("int").alias("row"), (F.col("_pos") % F.col("_w")).cast("int").alias("col"), value
    )


def labelled_cells(maps: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    """Cells above a level with their component label, from dense maps of (p array, width)."""
    on = F.transform("p", lambda v: (v > level).cast("int"))
    pairs = maps.withColumn("_label", label_dense(on, F.col("width"))).select(
        *keys, "width", F.posexplode(F.arrays_zip("p", "_label")).alias("pos", "cell")
    )
    return pairs.where("cell._label >= 0").select(
        *keys, F.floor(F.col("pos") / F.col("width")).cast("int").alias("row"),
        (F.col("pos") % F.col("width")).cast("int").alias("col"), F.col("cell.p").alias("p"), F.col("cell._label").alias("label"),
    )


def component_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("p").alias("score"),
        F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"),
    )


def component_boxes(stats: DataFrame, threshold: float, unshrink_scale: float = 1.0, stride: int = g.STRIDE) -> DataFrame:
    """Components as scored page boxes: grown back by the label shrink, unboxed, clamped, noise dropped.

    Rows carry ``scale, pad_x, pad_y, page_width, page_height`` of their page.
    """
    w, h = (F.col("c1") - F.col("c0") + 1) * stride, (F.col("r1") - F.col("r0") + 1) * stride
    d = unshrink_scale * g.unshrink_offset(w.cast("double"), h.cast("double"))

    def page(value: Column, pad: str, limit: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(g.undo_letterbox(value, F.col(pad), F.col("scale")), F.col(limit)))

    kept = stats.where((F.col("cells") >= MIN_CELLS) & (F.col("score") >= threshold)).withColumn("offset", d)
    grown = F.col("offset")
    return (
        kept.withColumns({
            "x": page(F.col("c0") * stride - grown, "pad_x", "page_width"),
            "y": page(F.col("r0") * stride - grown, "pad_y", "page_height"),
            "_r": page((F.col("c1") + 1) * stride + grown, "pad_x", "page_width"),
            "_b": page((F.col("r1") + 1) * stride + grown, "pad_y", "page_height"),
        })
        .where("_r > x AND _b > y")
        .withColumns({"w": F.col("_r") - F.col("x"), "h": F.col("_b") - F.col("y")})
        .drop("_r", "_b")
    )


def line_boxes(stats: DataFrame, scale_x: Column, scale_y: Column) -> DataFrame:
    """Components as text lines: small or weak ones dropped, the rest unclipped and scaled."""
    w, h = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    grow = g.unclip_offset(w, h)
    return stats.where((w >= LINE_SIDE) & (h >= LINE_SIDE) & (F.col("score") >= LINE_SCORE)).withColumns({
        "x": (F.col("c0") - grow) * scale_x, "y": (F.col("r0") - grow) * scale_y,
        "w": (w + 2 * grow) * scale_x, "h": (h + 2 * grow) * scale_y,
    })


def component_grid(cells: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Core cells of each component relative to its own first row and column."""
    return cells.join(stats.select(*keys, "label", "c0", "r0"), [*keys, "label"]).select(
        *keys, "label", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col")
    )


# --- masks -----------------------------------------------------------------


def column_distances(cells: DataFrame, keys: Sequence[str], radius: Column) -> DataFrame:
    """For each place of a column within a distance of one of its set cells, the steps to the nearest: keys, row, col, steps.

    Neighbours in a column share the rows between them at the middle, so a place
    is one row however many cells reach it, whatever the radius.
    """
    line = W.partitionBy(*keys, "col").orderBy("row")
    up = F.floor(radius).cast("long")
    before, after = F.lag("row").over(line), F.lead("row").over(line)
    # Halfway rows go to the cell above; of a cell that is there twice the second one starts below it.
    first = F.greatest(F.col("row") - up, before + F.floor((F.col("row") - before) / 2) + 1)
    last = F.least(F.col("row") + up, F.col("row") + F.floor((after - F.col("row")) / 2))
    spans = cells.select(*keys, "row", "col", first.alias("_first"), last.alias("_last")).where("_first <= _last")
    return spans.select(*keys, "col", F.col("row").alias("_from"), F.explode(F.sequence("_first", "_last")).alias("row")).select(
        *keys, "row", "col", F.abs(F.col("row") - F.col("_from")).alias("steps"))


def widened(cells: DataFrame, keys: Sequence[str], radius: Column) -> DataFrame:
    """Runs of cells within a distance of a set cell: keys, row, start and end (included).

    The distance is taken apart by direction: the nearest set cell of each
    column first, then, in each row, how far that one reaches to both sides.
    Compared on squared integers, so it is exact. ``radius`` is one number for
    each combination of keys.
    """
    near = column_distances(cells, keys, radius)
    rest = radius * radius - F.col("steps") * F.col("steps")
    side = F.floor(F.sqrt(rest))
    side = side + (F.pow(side + 1, F.lit(2)) <= rest).cast("long") - (F.pow(side, F.lit(2)) > rest).cast("long")  # a root may round over
    runs = near.where(rest >= 0).select(*keys, "row", (F.col("col") - side).alias("start"), (F.col("col") + side).alias("end"))
    line = W.partitionBy(*keys, "row").orderBy("start")
    before = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > before + 1, F.lit(True)).cast("int")
    numbered = runs.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "row", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def dilate(cells: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Cells within a distance of a set cell, compared on squared integers."""
    runs = widened(cells, keys, F.lit(float(radius)))
    kind = cells.schema["col"].dataType
    spread = runs.select(*keys, F.col("row").cast(cells.schema["row"].dataType), F.explode(F.sequence("start", "end")).alias("col"))
    return spread.withColumn("col", F.col("col").cast(kind))


def erase_mask(cells: DataFrame, boxes: DataFrame, keys: Sequence[str], grow: float = ERASE_GROW, stride: int = g.STRIDE) -> DataFrame:
    """Page pixels erased for each component: its core grown by a share of its offset, inside its box.

    A pixel belongs to the cell its top left corner falls in. The offset list of
    the growth is made per component, so its length is that component's disk.
    """
    side = stride / F.col("scale")
    left, top = F.floor(F.col("x")), F.floor(F.col("y"))
    right = F.least(F.col("page_width"), F.ceil(F.col("x") + F.col("w")))
    bottom = F.least(F.col("page_height"), F.ceil(F.col("y") + F.col("h")))
    framed = boxes.select(
        *keys, "label", "scale", "pad_x", "pad_y", "c0", "r0",
        F.greatest(F.lit(0), left).alias("wl"), F.greatest(F.lit(0), top).alias("wt"), right.alias("wr"), bottom.alias("wb"),
        (grow * F.col("offset") / F.col("scale")).alias("limit"),
    )

    def pixels(cell: Column, start: Column, first: Column, last: Column) -> Column:
        """Pixels whose floor((pixel - start) / side) is the cell, inside [first, last)."""
        guess = F.sequence(F.floor(start + cell * side) - 1, F.ceil(start + (cell + 1) * side) + 1)
        return F.filter(guess, lambda p: (F.floor((p - start) / side) == cell) & (p >= first) & (p < last))

    shape_x = (F.col("c0") * stride - F.col("pad_x")) / F.col("scale")
    shape_y = (F.col("r0") * stride - F.col("pad_y")) / F.col("scale")
    core = (
        cells.join(framed, [*keys, "label"])
        .withColumn("px", F.explode(pixels(F.col("col") - F.col("c0"), shape_x, F.col("wl"), F.col("wr"))))
        .withColumn("py", F.explode(pixels(F.col("row") - F.col("r0"), shape_y, F.col("wt"), F.col("wb"))))
    )
    frame = ["limit", "wl", "wt", "wr", "wb"]
    runs = widened(core.select(*keys, "label", *frame, F.col("py").alias("row"), F.col("px").alias("col")), [*keys, "label", *frame], F.col("limit"))
    inside = runs.where("row >= wt AND row < wb").withColumns({
        "start": F.greatest("start", F.ceil("wl")), "end": F.least("end", F.ceil("wr") - 1),
    })
    return inside.where("start <= end").select(*keys, "label", "row", F.explode(F.sequence("start", "end")).alias("col"))


def box_mask(boxes: DataFrame, keys: Sequence[str], b: g.Box | None = None) -> DataFrame:
    """Cells from floor of the near edge to ceiling of the far edge."""
    b = b or g.box()
    rows = F.sequence(F.floor(F.greatest(F.lit(0.0), b.y)), F.ceil(b.bottom) - 1)
    cols = F.sequence(F.floor(F.greatest(F.lit(0.0), b.x)), F.ceil(b.right) - 1)
    real = (F.ceil(b.bottom) > F.floor(F.greatest(F.lit(0.0), b.y))) & (F.ceil(b.right) > F.floor(F.greatest(F.lit(0.0), b.x)))
    return (
        boxes.where(real).withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
        .select(*keys, "row", "col").distinct()
    )


def box_mask_digest(boxes: DataFrame, keys: Sequence[str], width: int, b: g.Box | None = None) -> DataFrame:
    """Cells inside any box, as ``box_mask`` takes them, and the sum of their indexes in a raster of ``width`` columns.

    No row a cell is made: boxes are dealt by key and band of rows once, and the
    cells of a row are bits of longs, united where they are.
    """
    b = b or g.box()
    spans = boxes.select(
        *keys, F.floor(F.greatest(F.lit(0.0), b.y)).alias("_r0"), (F.ceil(b.bottom) - 1).alias("_r1"),
        F.floor(F.greatest(F.lit(0.0), b.x)).alias("_c0"), (F.ceil(b.right) - 1).alias("_c1"),
    ).where("_r1 >= _r0 AND _c1 >= _c0")
    dealt = spread(spans.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_r0") / ROW_BAND), F.floor(F.col("_r1") / ROW_BAND)))), *keys, "_band")
    first, last = F.greatest("_r0", F.col("_band") * ROW_BAND), F.least("_r1", F.col("_band") * ROW_BAND + ROW_BAND - 1)
    rows = dealt.withColumn("_row", F.explode(F.sequence(first, last))).withColumn(
        "_word", F.explode(F.sequence(F.shiftright("_c0", 6), F.shiftright("_c1", 6))))
    lo, hi = F.greatest(F.col("_c0") - 64 * F.col("_word"), F.lit(0)), F.least(F.col("_c1") - 64 * F.col("_word"), F.lit(63))
    bits = F.call_function("shiftleft", F.lit(-1).cast("long"), lo.cast("int")).bitwiseAND(
        F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (63 - hi).cast("int")))
    words = rows.groupBy(*keys, "_band", "_row", "_word").agg(F.bit_or(bits).alias("_bits"))
    n = F.bit_count("_bits").cast("long")
    # The places of a long's set bits add up by the bits of the places.
    places = sum(((1 << k) * F.bit_count(F.col("_bits").bitwiseAND(F.lit(m))).cast("long") for k, m in enumerate(PLACE_BITS)), F.lit(0))
    return (
        words.groupBy(*keys, "_band").agg(F.sum(n).alias("_n"), F.sum((F.col("_row") * width + 64 * F.col("_word")) * n + places).alias("_sum"))
        .groupBy(*keys).agg(F.sum("_n").alias("pixels"), F.sum("_sum").alias("index_sum"))
    )


def bare_masks(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Masks of regions without a shape, as one span of rows and columns each: the whole box (``erase``) and its middle half (``seed``).

    Regions carry x, y, w, h and their page's ``page_width, page_height``. Edges go
    outwards to whole pixels and stop at the page; a box with nothing on the page has no mask.
    """
    middle = [F.col("x") + F.col("w") / 4, F.col("y") + F.col("h") / 4, F.col("w") / 2, F.col("h") / 2]
    spans = []
    for part, (x, y, w, h) in (("erase", [F.col(c) for c in "xywh"]), ("seed", middle)):
        spans.append(F.struct(
            F.lit(part).alias("part"), F.greatest(F.lit(0), F.floor(x)).alias("left"), F.greatest(F.lit(0), F.floor(y)).alias("top"),
            F.least(F.col("page_width"), F.ceil(x + w)).alias("right"), F.least(F.col("page_height"), F.ceil(y + h)).alias("bottom"),
        ))
    return regions.select(*keys, F.inline(F.array(*spans))).where("right > left AND bottom > top")


def span_cells(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of masks that are spans."""
    return spans.select(*keys, "left", "right", F.explode(F.sequence("top", F.col("bottom") - 1)).alias("row")).select(
        *keys, "row", F.explode(F.sequence("left", F.col("right") - 1)).alias("col"))


def mask_union(masks: Iterable[DataFrame], keys: Sequence[str]) -> DataFrame:
    masks = [m.select(*keys, "row", "col") for m in masks]
    union = masks[0]
    for mask in masks[1:]:
        union = union.unionByName(mask)
    return union.distinct()


def mask_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys, "row", "col").exceptAll(right.select(*keys, "row", "col"))


def mask_digest(cells: DataFrame, keys: Sequence[str], width: Column, size: Column) -> DataFrame:
    """Set cells, the sum of their indexes and their share of the raster."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(F.col("row").cast("long") * width + F.col("col")).alias("index_sum"),
        F.max(size).alias("_size"),
    ).select(*keys, "pixels", "index_sum",
             F.when(F.col("_size") > 0, F.col("pixels") / F.col("_size")).otherwise(0.0).alias("share"))


def on_border(size: Column, width: Column) -> Column:
    """Indexes of the cells along the edge of a dense window."""
    return F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i < width) | (i >= size - width) | (i % width == 0) | (i % width == width - 1),
    )


@F.pandas_udf(ArrayType(IntegerType()))
def fill_dense(cells: pd.Series, width: pd.Series) -> pd.Series:
    """A dense window with every unset cell that cannot reach the edge set: the outside spreads inwards."""
    out = []
    for c, w in zip(cells, width):
        free = ~np.asarray(c, dtype=bool).reshape(-1, int(w))
        outside = free.copy()
        outside[1:-1, 1:-1] = False
        while True:
            wider = outside.copy()
            wider[1:] |= outside[:-1]
            wider[:-1] |= outside[1:]
            wider[:, 1:] |= outside[:, :-1]
            wider[:, :-1] |= outside[:, 1:]
            wider &= free
            if np.array_equal(wider, outside):
                break
            outside = wider
        out.append((~outside).astype(np.int32).ravel())
    return pd.Series(out)


def fill_holes(windows: DataFrame, array: str, out: str) -> DataFrame:
    """Sets every unset cell from which no walk over unset neighbours leaves the window."""
    return windows.withColumn(out, fill_dense(array, "width"))


# --- largest rectangle -----------------------------------------------------


def largest_rectangles(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest all-set rectangle per group; ties: lowest bottom row, then right edge, then greatest height.

    Each cell is the bottom of a bar reaching up to the last unset cell; the bar
    widens to the nearest unset cell, left and right, over the rows it crosses.
    All windows are one row or one column of one group.
    """
    by_row = W.partitionBy(*keys, "row").orderBy("col")
    by_col = W.partitionBy(*keys, "col").orderBy("row")
    flat = cells.select(*keys, "row", "col").distinct().withColumns({
        "_h": F.col("col") - F.row_number().over(by_row), "_v": F.col("row") - F.row_number().over(by_col),
    })
    across = W.partitionBy(*keys, "row", "_h")
    sides = flat.withColumns({"_left": F.min("col").over(across), "_right": F.max("col").over(across)})
    upward = W.partitionBy(*keys, "col", "_v").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    bars = sides.withColumns({
        "left": F.max("_left").over(upward), "right": F.min("_right").over(upward),
        "h": (F.row_number().over(W.partitionBy(*keys, "col", "_v").orderBy("row"))),
    }).withColumn("w", F.col("right") - F.col("left") + 1)
    return (
        bars.groupBy(*keys)
        .agg(F.max_by(
            F.struct(F.col("left").alias("x"), (F.col("row") - F.col("h") + 1).alias("y"), "w", "h"),
            F.struct(F.col("w") * F.col("h"), -F.col("row"), -F.col("right"), F.col("h")),
        ).alias("best"))
        .select(*keys, "best.*")
    )


# --- label targets ---------------------------------------------------------


def _cell_range(b: g.Box, inset: Column, columns: Column, rows: Column) -> Column:
    """Cells a box reaches, floor to ceiling, clipped; null when nothing is left."""
    x0, y0 = (b.x + inset) / g.STRIDE, (b.y + inset) / g.STRIDE
    x1, y1 = (b.right - inset) / g.STRIDE, (b.bottom - inset) / g.STRIDE
    a, c = F.greatest(F.lit(0), F.floor(x0)), F.least(columns, F.ceil(x1))
    t, d = F.greatest(F.lit(0), F.floor(y0)), F.least(rows, F.ceil(y1))
    real = (x1 - x0 >= 1e-3) & (y1 - y0 >= 1e-3) & (c > a) & (d > t)
    return F.when(real, F.struct(a.alias("c0"), t.alias("r0"), c.alias("c1"), d.alias("r1")))


def _layers(boxes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """What is painted, in order within each raster: keys, r0, r1, c0, c1 (ends excluded) and the state 1 + mask + 2 * target."""
    b = g.box()
    role, columns, rows = F.col("role"), F.col("columns"), F.col("rows")
    core = _cell_range(b, g.shrink_offset(b.w, b.h), columns, rows)
    ranged = boxes.withColumns({"_outer": _cell_range(b, F.lit(0.0), columns, rows), "_core": core}).where("_outer IS NOT NULL")
    has_core = F.coalesce(
        F.least(F.col("_core.c1") - F.col("_core.c0"), F.col("_core.r1") - F.col("_core.r0")) >= MIN_CORE_SIDE, F.lit(False)
    ) & (role == "text")
    layer = F.when(role == "page", 0).when(role == "background", 1).when(role == "ignore", 2).otherwise(3)
    value = F.when(role == "background", 1).when((role == "text") & has_core & ~F.col("ignore_all"), 1).otherwise(0)
    shown = (role != "page") | F.col("ignore_all")
    # By a number made of the keys: a layout by the keys themselves may be taken as given when the rows are a union of joins by them, and then change.
    dealt = spread(ranged.where(shown).select(
        *keys, F.xxhash64(*keys).alias("_deal"), F.col(order).cast("long").alias("_order"), layer.alias("layer"), value.alias("mask"), "_outer", F.when(has_core, F.col("_core")).alias("_core")), "_deal")
    painted = F.array(
        F.struct(F.col("layer"), F.col("mask"), F.lit(0).alias("target"), F.col("_outer").alias("r")),
        F.when(F.col("_core").isNotNull(), F.struct(F.lit(4).alias("layer"), F.lit(1).alias("mask"), F.lit(1).alias("target"), F.col("_core").alias("r"))),
    )
    return (
        dealt.select(*keys, "_order", F.explode(F.array_compact(painted)).alias("_p"))
        .sortWithinPartitions(*keys, "_p.layer", "_order", "_p.mask")
        .select(*keys, *(F.col(f"_p.r.{c}").cast("int").alias(f"_{c}") for c in ("r0", "r1", "c0", "c1")),
                (1 + F.col("_p.mask") + 2 * F.col("_p.target")).cast("int").alias("_state"))
    )


def painted(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rasters of ``_layers`` with their keys, some at a time: [raster, row, column], 0 where nothing was painted.

    Later layers paint over earlier ones. Of a raster whose rows go on in the
    next batch only the raster is kept, so its size bounds what is held.
    """
    keys, held = list(keys), None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        named = table.select(keys)
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for key in keys:
            code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        begins = np.flatnonzero(new)
        edges = np.append(begins, batch.num_rows)
        goes_on = held is not None and held[0].equals(named.slice(0, 1))
        if held is not None and not goes_on:
            yield held[0], held[1][None]
            held = None
        r0, r1, c0, c1, state = (batch.column(c).to_numpy() for c in ("_r0", "_r1", "_c0", "_c1", "_state"))
        high, wide = int(r1.max()), int(c1.max())
        if goes_on:
            high, wide = max(high, held[1].shape[0]), max(wide, held[1].shape[1])
        most = max(1, GRID_CELLS // (high * wide))
        for s in range(0, len(begins), most):
            e = min(s + most, len(begins))
            grid = np.zeros((e - s, high, wide), np.uint8)
            if goes_on and s == 0:
                grid[0, : held[1].shape[0], : held[1].shape[1]] = held[1]
            rows = slice(edges[s], edges[e])
            of = np.repeat(np.arange(e - s), np.diff(edges[s : e + 1]))
            for n, t, d, l, r, v in zip(of.tolist(), *(a[rows].tolist() for a in (r0, r1, c0, c1, state))):
                grid[n, t:d, l:r] = v
            done = table.select(keys).take(pa.array(begins[s:e]))
            if e == len(begins):
                held, grid = (done.slice(e - s - 1, 1), grid[-1].copy()), grid[:-1]
                done = done.slice(0, e - s - 1)
            if len(grid):
                yield done, grid
    if held is not None:
        yield held[0], held[1][None]


def _from_rasters(boxes: DataFrame, keys: Sequence[str], order: str, fields: dict, made: Callable[[np.ndarray], tuple]) -> DataFrame:
    schema = StructType([boxes.schema[k] for k in keys] + [StructField(n, kind) for n, kind in fields.items()])
    kinds = {n: pa.int32() if kind == IntegerType() else pa.int64() for n, kind in fields.items()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for named, grid in painted(batches, keys):
            rows, columns = made(grid)
            out = (named if rows is None else named.take(pa.array(rows))).combine_chunks()
            for n, values in columns.items():
                out = out.append_column(n, pa.array(values).cast(kinds[n]))
            yield from out.to_batches()

    return _layers(boxes, keys, order).mapInArrow(each, schema)


def rasterise(boxes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Target and mask of every cell a label box reaches; cells not listed are target 0, mask 1.

    Boxes carry ``role`` (page, background, ignore, text), ``ignore_all`` and the
    crop's ``columns, rows`` in cells. Layers, later ones winning: the page of an
    ignored record 0, background windows 1, ignore boxes 0, text boxes in order
    (1, or 0 when ignored everywhere or too small to keep a core), cores 1.
    Boxes are dealt by raster once and painted in that order; cells are never shuffled.
    """
    def made(grid: np.ndarray) -> tuple[np.ndarray, dict]:
        at, row, col = np.nonzero(grid)
        state = grid[at, row, col].astype(np.int32) - 1
        return at, {"row": row, "col": col, "target": state // 2, "mask": state % 2}

    return _from_rasters(boxes, keys, order, dict.fromkeys(("row", "col", "target", "mask"), IntegerType()), made)


def raster_digest(boxes: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """Of the cells that ``rasterise`` gives of each raster: how many, cores and masked ones, and the sums of their indexes in rows of ``width``."""
    def made(grid: np.ndarray) -> tuple[None, dict]:
        place = (np.arange(grid.shape[1])[:, None] * width + np.arange(grid.shape[2])).ravel()
        weights = np.stack([np.ones(len(place)), place], 1)

        def counted(cells: np.ndarray) -> np.ndarray:
            """Numbers and sums of indexes of set cells; whole numbers, far below what doubles hold exactly."""
            return (cells.reshape(len(cells), -1).astype(np.float64) @ weights).astype(np.int64).T

        core, masked = counted(grid >= 3), counted(grid % 2 == 1)
        return None, {"cells": np.count_nonzero(grid, (1, 2)), "core_cells": core[0], "masked_cells": masked[0], "core_sum": core[1], "masked_sum": masked[1]}

    return _from_rasters(boxes, keys, order, dict.fromkeys(("cells", "core_cells", "masked_cells", "core_sum", "masked_sum"), LongType()), made)


# --- tones -----------------------------------------------------------------


def dark_shares(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str], box_key: str) -> DataFrame:
    """Share of a box's pixels darker than the limit; 0 for a box without pixels."""
    at = g.half_even(F.col("x")).cast("int"), g.half_even(F.col("y")).cast("int")
    size = [F.greatest(F.lit(1), g.half_even(F.col(c)).cast("int")) for c in "wh"]
    spread_out = boxes.withColumn("row", F.explode(F.sequence(at[1], at[1] + size[1] - 1))).withColumn(
        "col", F.explode(F.sequence(at[0], at[0] + size[0] - 1))
    )
    shares = spread_out.join(pixels, [*keys, "row", "col"]).groupBy(box_key).agg(
        F.avg((F.col("luma") < DARK_LUMA).cast("double")).alias("dark_share")
    )
    return boxes.select(box_key).join(shares, box_key, "left").fillna(0.0, ["dark_share"])


def dominant_tones(pixels: DataFrame, key: str) -> DataFrame:
    """A region's two strongest tones in order of peak height: mean colour and share of the region.

    Pixels are first counted per (region, luma), so both rounds work on at most
    256 rows a region.
    """
    levels = pixels.groupBy(key, "luma").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("b").alias("b")
    )
    whole = F.sum("n").over(W.partitionBy(key))
    levels = levels.withColumns({"size": whole, "bin": F.shiftright(F.col("luma").cast("long") * TONE_BINS, 8)})

    def peak(rows: DataFrame, name: str) -> DataFrame:
        bins = rows.groupBy(key, "bin").agg(F.sum("n").alias("n"))
        top = bins.groupBy(key).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("_bin"))
        return top.select(key, ((F.col("_bin") + 0.5) * (256 / TONE_BINS)).alias(name))

    def close(name: str) -> Column:
        return F.abs(F.col("luma") - F.col(name)) <= TONE_TOLERANCE

    first = levels.join(peak(levels, "peak1"), key)
    rest = first.where(~close("peak1"))
    both = first.join(peak(rest, "peak2"), key, "left")
    tone = F.when(close("peak1"), 1).when(close("peak2"), 2)
    return (
        both.withColumn("tone", tone).where("tone IS NOT NULL")
        .groupBy(key, "tone")
        .agg(*((F.sum(c) / F.sum("n")).alias(c) for c in "rgb"), (F.sum("n") / F.max("size")).alias("share"))
    )


def fields(tones: DataFrame, key: str) -> DataFrame:
    """Two-tone coverage and the ground: the tone of larger share, the first on ties."""
    return tones.groupBy(key).agg(
        F.sum("share").alias("coverage"),
        F.max_by(F.struct("r", "g", "b"), F.struct("share", -F.col("tone"))).alias("ground"),
    ).select(key, "coverage", "ground.*")


def otsu(pixels: DataFrame, key: str) -> DataFrame:
    """Threshold that best parts a region's luma in two, the lowest on ties, and whether dark is the ink.

    Works on a histogram of at most 256 rows a region.
    """
    levels = pixels.groupBy(key, "luma").agg(F.count(F.lit(1)).alias("n"))
    below = W.partitionBy(key).orderBy("luma").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    v = F.col("luma").cast("long") * F.col("n")
    parted = levels.select(
        key, "luma", F.sum("n").over(below).alias("wb"), F.sum(v).over(below).alias("sb"),
        F.sum("n").over(whole).alias("all"), F.sum(v).over(whole).alias("sum"),
    )
    wa = F.col("all") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / F.when(wa > 0, wa)
    variance = F.when(wa > 0, F.col("wb") * wa * gap * gap)
    return (
        parted.withColumn("variance", F.coalesce(variance, F.lit(-1.0)))
        .groupBy(key)
        .agg(F.max_by(F.struct("luma", "wb", "all", "variance"), F.struct("variance", -F.col("luma"))).alias("t"))
        .select(
            key,
            F.when(F.col("t.variance") >= 0, F.col("t.luma")).otherwise(0).alias("threshold"),
            F.when(F.col("t.variance") >= 0, F.col("t.wb") / F.col("t.all") < 0.5).otherwise(F.lit(None)).alias("dark_ink"),
        )
    )


def around(regions: DataFrame, keys: Sequence[str], region_key: str, reach: int) -> DataFrame:
    """Cells up to ``reach`` steps from a region's box, with the steps as ``_off``: 0 inside."""
    wider = regions.withColumns({"x": F.col("x") - reach, "y": F.col("y") - reach, "w": F.col("w") + 2 * reach, "h": F.col("h") + 2 * reach})
    b = g.box()
    left, top = F.floor(F.greatest(F.lit(0.0), b.x)), F.floor(F.greatest(F.lit(0.0), b.y))
    off = F.greatest(left - F.col("col"), F.lit(0), F.col("col") - F.ceil(b.right) + 1) + F.greatest(
        top - F.col("row"), F.lit(0), F.col("row") - F.ceil(b.bottom) + 1
    )
    near = box_mask(wider, [*keys, region_key]).join(regions.select(*keys, region_key, *"xywh"), [*keys, region_key])
    return near.withColumn("_off", off).where(F.col("_off") <= reach).select(*keys, region_key, "row", "col", "_off")


def erase_report(masks: DataFrame, ink: DataFrame, regions: DataFrame, keys: Sequence[str], region_key: str, clearance: int = 3) -> DataFrame:
    """Per mask variant: light regions it touches, letter ink of those and how much of it is erased, other ink erased.

    Other ink is more than ``clearance`` steps from every region. Masks carry
    ``variant``, ink its component ``label``, regions a ``light`` flag.
    """
    cell = [*keys, "row", "col"]
    # Both are read several times; what made them (labels, above all) runs once.
    ink = cut_lineage(ink.select(*cell, "label"))
    erased = cut_lineage(masks.select("variant", *cell).distinct())
    light = regions.where("light")
    inside = around(light, keys, region_key, 0)
    touched = erased.join(inside, cell).select("variant", *keys, region_key).distinct()
    target = touched.join(letters(ink, light, keys, region_key), [*keys, region_key])
    hit = target.join(erased.withColumn("_hit", F.lit(1)), ["variant", *cell], "left").groupBy("variant").agg(
        F.count("*").alias("ink"), F.count("_hit").alias("hit"))
    near = around(regions, keys, region_key, clearance).select(*cell).distinct()
    other = erased.join(ink.select(*cell), cell).join(near, cell, "left_anti").groupBy("variant").agg(F.count("*").alias("other"))
    found = touched.groupBy("variant").agg(F.count("*").alias("regions"))
    every = erased.select("variant").distinct()
    return every.join(found, "variant", "left").join(hit, "variant", "left").join(other, "variant", "left").fillna(0).select(
        "variant", "regions", "ink", "hit", "other")


def letters(ink: DataFrame, regions: DataFrame, keys: Sequence[str], region_key: str, grow: int = 4) -> DataFrame:
    """Ink cells inside a region whose shape stays clear of the rim of the region grown by ``grow``.

    Ink carries its component ``label``. Growing a box cell by cell makes the
    cells within a Manhattan distance of it; the rim is one step further, so
    each region looks at the cells of its box and its rim only.
    """
    reach = grow + 1
    seen = around(regions, keys, region_key, reach).where(F.col("_off").isin(0, reach)).join(ink, [*keys, "row", "col"])
    crossing = seen.where(F.col("_off") == reach).select(*keys, region_key, "label").distinct()
    return (
        seen.where("_off = 0").join(crossing, [*keys, region_key, "label"], "left_anti")
        .select(*keys, region_key, "row", "col", "label")
    )


def field_window(width: Column, height: Column, b: g.Box, margin: int = FIELD_MARGIN) -> g.Box:
    """The window a region's field is measured on: the box and a margin, clipped to the page."""
    x = F.greatest(F.lit(0), F.floor(b.x) - margin)
    y = F.greatest(F.lit(0), F.floor(b.y) - margin)
    return g.Box(x, y, F.least(width - x, F.ceil(b.w) + 2 * margin), F.least(height - y, F.ceil(b.h) + 2 * margin))


def fields_around(
    pixels: DataFrame, regions: DataFrame, keys: Sequence[str], region_key: str, width: Column, height: Column, margin: int = FIELD_MARGIN,
) -> DataFrame:
    """Field of every region's window on its page; a window without pixels is all ground, and white.

    ``width`` and ``height`` are the page's, as columns of ``regions``. A window
    is dealt by its rows, so a join key is one row of one page's pixels.
    """
    window = field_window(width, height, g.box(), margin)
    rows = (
        regions.select(*keys, region_key, window.x.alias("_x"), window.y.alias("_y"), window.right.alias("_r"), window.bottom.alias("_b"))
        .where("_r > _x AND _b > _y")
        .withColumn("row", F.explode(F.sequence(F.col("_y").cast("int"), F.col("_b").cast("int") - 1)))
    )
    inside = pixels.join(rows, [*keys, "row"]).where("col >= _x AND col < _r").select(region_key, "luma", "r", "g", "b")
    found = fields(dominant_tones(inside, region_key), region_key)
    return regions.select(region_key).join(found, region_key, "left").fillna({"coverage": 1.0, "r": 255.0, "g": 255.0, "b": 255.0})


def luma_of(df: DataFrame) -> DataFrame:
    return df.withColumn("luma", colour.luma(F.col("r"), F.col("g"), F.col("b")))

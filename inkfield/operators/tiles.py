"""Rasters of any size as tiles: labels and holes found inside each tile and merged over the tiles' borders.

A tile is one row: its raster's keys, ``tile_row, tile_col`` and a dense square
of 0/1 cells. What is in memory at a time is a tile; only the cells along its
edges, named by their component, go to the neighbours. A raster without set
cells has no tiles; cells outside the raster are unset.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from inkfield.operators import raster as rs
from inkfield.session import cut_lineage

SIDE = 256


@F.pandas_udf(ArrayType(IntegerType()))
def _dense(places: pd.Series, side: pd.Series) -> pd.Series:
    out = []
    for at, n in zip(places, side):
        cells = np.zeros(int(n) * int(n), np.int32)
        if at is not None:
            cells[np.asarray(at, np.int64)] = 1
        out.append(cells)
    return pd.Series(out)


def place(row: Column, col: Column) -> Column:
    """A cell of a raster as one number, in row order."""
    return F.shiftleft(row.cast("long"), rs.NODE_SHIFT) + col


def cut_tiles(cells: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """A table of set cells as tiles that hold at least one."""
    here = [F.floor(F.col(c) / side).alias(f"tile_{c}") for c in ("row", "col")]
    inside = (F.pmod(F.col("row"), F.lit(side)) * side + F.pmod(F.col("col"), F.lit(side))).cast("int")
    # At most side * side different numbers a tile.
    return cells.select(*keys, *here, inside.alias("at")).groupBy(*keys, "tile_row", "tile_col").agg(F.collect_set("at").alias("at")).select(
        *keys, "tile_row", "tile_col", _dense("at", F.lit(side)).alias("cells"))


def every_tile(rasters: DataFrame, tiles: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """All tiles of rasters of ``rows`` by ``columns``, those without a set cell too."""
    grid = rasters.select(*keys, "rows", "columns", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / side))).alias("tile_row")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("columns") - 1) / side))).alias("tile_col"))
    joined = grid.join(tiles, [*keys, "tile_row", "tile_col"], "left")
    return joined.withColumn("cells", F.coalesce("cells", F.array_repeat(F.lit(0), side * side)))


def _node(index: Column, side: int) -> Column:
    """The raster's number of a tile's cell; -1 stays out."""
    row, col = F.floor(index / side) + F.col("tile_row") * side, index % side + F.col("tile_col") * side
    return F.when(index >= 0, place(row, col))


def _edges(tiles: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Cells along tiles' edges with their component: ``line`` is the border between two tiles that they lie on, ``first`` its near side."""
    lit = F.lit
    along = F.sequence(lit(0), lit(side - 1))

    def one(index, down: bool, first: bool):
        def cell(i):
            at = index(i)
            border = F.col("tile_row" if down else "tile_col") + (1 if first else 0)
            other = F.col("tile_col" if down else "tile_row") * side + i
            return F.struct(
                lit(down).alias("down"), border.alias("line"), other.alias("along"), lit(first).alias("first"), F.get("_label", at.cast("int")).alias("label"))
        return F.transform(along, cell)

    cells = F.concat(
        one(lambda i: i, True, False), one(lambda i: i + side * (side - 1), True, True),
        one(lambda i: i * side, False, False), one(lambda i: i * side + side - 1, False, True),
    )
    each = tiles.select(*keys, "tile_row", "tile_col", F.explode(F.filter(cells, lambda c: c["label"] >= 0)).alias("e"))
    return each.select(*keys, "e.down", "e.line", "e.along", "e.first", _node(F.col("e.label"), side).alias("node"))


def label_tiles(tiles: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """Tiles with ``labels``: of each cell the number (see ``place``) of the first cell of its 4-connected component, null where unset."""
    own = cut_lineage(tiles.withColumn("_label", rs.label_dense("cells", F.lit(side))))
    edges = _edges(own, keys, side)
    border = ["down", "line", "along"]
    links = (
        edges.where("first").select(*keys, *border, F.col("node").alias("_u"))
        .join(edges.where("NOT first").select(*keys, *border, F.col("node").alias("_v")), [*keys, *border])
        .select(*keys, "_u", "_v").distinct()
    )
    names = rs._star_labels(links, keys)
    # A component that crosses no border keeps the name it has in its tile; of the others' names a tile gets its own.
    inside = F.floor(F.shiftright("_node", rs.NODE_SHIFT) / side).alias("tile_row"), F.floor(
        F.col("_node").bitwiseAND(F.lit((1 << rs.NODE_SHIFT) - 1)) / side).alias("tile_col")
    told = names.select(*keys, *inside, "_node", "label").groupBy(*keys, "tile_row", "tile_col").agg(
        F.map_from_entries(F.collect_list(F.struct("_node", "label"))).alias("_names"))
    named = F.transform("_label", lambda i: _node(i, side))
    return own.withColumn("_named", named).join(told, [*keys, "tile_row", "tile_col"], "left").withColumn(
        "labels", F.when(F.col("_names").isNull(), F.col("_named")).otherwise(
            F.transform("_named", lambda n: F.when(n.isNotNull(), F.coalesce(F.try_element_at("_names", n), n))))
    ).drop("_label", "_named", "_names")


def tile_cells(tiles: DataFrame, keys: Sequence[str], side: int = SIDE, labels: str = "labels") -> DataFrame:
    """Labelled cells: row, col and the row and column of their component's first cell."""
    each = tiles.select(*keys, "tile_row", "tile_col", F.posexplode(labels).alias("_at", "_l")).where("_l IS NOT NULL")
    return each.select(
        *keys, (F.col("tile_row") * side + F.floor(F.col("_at") / side)).cast("int").alias("row"), (F.col("tile_col") * side + F.col("_at") % side).cast("int").alias("col"),
        F.shiftright("_l", rs.NODE_SHIFT).cast("int").alias("label_row"), F.col("_l").bitwiseAND(F.lit((1 << rs.NODE_SHIFT) - 1)).cast("int").alias("label_col"),
    )


def components(cells: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """What ``raster.connected_components`` gives, by tiles."""
    return tile_cells(label_tiles(cut_tiles(cells, keys, side), keys, side), keys, side)


def fill_holes(cells: DataFrame, rasters: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """Set cells and every unset one from which no walk over unset neighbours leaves the raster of ``rows`` by ``columns``."""
    whole = every_tile(rasters, cut_tiles(cells, keys, side), keys, side)
    free = label_tiles(whole.withColumn("cells", F.transform("cells", lambda c: 1 - c)), keys, side)
    free = cut_lineage(free)
    each = tile_cells(free, keys, side).join(rasters.select(*keys, "rows", "columns"), list(keys))
    at_edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") >= F.col("rows") - 1) | (F.col("col") >= F.col("columns") - 1)
    outside = each.where(at_edge).select(*keys, "label_row", "label_col").distinct()
    holes = each.join(outside, [*keys, "label_row", "label_col"], "left_anti").select(*keys, "row", "col")
    return cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct().unionByName(holes)

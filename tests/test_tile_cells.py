"""Tiles of a usual document are sent about once."""

import inspect

from pyspark.sql import functions as F

from inkfield.functions import geometry as g
from inkfield.operators import spatial as sp


def test_a_tile_is_sent_about_once(spark):
    tiles = spark.range(98).select(
        (F.col("id") / 14).cast("long").alias("doc_id"), (400.0 * (F.col("id") % 2)).alias("x"), (150.0 * F.floor(F.col("id") % 14 / 2)).alias("y"), F.lit(321.0).alias("w"), F.lit(150.0).alias("h"))
    for of in (sp.tiles_touched, sp.owner_of):
        assert sp._to_cells(tiles, g.box(), inspect.signature(of).parameters["cell"].default).count() <= 1.1 * 98

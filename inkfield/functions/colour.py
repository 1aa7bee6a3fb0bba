"""Pixel tones as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values the results depend on.
INK_CROSSOVER = 0.1791    # relative luminance where black and white ink read equally well
PLATE_ALPHA = 0.82
PLATE_MIN_CONTRAST = 4.5


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma truncated to a byte."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    def channel(value: Column) -> Column:
        c = value / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)

"""Box arithmetic as column expressions. A box is x, y, width, height in page pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Fixed values the results depend on.
GRID_CAP = 512          # most sample columns or rows a region is measured on
SHRINK_RATIO = 0.4      # how far training labels were shrunk
STRIDE = 4              # page pixels per map cell
INPUT_SIZE = 1280       # side of the square a page is letterboxed to
UNCLIP_RATIO = 1.5      # growth of a text-line component
UNSHRINK_STEPS = 30     # fixed-point steps that undo the label shrink


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def box(prefix: str = "") -> Box:
    """The box held in columns ``<prefix>x, <prefix>y, <prefix>w, <prefix>h``."""
    return Box(*(F.col(prefix + side) for side in "xywh"))


def intersection(a: Box, b: Box) -> Column:
    across = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    down = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    union = a.area + b.area - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def containment(a: Box, b: Box) -> Column:
    """Common area over the area of whichever box is less; 0 where that one has none."""
    smaller = F.least(a.area, b.area)
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def encloses(outer: Box, inner: Box) -> Column:
    """Share of ``inner`` inside ``outer``; 0 when ``inner`` has no area."""
    return F.when(inner.area > 0, intersection(outer, inner) / inner.area).otherwise(0.0)


def half_up(value: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(value + 0.5)


def half_even(value: Column) -> Column:
    return F.bround(value, 0)


def sample_count(side: Column) -> Column:
    """Sample columns (or rows) across a side: its rounded length, at least 1, capped."""
    return F.greatest(F.lit(1), F.least(half_even(side).cast("int"), F.lit(GRID_CAP)))


def sample_range(start: Column, side: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """First and last sample index whose centre lies in [lo, hi], edges included.

    Centres are ``start + (i + 0.5) * side / n``. The index is estimated by
    division and then moved by at most one, comparing the very same centre
    expression the definition uses, so rounding cannot shift an edge.
    """
    n = sample_count(side)

    def centre(i: Column) -> Column:
        return start + (i + 0.5) * side / n

    guess_lo = F.ceil((lo - start) * n / side - 0.5)
    guess_hi = F.floor((hi - start) * n / side - 0.5)
    first = (
        F.when(centre(guess_lo - 1) >= lo, guess_lo - 1)
        .when(centre(guess_lo) >= lo, guess_lo)
        .otherwise(guess_lo + 1)
    )
    last = (
        F.when(centre(guess_hi + 1) <= hi, guess_hi + 1)
        .when(centre(guess_hi) <= hi, guess_hi)
        .otherwise(guess_hi - 1)
    )
    return (
        F.greatest(F.lit(0), first).cast("int"),
        F.least(n - 1, last).cast("int"),
    )


MASK_WORDS = GRID_CAP // 64


def row_masks(first: Column, last: Column) -> list[Column]:
    """Rows first..last as bits of ``MASK_WORDS`` longs, 64 rows a word."""
    words = []
    for word in range(MASK_WORDS):
        lo = F.greatest(first - 64 * word, F.lit(0))
        hi = F.least(last - 64 * word, F.lit(63))
        bits = F.call_function("shiftleft", F.lit(-1).cast("long"), lo).bitwiseAND(
            F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - hi)
        )
        words.append(F.when(lo <= hi, bits).otherwise(F.lit(0).cast("long")))
    return words


def shrink_offset(w: Column, h: Column, ratio: float = SHRINK_RATIO) -> Column:
    """How far every side of a training label moves in."""
    return (w * h) * (1 - ratio**2) / F.greatest(F.lit(1e-6), 2 * (w + h))


def unshrink_offset(w: Column, h: Column, ratio: float = SHRINK_RATIO) -> Column:
    """The shrink that leaves a w x h core, by fixed-point steps from 0."""
    k = 1 - ratio**2
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(UNSHRINK_STEPS)),
        F.lit(0.0),
        lambda d, _: (w + 2 * d) * (h + 2 * d) * k / (2 * (w + h + 4 * d)),
    )


def unclip_offset(w: Column, h: Column) -> Column:
    """Growth of a text-line component, closed form on its rectangle."""
    return w * h * UNCLIP_RATIO / (2 * (w + h))


def letterbox(width: Column, height: Column, side: int = INPUT_SIZE) -> tuple[Column, Column, Column]:
    """Scale and left/top padding that fit a page into a square."""
    scale = F.least(side / width, side / height)
    pad_x = F.floor((side - half_up(width * scale)) / 2)
    pad_y = F.floor((side - half_up(height * scale)) / 2)
    return scale, pad_x, pad_y


def undo_letterbox(value: Column, pad: Column, scale: Column) -> Column:
    return (value - pad) / scale


def snap_side(side: Column, long_side: Column, limit: int = 960, step: int = 32) -> Column:
    """Line-finder input side: long side at most ``limit``, sides a multiple of ``step``."""
    scale = F.least(F.lit(1.0), limit / long_side)
    return F.greatest(F.lit(step), (half_even(side * scale / step) * step).cast("int"))


def padded_width(width: Column, height: Column, row: int = 48, step: int = 8, least: int = 160) -> Column:
    """Line-reader input width for a line of this shape."""
    aspect = width / F.greatest(F.lit(1), height)
    return F.greatest(F.lit(least), (F.ceil(row * aspect / step) * step).cast("int"))


def is_tall(w: Column, h: Column, aspect: float = 1.5) -> Column:
    return h > aspect * w


def column_characters(w: Column, h: Column) -> Column:
    """Estimated characters in a vertical column of square glyphs."""
    return h / F.greatest(F.lit(1.0), w)

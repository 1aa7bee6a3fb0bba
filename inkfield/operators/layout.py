"""Text layout: packing words into lines, the size that fits, splitting over lobes, labels, render plan.

A text is one row. Its words are folded inside the row, so layout needs no
shuffle at all. Widths come from a table of glyph widths in thousandths of the
font size, summed exactly as integers. Lines, sizes and cuts are looked up in
running sums of a slice's words, a step for each line and not for each word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkfield.functions.text import BLANK, trimmed

# Fixed values the results depend on.
MIN_SIZE, MAX_SIZE = 10, 28
LINE_HEIGHT = 1.15
MAX_WIDENING = 2.5
SENTENCE_END, CLAUSE_END = r"""[.!?…」』"'。！？]$""", r"[,;:)]$"
SENTENCE_REACH, CLAUSE_REACH = 0.15, 0.25
LABEL_MAX_SIZE, LABEL_MIN_WIDTH, LABEL_MAX_WIDTH, LABEL_LINES, LABEL_GAP = 16, 80, 260, 3, 4

# Stand-in glyph widths, in thousandths of the font size; other glyphs are 550.
DEFAULT_WIDTH = 550
GLYPH_WIDTHS = {"iljI.,;:!'|": 280, "mwMW": 830, " ": 280}


def measure(text: Column, widths: Mapping[str, int] = GLYPH_WIDTHS, default: int = DEFAULT_WIDTH) -> Column:
    """Width of a text in thousandths of the font size."""
    total = F.length(text) * default
    for glyphs, width in widths.items():
        held = F.length(text) - F.length(F.translate(text, glyphs, ""))
        total = total + held * (width - default)
    return total.cast("long")


SPACE = GLYPH_WIDTHS[" "]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{BLANK}+"), "")


#: Width of a character by the first byte of its UTF-8 form; further bytes have none.
BYTE_WIDTHS = np.array([0 if 0x80 <= b < 0xC0 else next((m for glyphs, m in GLYPH_WIDTHS.items() if chr(b) in glyphs), DEFAULT_WIDTH) for b in range(256)], np.int64)


def widths(texts: pa.Array) -> np.ndarray:
    """``measure`` of each text of an Arrow column."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.diff(np.append(0, np.cumsum(BYTE_WIDTHS[data]))[offsets - offsets[0]])


TEXTS = T.ArrayType(T.StringType())
LINES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("m", T.LongType())]))
SIZED = T.StructType([T.StructField("size", T.DoubleType()), T.StructField("lines", TEXTS), T.StructField("wide", T.DoubleType()), T.StructField("widest", T.LongType())])
FIT = T.StructType([
    T.StructField("size", T.DoubleType()), T.StructField("lines", TEXTS), *(T.StructField(c, T.DoubleType()) for c in "xywh"), T.StructField("overflowed", T.BooleanType())])


class Cut:
    """Words of a slice of rows, of which each row's are a range, with running sums of their widths."""

    def __init__(self, words: pa.Array):
        held = words.values
        self.bounds, self.valid = words.offsets.to_numpy().tolist(), words.is_valid().to_pylist()
        self.words, self.texts, self.m = held, None, widths(held)
        self.sums = np.append(0, np.cumsum(self.m + SPACE)).tolist()

    def __iter__(self) -> Iterator[tuple[int, int] | None]:
        """Of each row, where its words begin and end."""
        for valid, a, b in zip(self.valid, self.bounds, self.bounds[1:]):
            yield (a, b) if valid else None

    def width(self, a: int, b: int) -> int:
        """Of the words from a to b in one line."""
        return self.sums[b] - self.sums[a] - SPACE

    def wrap(self, a: int, b: int, max_width: float, size: float, most: float = float("inf")) -> list[int] | None:
        """Where the greedy lines of at most ``max_width`` pixels begin, and the end; none if more than ``most``. An overlong word stands alone."""
        room = int(max_width * 1000 / size)
        while (room + 1) * size / 1000 <= max_width:
            room += 1
        while room * size / 1000 > max_width:
            room -= 1
        lines = [a]
        while a < b:
            if len(lines) > most:
                return None
            a = max(a + 1, bisect_right(self.sums, self.sums[a] + room + SPACE, a + 1, b + 1) - 1)
            lines.append(a)
        return lines

    def widest(self, lines: list[int]) -> int:
        return max((self.width(a, b) for a, b in zip(lines, lines[1:])), default=0)

    def shown(self, lines: list[int]) -> list[str]:
        if self.texts is None:
            self.texts = self.words.to_pylist()
        return [" ".join(self.texts[a:b]) for a, b in zip(lines, lines[1:])]

    def fit(self, a: int, b: int, w: float | None, h: float | None) -> tuple[float, list[int], float | None]:
        """Size, lines, and the width that the least size is given where none fits."""
        if a == b:
            return float(MIN_SIZE), [a], None
        longest = int(self.m[a:b].max())
        size = min(float(MAX_SIZE), max(float(MIN_SIZE), MIN_SIZE if h is None else h))
        while w is not None and h is not None and size >= MIN_SIZE:
            if longest * size / 1000 <= w:
                lines = self.wrap(a, b, w, size, h / (size * LINE_HEIGHT) + 1)
                if lines is not None and (len(lines) - 1) * size * LINE_HEIGHT <= h:
                    return size, lines, None
            size -= 1
        needed = longest * float(MIN_SIZE) / 1000
        wide = needed if w is None else min(max(w, needed), w * MAX_WIDENING)
        return float(MIN_SIZE), self.wrap(a, b, wide, float(MIN_SIZE)), wide

    def split(self, a: int, b: int, weights: list[float], lengths: np.ndarray, kinds: np.ndarray) -> list[int]:
        """Where the parts by weight begin, and the end."""
        if a == b:
            return [a]
        if len(weights) <= 1 or b == a + 1:
            return [a, b]
        ends = np.cumsum(lengths[a:b] + 1) - 1
        total, share, cuts = int(ends[-1]), 0.0, [a]
        weight = float(sum(weights))
        for part in weights[:-1]:
            share += part / weight
            at = cuts[-1] - a
            if at > b - a - 2:
                continue
            off = np.abs(ends[at:-1] - share * total)
            kind = kinds[a + at : b - 1]
            rank = np.where((kind == 0) & (off <= SENTENCE_REACH * total), 0, np.where((kind == 1) & (off <= CLAUSE_REACH * total), 1, 2))
            best = np.flatnonzero(rank == rank.min())
            cuts.append(a + at + int(best[off[best].argmin()]) + 1)
        return [*cuts, b]


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each word, and 0 for an end of a sentence, 1 for one of a clause, 2 for another."""
    sentence, clause = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in (SENTENCE_END, CLAUSE_END))
    return pc.utf8_length(words).to_numpy().astype(np.int64), np.where(sentence, 0, np.where(clause, 1, 2))


@F.arrow_udf(LINES)
def _wrapped(words: pa.Array, max_width: pa.Array, size: pa.Array) -> pa.Array:
    cut, out = Cut(words), []
    for own, w, s in zip(cut, max_width.to_pylist(), size.to_pylist()):
        lines = None if own is None else cut.wrap(*own, w, s)
        out.append(None if own is None else [{"text": t, "m": cut.width(a, b)} for t, a, b in zip(cut.shown(lines), lines, lines[1:])])
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("m", pa.int64())])))


@F.arrow_udf(SIZED)
def _fitted(words: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
    cut, out = Cut(words), []
    for own, width, height in zip(cut, w.to_pylist(), h.to_pylist()):
        size, lines, wide = (float(MIN_SIZE), None, width) if own is None else cut.fit(*own, width, height)
        out.append((size, None if lines is None else cut.shown(lines), wide, None))
    return _sized(out)


@F.arrow_udf(SIZED)
def _noted(words: pa.Array, width: pa.Array) -> pa.Array:
    """The largest size of a note that fits its lines, else the least one."""
    cut, out = Cut(words), []
    for own, room in zip(cut, width.to_pylist()):
        lines, size = None, float(MIN_SIZE)
        if own is not None:
            for s in range(LABEL_MAX_SIZE, MIN_SIZE - 1, -1):
                size, most = float(s), LABEL_LINES if s > MIN_SIZE else float("inf")
                lines = cut.wrap(*own, room, size, most)
                if lines is not None and len(lines) - 1 <= LABEL_LINES and cut.widest(lines) * size / 1000 <= room:
                    break
        out.append((size, None if lines is None else cut.shown(lines), None, None if lines is None else cut.widest(lines)))
    return _sized(out)


def _sized(rows: list[tuple]) -> pa.Array:
    kinds = {"size": pa.float64(), "lines": pa.list_(pa.string()), "wide": pa.float64(), "widest": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds.values())], list(kinds))


@F.arrow_udf(TEXTS)
def _split(words: pa.Array, weights: pa.Array) -> pa.Array:
    cut, (lengths, kinds) = Cut(words), _ends(words.values)
    return pa.array([
        None if own is None or shares is None else cut.shown(cut.split(*own, shares, lengths, kinds)) for own, shares in zip(cut, weights.to_pylist())
    ], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(FIT))
def _fitted_parts(words: pa.Array, boxes: pa.Array) -> pa.Array:
    """Words cut by the boxes' areas, each part fitted to its box."""
    cut, (lengths, kinds), out = Cut(words), _ends(words.values), []
    for own, given in zip(cut, boxes.to_pylist()):
        if own is None or given is None:
            out.append(None)
            continue
        parts, fits = cut.split(*own, [b["w"] * b["h"] for b in given], lengths, kinds), []
        for a, b, box in zip(parts, parts[1:], given):
            x, y, w, h = (box[c] for c in "xywh")
            size, lines, wide = cut.fit(a, b, w, h)
            if wide is not None:
                high = (len(lines) - 1) * size * LINE_HEIGHT
                x, y, w, h = x + (w - wide) / 2, y + (h - high) / 2, wide, high
            fits.append({"size": size, "lines": cut.shown(lines), "x": x, "y": y, "w": w, "h": h, "overflowed": wide is not None})
        out.append(fits)
    kinds_of = [("size", pa.float64()), ("lines", pa.list_(pa.string())), *((c, pa.float64()) for c in "xywh"), ("overflowed", pa.bool_())]
    return pa.array(out, pa.list_(pa.struct(kinds_of)))


def wrap(words: Column, max_width: Column, size: Column) -> Column:
    """Greedy lines of at most ``max_width`` pixels as (text, width); an overlong word stands alone."""
    return _wrapped(words, max_width.cast("double"), size.cast("double"))


def pack_text(documents: DataFrame, key: str, text: str, max_width: float, size: float) -> DataFrame:
    """Documents cut into lines of a width, one row each."""
    lines = wrap(words_of(F.col(text)), F.lit(float(max_width)), F.lit(float(size)))
    return documents.select(key, F.posexplode(lines).alias("line", "_l")).select(key, "line", "_l.text", "_l.m")


def _block_height(lines: Column, size: Column) -> Column:
    return F.size(lines) * size * LINE_HEIGHT


def fit_text(words: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Largest size at which the words fit a box; else the smallest size, widened, centred, flagged.

    Sizes are tried from large to small, and the first that fits is taken.
    """
    x, y, w, h = (c.cast("double") for c in (x, y, w, h))
    f = _fitted(words, w, h)
    size, lines, wide = f["size"], f["lines"], f["wide"]
    high, over = _block_height(lines, size), wide.isNotNull()
    return F.struct(
        size.alias("size"), lines.alias("lines"), F.when(over, x + (w - wide) / 2).otherwise(x).alias("x"),
        F.when(over, y + (h - high) / 2).otherwise(y).alias("y"), F.when(over, wide).otherwise(w).alias("w"),
        F.when(over, high).otherwise(h).alias("h"), over.alias("overflowed"),
    ).cast(FIT)


def split_by_weight(words: Column, weights: Column) -> Column:
    """Words cut into parts by weight, never inside a word.

    Each cut takes the word end nearest its share of the text, preferring a
    sentence end within reach, then a clause end; cuts increase.
    """
    return _split(words, weights)


def lay_in_balloon(texts: DataFrame, text: str, boxes: str) -> DataFrame:
    """Blocks of a text over its lobes: split only if no part gets smaller or newly overflows.

    ``boxes`` is the region's lobes in reading order, two at most per closed part.
    """

    first = F.element_at(boxes, 1)
    laid = (
        texts.withColumn("_words", words_of(F.col(text)))
        .withColumn("_single", fit_text(F.col("_words"), *(first[c] for c in "xywh")))
        .withColumn("_split", _fitted_parts(F.col("_words"), F.col(boxes)))
    )
    smallest = F.array_min(F.transform("_split", lambda b: b["size"]))
    overflows = F.exists("_split", lambda b: b["overflowed"]) & ~F.col("_single.overflowed")
    use = (F.size(boxes) > 1) & (F.size("_split") > 1) & (smallest >= F.col("_single.size")) & ~overflows
    return laid.withColumn("blocks", F.when(use, F.col("_split")).otherwise(F.array("_single"))).drop(
        "_words", "_single", "_split"
    )


def fit_label(words: Column, x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, gap: float = LABEL_GAP) -> Column:
    """Size, lines and place of a note beside a region: under it where the page has room, over it otherwise, and as a last resort across its bottom."""
    width = F.least(F.lit(float(LABEL_MAX_WIDTH)), F.greatest(F.lit(float(LABEL_MIN_WIDTH)), w * 1.2))
    s = _noted(words, width)
    size, lines, own = s["size"], s["lines"], s["widest"] * s["size"] / 1000
    block, height = F.least(width, own), _block_height(lines, size)
    left = F.least(F.greatest(F.lit(0.0), x + (w - block) / 2), F.greatest(F.lit(0.0), page_w - block))
    below, above = y + h + gap, y - gap - height
    top = F.when(below + height + gap <= page_h, below).when(above - gap >= 0, above).otherwise(
        F.greatest(F.lit(0.0), y + h - height))
    return F.struct(
        size.alias("size"), lines.alias("lines"), left.alias("x"), top.alias("y"), block.alias("w"),
        height.alias("h"), (own > width).alias("overflowed"),
    )


def render_plan(regions: DataFrame, plates: bool = True, plate_coverage: float = 0.73) -> DataFrame:
    """One row per region: its blocks, overflow, plate and label flags.

    Regions carry their box, ``text``, ``lobes`` (array of boxes, may be empty),
    ``label`` flag, field ``coverage`` and ``ground``, and page size.
    """
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    words = words_of(trimmed(F.col("text")))
    in_balloon = ~F.col("label") & (F.size("lobes") > 0)
    labels = regions.where("label").withColumn(
        "blocks", F.array(fit_label(words, x, y, w, h, F.col("page_width"), F.col("page_height"))))
    lobed = lay_in_balloon(regions.where(in_balloon), "text", "lobes")
    plain = regions.where(~F.col("label") & ~in_balloon).withColumn("blocks", F.array(fit_text(words, x, y, w, h)))
    measured = ~in_balloon & (F.lit(plates) | F.col("label"))
    return labels.unionByName(lobed).unionByName(plain).withColumns({
        "first": F.element_at("blocks", 1),
        "overflowed": F.exists("blocks", lambda b: b["overflowed"]),
        "tone_coverage": F.when(measured, F.col("coverage")).otherwise(1.0),
        "plate_tone": F.when(measured, F.col("ground")),
        "plated": F.col("label") | (measured & (F.col("coverage") < plate_coverage)),
    })

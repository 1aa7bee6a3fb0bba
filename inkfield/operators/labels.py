"""Label sets for a text detector: leak guard, records, split, crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkfield.functions import geometry as g
from inkfield.functions.text import BLANK
from inkfield.operators.decide import global_rank

# Fixed values the results depend on.
LONG_SIDE = 1536
FAILURE_BUDGET = 0.02
SCALE_RANGE = (0.6, 1.25)
ANCHOR_WORDS = 8


class LeakError(RuntimeError):
    """Held-out ids found in the training input."""


class MissingKeyError(RuntimeError):
    """A required lookup found no match."""


def leaked(train: DataFrame, held_out: DataFrame, key: str = "page_id") -> DataFrame:
    """Training ids that are held out."""
    return train.select(key).distinct().join(held_out.select(key), key, "left_semi")


def drop_leaked(train: DataFrame, held_out: DataFrame, key: str = "page_id") -> DataFrame:
    return train.join(held_out.select(key), key, "left_anti")


def assert_no_leak(train: DataFrame, held_out: DataFrame, key: str = "page_id", shown: int = 100) -> None:
    """Fails naming the first leaked ids in order; the error's ``found`` is the table of all of them."""
    found = leaked(train, held_out, key)
    total = found.count()
    if total:
        first = [row[0] for row in found.orderBy(key).limit(shown).collect()]
        error = LeakError(f"{total} held-out ids in the training input, first: {first}")
        error.found = found
        raise error


def shared_ids(left: DataFrame, right: DataFrame, key: str = "page_id") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def require_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left row must find its key; the error's ``found`` is the table of keys that don't."""
    missing = left.join(right.select(key), key, "left_anti").select(key)
    first = missing.limit(5).collect()
    if first:
        error = MissingKeyError(f"no match for {[row[0] for row in first]} and possibly more")
        error.found = missing
        raise error
    return left.join(right, key)


def _words(text: str) -> Column:
    return F.filter(F.split(F.col(text), f"{BLANK}+"), lambda w: w != "")


def passage_matches(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents that hold a passage word for word, white space aside.

    A passage is found by its first words: the same run of words is looked up
    at every word of every document, and only hits compare the whole passage.
    """
    n = ANCHOR_WORDS
    wanted = passages.withColumn("_p", _words("text")).where(F.size("_p") > 0).select(
        "item_id", "_p", F.least(F.size("_p"), F.lit(n)).alias("_n"),
        F.xxhash64(F.concat_ws(" ", F.slice("_p", 1, n))).alias("_anchor"),
    )
    # At most ANCHOR_WORDS different lengths.
    lengths = sorted(row[0] for row in wanted.select("_n").distinct().collect())
    if not lengths:
        return documents.join(passages, F.lit(False)).select("doc_id", "item_id")
    worded = documents.withColumn("_d", _words("text")).where(F.size("_d") > 0).select("doc_id", "_d")
    starts = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("_d")),
        lambda i: F.array(*(
            F.struct(i.alias("at"), F.lit(k).alias("_n"), F.xxhash64(F.concat_ws(" ", F.slice("_d", i, k))).alias("_anchor"))
            for k in lengths
        )),
    )))
    # Only the hash travels through the join; the words are fetched for the hits.
    hits = (
        worded.select("doc_id", starts.alias("s")).select("doc_id", "s.*")
        .join(wanted.select("item_id", "_n", "_anchor"), ["_n", "_anchor"])
        .select("doc_id", "item_id", "at")
    )
    return (
        hits.join(worded, "doc_id").join(wanted.select("item_id", "_p"), "item_id")
        .where(F.slice("_d", F.col("at"), F.size("_p")) == F.col("_p"))
        .select("doc_id", "item_id").distinct()
    )


def jobs(pages: DataFrame, negatives: DataFrame) -> DataFrame:
    """Tagged union of training pages and hard negatives."""
    return pages.withColumn("kind", F.lit("page")).unionByName(
        negatives.withColumn("kind", F.lit("negative")), allowMissingColumns=True
    )


def stored_size(pages: DataFrame, long_side: int = LONG_SIDE) -> DataFrame:
    """Scale and stored size of a page shrunk to a longest side; never enlarged."""
    w, h = F.col("width"), F.col("height")
    scale = F.least(F.lit(1.0), long_side / F.greatest(w, h))

    def shrunk(side: Column) -> Column:
        return F.greatest(F.lit(1), g.half_even(side * scale).cast("int"))

    return pages.withColumns({"stored_width": shrunk(w), "stored_height": shrunk(h)}).withColumn(
        "scale", F.col("stored_width") / w
    )


def rescale(boxes: DataFrame, scale: Column) -> DataFrame:
    """Boxes to stored pixels, to a tenth."""
    return boxes.withColumns({side: F.round(F.col(side) * scale + 1e-9, 1) for side in "xywh"})


def label_boxes(pages: DataFrame, text: DataFrame, ignore: DataFrame, windows: DataFrame,
                long_side: int = LONG_SIDE) -> DataFrame:
    """Every label box of every page, one row each, in stored pixels.

    Pages carry text and ignore boxes; negatives carry only their confirmed
    text-free windows and are ignored everywhere else.
    """
    sized = stored_size(pages, long_side).select("page_id", "kind", "reviewed", "stored_width", "stored_height", "scale")
    of_pages = text.select("page_id", *"xywh", F.lit("text").alias("role")).unionByName(
        ignore.select("page_id", *"xywh", F.lit("ignore").alias("role"))
    ).withColumn("kind", F.lit("page"))
    of_negatives = windows.select(
        "page_id", *"xywh", F.lit("background").alias("role"), F.lit("negative").alias("kind")
    )
    boxes = of_pages.unionByName(of_negatives)
    return rescale(sized.join(boxes, ["page_id", "kind"]), F.col("scale")).drop("scale")


def label_pages(pages: DataFrame, boxes: DataFrame, long_side: int = LONG_SIDE) -> DataFrame:
    """One record per page with its box counts; a page without boxes counts zero."""
    counts = boxes.groupBy("page_id").agg(
        *(F.count_if(F.col("role") == role).alias(f"{role}_boxes") for role in ("text", "ignore", "background"))
    )
    negative = F.col("kind") == "negative"
    return (
        stored_size(pages, long_side)
        .join(counts, "page_id", "left")
        .fillna(0, ["text_boxes", "ignore_boxes", "background_boxes"])
        .select(
            "page_id", "kind", F.concat(F.lit("pages/"), "page_id", F.lit(".jpg")).alias("file"),
            F.col("stored_width").alias("width"), F.col("stored_height").alias("height"),
            (negative | F.col("reviewed")).alias("reviewed"), negative.alias("ignore_all"),
            "text_boxes", "ignore_boxes", "background_boxes",
        )
    )


def build_summary(records: DataFrame, failed: DataFrame) -> DataFrame:
    """Counts of a build and whether its failures stay inside the budget: one row."""
    page = F.col("kind") == "page"
    totals = records.agg(
        F.count_if(page).alias("pages"), F.count_if(page & F.col("reviewed")).alias("reviewed"),
        F.count_if(~page).alias("negatives"),
        F.coalesce(F.sum(F.when(page, F.col("text_boxes"))), F.lit(0)).alias("text_regions"),
        F.coalesce(F.sum(F.when(page, F.col("ignore_boxes"))), F.lit(0)).alias("ignore_regions"),
        F.lit(0).cast("long").alias("failed"),
    )
    lost = failed.agg(
        *(F.lit(0).cast("long").alias(c) for c in ("pages", "reviewed", "negatives", "text_regions", "ignore_regions")),
        F.count(F.lit(1)).alias("failed"),
    )
    both = totals.unionByName(lost).agg(*(F.sum(c).alias(c) for c in totals.columns))
    every = F.col("pages") + F.col("negatives") + F.col("failed")
    return both.withColumn("within_budget", F.col("failed") <= FAILURE_BUDGET * every)


def uniform(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from its parts: the same in every run and engine."""
    digest = F.md5(F.concat_ws("-", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def split(records: DataFrame, count: int, seed: int) -> DataFrame:
    """``val`` or ``train`` per record: a seeded choice of reviewed pages, the rest for training."""
    chosen = (
        records.where((F.col("kind") == "page") & F.col("reviewed"))
        .withColumn("_draw", F.conv(F.substring(F.md5(F.concat_ws("-", "page_id", F.lit(seed))), 1, 15), 16, 10).cast("long"))
    )
    chosen = (
        global_rank(chosen, "_draw", "_rank").where(F.col("_rank") <= count)
        .select("page_id", F.lit("val").alias("part"))
    )
    return records.join(chosen, "page_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def crop_plan(
    records: DataFrame, boxes: DataFrame, epoch: int, seed: int, crop: int = 768, train: bool = True, input_size: int = g.INPUT_SIZE,
) -> DataFrame:
    """Where each record is cropped in an epoch: origin, scale and the part the page covers.

    Training crops centre on a random text box half the time, with jitter, else
    start anywhere; validation crops are squares of ``input_size``, the page centred
    in them. The random box is the one of smallest keyed digest, so choosing it is
    an aggregate, not a list.
    """
    lit = F.lit

    def draw(step: str) -> Column:
        return uniform(F.col("page_id"), lit(epoch), lit(seed), lit(step))

    base = input_size / F.greatest(F.col("width"), F.col("height"))
    low, high = SCALE_RANGE
    s = base * (low + (high - low) * draw("scale")) if train else base
    side = crop if train else input_size
    sized = records.withColumns({
        "sw": F.greatest(lit(1), g.half_even(F.col("width") * s).cast("int")),
        "sh": F.greatest(lit(1), g.half_even(F.col("height") * s).cast("int")),
    }).withColumns({"sx": F.col("sw") / F.col("width"), "sy": F.col("sh") / F.col("height")})
    if train:
        digest = F.md5(F.concat_ws("-", "page_id", lit(epoch), lit(seed), "x", "y", "w", "h"))
        pick = (
            boxes.where("role = 'text'")
            .groupBy("page_id").agg(F.min_by(F.struct("x", "y", "w", "h"), digest).alias("box"))
        )

        def around(centre: Column, step: str) -> Column:
            jitter = (2 * draw(step) - 1) * (crop / 3)
            return (centre + jitter - crop / 2).cast("int")

        def anywhere(size: Column, step: str) -> Column:
            lo, hi = F.least(lit(0), size - crop), F.greatest(lit(0), size - crop)
            return (lo + F.floor(draw(step) * (hi - lo + 1))).cast("int")

        on_text = F.col("box").isNotNull() & (draw("text") < 0.5)
        planned = sized.join(pick, "page_id", "left").withColumns({
            "on_text": on_text,
            "x0": F.when(on_text, around((F.col("box.x") + F.col("box.w") / 2) * F.col("sx"), "jx"))
            .otherwise(anywhere(F.col("sw"), "ox")),
            "y0": F.when(on_text, around((F.col("box.y") + F.col("box.h") / 2) * F.col("sy"), "jy"))
            .otherwise(anywhere(F.col("sh"), "oy")),
        })
    else:

        def centred(size: Column) -> Column:
            return F.when(size < side, F.floor((size - side) / 2)).otherwise(0).cast("int")

        planned = sized.withColumns({"on_text": lit(False), "x0": centred(F.col("sw")), "y0": centred(F.col("sh"))})
    return planned.select(
        "page_id", "on_text", lit(side).alias("crop"), "sx", "sy", "x0", "y0",
        F.greatest(lit(0), -F.col("x0")).alias("vx0"), F.greatest(lit(0), -F.col("y0")).alias("vy0"),
        F.least(lit(side), F.col("sw") - F.col("x0")).alias("vx1"), F.least(lit(side), F.col("sh") - F.col("y0")).alias("vy1"),
    )


def move_boxes(boxes: DataFrame, plan: DataFrame) -> DataFrame:
    """Label boxes in the coordinates of their page's crop."""
    return boxes.join(plan, "page_id").withColumns({
        "x": F.col("x") * F.col("sx") - F.col("x0"), "y": F.col("y") * F.col("sy") - F.col("y0"),
        "w": F.col("w") * F.col("sx"), "h": F.col("h") * F.col("sy"),
    })


def crop_layers(records: DataFrame, boxes: DataFrame, plan: DataFrame, order: Column, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """What is painted on each record's crop: its boxes, moved, over the part that the page covers.

    ``order`` tells which of two text boxes is on top, from the boxes as stored. A
    record without boxes still has its page, so every record gives rows. ``keys``
    tell the crops of a plan apart.
    """
    moved = move_boxes(boxes.withColumn("ord", order), plan).select(*keys, "role", "x", "y", "w", "h", "ord", "crop")
    page = plan.select(
        *keys, F.lit("page").alias("role"), F.col("vx0").cast("double").alias("x"), F.col("vy0").cast("double").alias("y"),
        (F.col("vx1") - F.col("vx0")).cast("double").alias("w"), (F.col("vy1") - F.col("vy0")).cast("double").alias("h"),
        F.lit(0).cast("long").alias("ord"), "crop",
    )
    cells = F.floor(F.col("crop") / g.STRIDE).cast("int")
    return moved.unionByName(page).withColumns({"columns": cells, "rows": cells}).drop("crop").join(
        records.select("page_id", "ignore_all"), "page_id")

"""Training metrics, confidences, store usage, timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkfield.operators.ordered import ordered_scan

NEGATIVE_RATIO = 3.0    # hardest background cells kept per text cell
TINY = 4.9e-324         # smallest positive double


def f1_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro-averaged precision, recall and F1 over cells where the mask counts."""
    hit, real = F.col("predicted"), F.col("target") == 1
    counts = predictions.where("mask = 1").groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn")
    )
    p = F.col("tp") / F.greatest(F.lit(1.0), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1.0), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall"))
    )


def masked_loss(cells: DataFrame, group: str, buckets_per_unit: int = 256) -> DataFrame:
    """BCE over text cells plus the hardest background cells, and dice, per group.

    The hardest cells come from a rank over buckets of the loss, so a large
    group is never sorted in one task.
    """
    x, t, m = F.col("logit"), F.col("target"), F.col("mask")
    bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    scored = cells.withColumns({"positive": t * m, "negative": (1 - t) * m, "prob": 1 / (1 + F.exp(-x)), "bce": bce})
    sums = scored.groupBy(group).agg(
        F.sum("positive").alias("n_pos"), F.sum("negative").alias("all_neg"),
        F.sum(F.col("bce") * F.col("positive")).alias("pos_loss"),
        F.sum(F.col("prob") * t * m).alias("both"), F.sum(F.col("prob") * m).alias("p_sum"), F.sum(t * m).alias("t_sum"),
    ).withColumn("n_neg", F.least("all_neg", NEGATIVE_RATIO * F.greatest(F.col("n_pos"), F.lit(1))))
    background = scored.where("negative = 1").select(group, "cell", (-F.col("bce")).alias("ease"))
    hardest = ordered_scan(
        background, [group], ["ease", "cell"], F.floor(F.col("ease") * buckets_per_unit), rank="_rank"
    )
    mined = (
        hardest.join(sums.select(group, "n_neg"), group)
        .where(F.col("_rank") <= F.col("n_neg"))
        .groupBy(group).agg(F.sum(-F.col("ease")).alias("neg_loss"))
    )
    kept = F.greatest(F.lit(1.0), F.col("n_pos") + F.col("n_neg"))
    return sums.join(mined, group, "left").select(
        group, ((F.col("pos_loss") + F.coalesce("neg_loss", F.lit(0.0))) / kept).alias("bce"),
        (1 - (2 * F.col("both") + 1) / (F.col("p_sum") + F.col("t_sum") + 1)).alias("dice"),
    ).withColumn("loss", F.col("bce") + F.col("dice"))


def mean_log_confidence(chunks: DataFrame, key: str) -> DataFrame:
    """Total log-probability over total steps of a region's chunks; 0 when none were taken."""
    return chunks.groupBy(key).agg(F.sum("log_prob").alias("_l"), F.sum("steps").alias("_s")).select(
        key, F.when(F.col("_s") > 0, F.col("_l") / F.col("_s")).otherwise(0.0).alias("confidence")
    )


def ctc_confidence(lines: DataFrame, key: str) -> DataFrame:
    """Log of the mean probability over the lines that were read; 0 when none were."""
    read = F.col("read")
    return lines.groupBy(key).agg(F.avg(F.when(read, F.col("probability"))).alias("_p")).select(
        key, F.when(F.col("_p").isNotNull(), F.log(F.greatest(F.lit(TINY), F.col("_p")))).otherwise(0.0).alias("confidence")
    )


def store_usage(entries: DataFrame) -> DataFrame:
    """Bytes per bucket, the declared size when positive, else the body's length; largest first."""
    declared = F.when(F.col("declared") > 0, F.col("declared"))
    return (
        entries.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce(declared, F.col("length"))).alias("bytes"),
            F.bool_and(declared.isNotNull()).alias("from_headers"),
        )
        .orderBy(F.desc("bytes"), "bucket")
    )


def format_bytes(size: Column) -> Column:
    """Bytes as B, KB, MB or GB: one decimal below ten of a unit, none above."""
    shown = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        value = size / 1024**power
        text = F.concat(
            F.when(value < 10, F.format_number(value, 1)).otherwise(F.regexp_replace(F.format_number(value, 0), ",", "")),
            F.lit(f" {unit}"),
        )
        shown = shown.otherwise(text) if unit == "GB" else shown.when(value < 1024, text)
    return shown


def timing_totals(timings: DataFrame) -> DataFrame:
    """Total and mean milliseconds and failures per model and stage."""
    return timings.groupBy("model", "stage").agg(
        F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"),
        F.count_if(F.col("failed")).alias("failed"), F.count(F.lit(1)).alias("items"),
    )

"""Operators over ordered rows: running values, gap segments, repeats, strips, packing.

A plain window keyed by a group runs each group in one task. ``ordered_scan``
computes the same running values with groups cut into buckets of their order
column: each bucket is scanned on its own, only one summary row per bucket is
scanned across the group, and the two are joined. A group holding a large part
of all rows is then spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from inkfield.functions import geometry as g


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lag: Mapping[str, str] | None = None,
    total: Mapping[str, str] | None = None,
    last_known: Mapping[str, str] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Adds running columns per ``keys`` in ``order`` (a total order).

    ``lag``: value on the row before. ``total``: running sum, this row included.
    ``last_known``: latest non-null value up to this row. ``rank``: row number.
    ``bucket`` must not decrease along ``order``; its range bounds the number of
    summary rows per group.
    """
    lag, total, last_known = lag or {}, total or {}, last_known or {}
    if rank:
        df = df.withColumn("_one", F.lit(1).cast("long"))
        total = {**total, rank: "_one"}
    parts = [*keys, "_bucket"]
    along = W.partitionBy(*parts).orderBy(*order)
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn("_bucket", bucket).select(
        "*",
        F.row_number().over(along).alias("_place"),
        *(F.lag(c).over(along).alias(f"_lag_{o}") for o, c in lag.items()),
        *(F.sum(c).over(so_far).alias(f"_sum_{o}") for o, c in total.items()),
        *(F.last(c, ignorenulls=True).over(so_far).alias(f"_last_{o}") for o, c in last_known.items()),
    )
    size = F.count(F.lit(1)).over(W.partitionBy(*parts))
    closing = local.withColumn("_size", size).where("_place = _size")
    across = W.partitionBy(*keys).orderBy("_bucket")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    carry = closing.select(
        *(F.col(p).alias(f"_at_{p}") for p in parts),
        *(F.lag(c).over(across).alias(f"_clag_{o}") for o, c in lag.items()),
        *(F.sum(f"_sum_{o}").over(earlier).alias(f"_csum_{o}") for o in total),
        *(F.last(f"_last_{o}", ignorenulls=True).over(earlier).alias(f"_clast_{o}") for o in last_known),
    )
    same = F.lit(True)
    for part in parts:
        same = same & F.col(part).eqNullSafe(F.col(f"_at_{part}"))
    return local.join(carry, same).select(
        *(c for c in df.columns if c != "_one"),
        *(F.when(F.col("_place") == 1, F.col(f"_clag_{o}")).otherwise(F.col(f"_lag_{o}")).alias(o) for o in lag),
        *((F.col(f"_sum_{o}") + F.coalesce(f"_csum_{o}", F.lit(0))).alias(o) for o in total),
        *(F.coalesce(f"_last_{o}", f"_clast_{o}").alias(o) for o in last_known),
    )


def unnulled(df: DataFrame, parts: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Columns without nulls that are equal where the given ones are, null to null.

    A join on them keeps the layout of a window by them; a null-safe join on the
    given ones would send all rows again. Parts of other types than numbers and
    strings are left as they are, with none in return.
    """
    kinds = [df.schema[p].dataType for p in parts]
    if not all(isinstance(k, (T.NumericType, T.StringType)) for k in kinds):
        return df, []
    blank = {f"_key_{p}": F.coalesce(p, F.lit("" if isinstance(k, T.StringType) else 0).cast(k)) for p, k in zip(parts, kinds)}
    nulls = sum((F.col(p).isNull().cast("int") * 2**n for n, p in enumerate(parts)), F.lit(0))
    return df.withColumns({**blank, "_nulls": nulls}), [*blank, "_nulls"]


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lag: Mapping[str, str],
    opens: Column,
    island: str = "island",
    rank: str | None = None,
) -> DataFrame:
    """Numbers the runs of rows per ``keys``: a row for which ``opens`` holds starts a new one.

    ``opens`` may use the row's columns and the ``lag`` outputs (null on the
    first row). Buckets are cut as in ``ordered_scan``; only the first row of a
    bucket needs the bucket before, so one summary pass settles lags, runs and
    ranks together.
    """
    parts = [*keys, "_bucket"]
    bucketed, plain = unnulled(df.withColumn("_bucket", bucket), parts)
    along = W.partitionBy(*(plain or parts)).orderBy(*order)
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    started = F.coalesce(opens, F.lit(False)).cast("long")
    local = (
        bucketed.select(
            "*", F.row_number().over(along).alias("_place"),
            *(F.lag(c).over(along).alias(o) for o, c in lag.items()),
        )
        .withColumn("_opens", F.when(F.col("_place") == 1, F.lit(0).cast("long")).otherwise(started))
        .withColumn("_run", F.sum("_opens").over(so_far))
    )
    across = W.partitionBy(*keys).orderBy("_bucket")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    first_rows = local.select(
        "*", F.sum("_opens").over(whole).alias("_total"), F.count(F.lit(1)).over(whole).alias("_size"),
        *(F.last(c).over(whole).alias(f"_end_{o}") for o, c in lag.items()),
    ).where("_place = 1")
    carry = (
        first_rows.withColumns({o: F.lag(f"_end_{o}").over(across) for o in lag})
        .withColumn("_first", started)
        .select(
            *(F.col(p).alias(f"_at_{p}") for p in plain or parts),
            *(F.col(o).alias(f"_carried_{o}") for o in lag),
            (F.coalesce(F.sum(F.col("_total") + F.col("_first")).over(earlier), F.lit(0)) + F.col("_first")).alias("_run_base"),
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_rank_base"),
        )
    )
    same = F.lit(True)
    for part in plain or parts:
        here, there = F.col(part), F.col(f"_at_{part}")
        same = same & (here == there if plain else here.eqNullSafe(there))
    ranked = [(F.col("_place") + F.col("_rank_base")).alias(rank)] if rank else []
    return local.join(carry, same).select(
        *df.columns,
        *(F.when(F.col("_place") == 1, F.col(f"_carried_{o}")).otherwise(F.col(o)).alias(o) for o in lag),
        (F.col("_run") + F.col("_run_base")).alias(island),
        *ranked,
    )

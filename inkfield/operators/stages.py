"""Pluggable model stages over DataFrames: bounded batches, one model per task, errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Model = Callable[[pd.DataFrame], pd.DataFrame]


def apply_stage(df: DataFrame, factory: Callable[[], Model], schema: str, batch_rows: int = 256) -> DataFrame:
    """Runs a model over every row.

    ``factory`` is called once per task and returns a callable from a batch to
    a frame with the columns of ``schema``. A batch that fails is retried row by
    row; a row that fails keeps nulls, ``status`` 'error' and the message. If
    the model has ``dispose`` it is called at the end of the task.
    """
    columns = T.StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def attempt(batch: pd.DataFrame) -> pd.DataFrame:
            done = model(batch)[columns].reset_index(drop=True)
            if len(done) != len(batch):
                raise ValueError(f"stage gave {len(done)} rows for {len(batch)}")
            return done.assign(status="ok", error=None)

        try:
            for frame in frames:
                for start in range(0, len(frame), batch_rows):
                    batch = frame.iloc[start:start + batch_rows].reset_index(drop=True)
                    try:
                        yield attempt(batch)
                        continue
                    except Exception:  # noqa: BLE001 - a failing row must not lose its batch
                        pass
                    rows = []
                    for i in range(len(batch)):
                        one = batch.iloc[i:i + 1].reset_index(drop=True)
                        try:
                            rows.append(attempt(one))
                        except Exception as error:  # noqa: BLE001
                            blank = {c: one[c].iloc[0] if c in one.columns else None for c in columns}
                            rows.append(pd.DataFrame([{**blank, "status": "error", "error": str(error)}]))
                    yield pd.concat(rows, ignore_index=True)
        finally:
            dispose = getattr(model, "dispose", None)
            if dispose:
                dispose()

    return df.mapInPandas(run, schema + ", status STRING, error STRING")


def apply_by_language(df: DataFrame, factories: dict[str, Callable[[], Model]], schema: str, slices: int = 64) -> DataFrame:
    """One model per language: rows go to tasks of their language only, each language over many tasks.

    A common language would overload one task, so each is spread over ``slices``.
    Rows of a language without a model come back as errors.
    """
    other = df.where(~F.coalesce(F.col("language").isin(list(factories)), F.lit(False)))
    held = {f.name.lower(): f.name for f in df.schema.fields}
    out = other.select(
        *((F.col(held[f.name.lower()]) if f.name.lower() in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields),
        F.lit("error").alias("status"), F.concat(F.lit("no model for "), F.coalesce("language", F.lit("null"))).alias("error"),
    )
    for language, factory in factories.items():
        rows = df.where(F.col("language") == language).repartition(slices)
        part = apply_stage(rows, factory, schema)
        out = out.unionByName(part)
    return out

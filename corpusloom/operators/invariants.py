"""Invariants of data sets (QF-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, key: str, columns: list[str], filled: list[str] | None = None, ranges: dict[str, tuple[float, float]] | None = None, rows: int | None = None) -> DataFrame:
    """QF-13, one row: n_rows, n_keys (distinct), missing and unexpected (columns against the exact set), n_blank (rows with
    a blank in filled), n_outside (rows with a value outside its closed range, or none), and ok: keys are unique, the
    columns are those named, nothing is blank or outside, and there are as many rows as stated."""
    there = set(df.columns)
    missing, unexpected = sorted(set(columns) - there), sorted(there - set(columns))
    texts = [c for c in filled or [] if c in there]
    values = {c: ends for c, ends in (ranges or {}).items() if c in there}
    any_of = lambda flags: F.count(F.when(F.array_contains(F.array(F.lit(False), *flags), True), 1))
    blank = any_of([F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in texts])
    outside = any_of([~F.coalesce(F.col(c).between(*ends), F.lit(False)) for c, ends in values.items()])
    out = df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), blank.alias("n_blank"), outside.alias("n_outside"))
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    out = out.withColumns({"missing": names(missing), "unexpected": names(unexpected)})
    sound = (F.col("n_keys") == F.col("n_rows")) & (F.col("n_blank") == 0) & (F.col("n_outside") == 0) & F.lit(not missing and not unexpected)
    return out.withColumn("ok", sound & (F.col("n_rows") == rows) if rows is not None else sound)

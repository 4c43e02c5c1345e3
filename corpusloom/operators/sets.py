"""Set and bag operations (SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """SET-02."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """SET-02."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def relation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """SET-02: sizes of both sides' key sets and of what they share; equal and subset follow."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, keys, "full_outer").agg(F.count("__a").alias("left_n"), F.count("__b").alias("right_n"), F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("shared_n"))
    return both.withColumn("is_subset", F.col("shared_n") == F.col("left_n")).withColumn("is_equal", F.col("is_subset") & (F.col("left_n") == F.col("right_n")))


def bag_intersection(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """SET-03: least count of each element that both bags hold."""
    return left.join(right.withColumnRenamed(n, "__n"), keys).withColumn(n, F.least(n, "__n")).drop("__n")


def first_mapping(*maps: Column) -> Column:
    """SET-04: merged maps in which the first mapping of a key stays."""
    def beside(held: Column, more: Column) -> Column:
        return F.map_concat(held, F.map_filter(more, lambda k, _: ~F.map_contains_key(held, k)))

    out = maps[0]
    for m in maps[1:]:
        out = beside(out, m)
    return out

"""Joins (JOI-*). All are equi-joins, so Spark can sort-merge, broadcast by statistics, and split skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_rows(base: DataFrame, repair: DataFrame, metrics: DataFrame) -> DataFrame:
    """JOI-01: successful base and repaired outputs with their metrics, where there are reasons or the story changed.

    base, repair: id, status, story; metrics: id, reasons.
    """
    ok = F.col("status") == "success"
    a = base.where(ok).select("id", F.col("story").alias("base_story"))
    b = repair.where(ok).select("id", F.col("story").alias("repair_story"))
    both = a.join(b, "id").join(metrics.select("id", "reasons"), "id")
    changed = F.trim("base_story") != F.trim("repair_story")
    return both.withColumn("changed", changed).where((F.size("reasons") > 0) | changed)


def unblind(judgments: DataFrame, blind_map: DataFrame) -> DataFrame:
    """JOI-02."""
    return judgments.join(blind_map, "blind_id")


def unmatched(judgments: DataFrame, blind_map: DataFrame) -> DataFrame:
    """JOI-02, check: ids on one side only; empty for complete data."""
    a = judgments.select("blind_id").distinct().withColumn("__a", F.lit(1))
    b = blind_map.select("blind_id").distinct().withColumn("__b", F.lit(1))
    both = a.join(b, "blind_id", "full_outer").where("__a IS NULL OR __b IS NULL")
    return both.select("blind_id", F.when(F.col("__a").isNull(), "not judged").otherwise("not mapped").alias("missing"))


def attach(judged: DataFrame, generated: DataFrame) -> DataFrame:
    """JOI-03: judged rows with their generation, by candidate and prompt."""
    return judged.join(generated, ["candidate_id", "prompt_id"])


def paired_conditions(rows: DataFrame, key: str, condition: str, left: str, right: str, value: str) -> DataFrame:
    """JOI-04: the value under two conditions, side by side; a key that lacks one is an error in the data and is marked."""
    a = rows.where(F.col(condition) == left).select(key, F.col(value).alias("left_value"))
    b = rows.where(F.col(condition) == right).select(key, F.col(value).alias("right_value"))
    both = a.join(b, key, "full_outer")
    return both.withColumn("complete", F.col("left_value").isNotNull() & F.col("right_value").isNotNull())


def ranked_pairs(rows: DataFrame, rank: str, item: str, value: str) -> DataFrame:
    """JOI-05, 07: all pairs of candidates (or judges) over their common items; one row a pair and item.

    The number of candidates is that of models or judges, so an item's pairs are few.
    """
    a = rows.select(F.col(rank).alias("left"), item, F.col(value).alias("left_value"))
    b = rows.select(F.col(rank).alias("right"), item, F.col(value).alias("right_value"))
    return a.join(b, item).where(F.col("left") < F.col("right"))


def gram_overlap(docs: DataFrame, doc: str, n: int, by: str) -> DataFrame:
    """JOI-06: by, doc, shared, total: what each document shares with all later ones of by, one row a document.

    The pairs of documents meet in an inverted index over n-grams and are summed there, not made: see ``stats.shared_grams``.
    """
    from .stats import shared_grams

    return shared_grams(docs, doc, n, by)


def paired_difference(rows: DataFrame, pair: str, model: str, left: str, right: str, value: str) -> DataFrame:
    """JOI-08: difference of two models by pair id."""
    both = paired_conditions(rows, pair, model, left, right, value).where("complete")
    return both.select(pair, (F.col("left_value") - F.col("right_value")).alias("difference"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """JOI-09, SRC-13: the table's value, else the default; found says which."""
    t = table.select(key, F.col(value).alias("__value"), F.lit(True).alias("__hit"))
    return rows.join(t, key, "left").withColumn(value, F.coalesce("__value", default)).withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__value", "__hit")


def pending(everything: DataFrame, *done: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-10: what no table of finished keys has yet."""
    for d in done:
        everything = everything.join(d.select(*keys).distinct(), keys, "left_anti")
    return everything


def by_position(rows: DataFrame, table: DataFrame, index: str, ord_col: str = "ord") -> DataFrame:
    """JOI-11: the table's row of the given order number."""
    return rows.join(table.withColumnRenamed(ord_col, index), index)


def with_listed_tokens(rows: DataFrame, tokens: Column, listed: list[str]) -> DataFrame:
    """JOI-12: rows with a token of a short list."""
    return rows.where(F.arrays_overlap(tokens, F.array(*map(F.lit, listed))))


def grid(prompts: DataFrame, *dims: DataFrame) -> DataFrame:
    """JOI-13: every prompt under every model, use case or candidate; dims are lists of a few rows, sent as literals."""
    for d in dims:
        values = [r.asDict() for r in d.limit(1001).collect()]
        if len(values) > 1000:
            raise ValueError("grid dimensions are short lists; join larger tables on a key")
        if not values:
            return prompts.limit(0).crossJoin(d)
        rows = F.array(*(F.struct(*(F.lit(v).cast(d.schema[k].dataType).alias(k) for k, v in r.items())) for r in values))
        prompts = prompts.withColumn("__d", F.explode(rows)).select(*prompts.columns, "__d.*")
    return prompts

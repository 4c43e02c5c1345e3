"""Ranking, top-k and choice (RNK-*). Ties are always broken by an explicit key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_models(scores: DataFrame, model: str = "model", overall: str = "overall", ord_col: str = "ord") -> DataFrame:
    """RNK-02: one row a model, by mean score, equals in order of ord_col. The table is as large as the list of models."""
    w = Window.orderBy(F.desc(overall), ord_col)
    return scores.withColumn("rank", F.row_number().over(w))


def conclusion(ranked: DataFrame, model: str = "model", overall: str = "overall") -> DataFrame:
    """RNK-02: the winner, and the order as text."""
    line = F.array_sort(F.collect_list(F.struct("rank", model, overall)))
    text = F.transform(line, lambda r: F.format_string("%s (%.2f)", r[model], r[overall]))
    return ranked.agg(F.min_by(model, "rank").alias("winner"), F.concat(F.lit("By rank: "), F.array_join(text, " > ")).alias("by_rank"))


def ladder(models: DataFrame, sizes: dict[str, float], model: str = "model") -> DataFrame:
    """RNK-03: models of known size, smallest first."""
    known = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    return models.withColumn("params", known[F.col(model)]).where("params IS NOT NULL").orderBy("params", model)


def best_of(df: DataFrame, group: str, score: str, k: str) -> DataFrame:
    """RNK-04: the best row of each group, the first of equals. Combined before the shuffle."""
    rest = [c for c in df.columns if c != group]
    best = F.max(F.struct(F.col(score), (-F.col(k)).alias("__k"), F.struct(*rest).alias("row"))).alias("b")
    return df.groupBy(group).agg(best).select(group, "b.row.*")


def early_accept(df: DataFrame, group: str, score: str, k: str, threshold: float) -> DataFrame:
    """RNK-05: the first candidate that reaches the threshold, else the best; rejected where that falls short."""
    first = F.min(F.when(F.col(score) >= threshold, F.col(k))).alias("first_k")
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(k)).alias("nk"))).alias("b")
    out = df.groupBy(group).agg(first, best)
    chosen = F.coalesce("first_k", -F.col("b.nk")).cast("long")
    return out.select(group, chosen.alias("k"), F.col("first_k").isNotNull().alias("accepted"), F.col("b.s").alias("best_score"))


def head(df: DataFrame, ord_col: str, n: int) -> DataFrame:
    """RNK-06: the first n rows in order (a top-k, no global sort)."""
    return df.orderBy(ord_col).limit(n)


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column | str], n: int) -> DataFrame:
    """RNK-06, 08: the first n rows of each group; ranks are cut in each partition before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def numbered(ranked: DataFrame, prefix: str, rank: str = "rank", width: int = 3) -> DataFrame:
    """WIN-06: position ids such as B001."""
    return ranked.withColumn("position_id", F.concat(F.lit(prefix), F.lpad(F.col(rank).cast("string"), width, "0")))

"""Deduplication under explicit policies (DED-*): the key, who is remembered, and which row wins.

Winners are found by aggregating keys and order numbers alone (combined before the shuffle, so a key with a third of all
rows is no hot spot); the rows themselves then meet the winners' unique order numbers in a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def first_by(df: DataFrame, key: Column, ord_col: str = "ord", last: bool = False) -> DataFrame:
    """The first (or last) row of each key in order of ord_col, which is unique. Null keys are one key.

    DED-02, 04, 05, 06, 07, 08: first wins. DED-11: last wins.
    """
    pick = F.max if last else F.min
    winners = df.select(key.alias("__k"), F.col(ord_col).alias("__o")).groupBy("__k").agg(pick("__o").alias("__o"))
    return df.join(winners.select("__o"), df[ord_col] == F.col("__o"), "left_semi")


def mark_accepted_only(df: DataFrame, key: Column, ok: Column, ord_col: str = "ord") -> DataFrame:
    """DED-01: only accepted rows are remembered: a row is a duplicate iff an earlier accepted row has its key.

    Adds duplicate; a duplicate of a rejected row is judged on its own.
    """
    keyed = df.withColumn("__k", F.coalesce(key, F.lit("")))
    first = keyed.where(ok).groupBy("__k").agg(F.min(ord_col).alias("__first"))
    return keyed.join(first, "__k", "left").withColumn("duplicate", F.coalesce(F.col("__first") < F.col(ord_col), F.lit(False))).drop("__k", "__first")


def story_key(c: Column) -> Column:
    """DED-01, 03: SHA-1 of the cleaned lower-case text."""
    return F.sha1(F.lower(T.clean_simple(c)))


def pair_key(input_: Column, output: Column) -> Column:
    """DED-02."""
    return F.sha1(F.lower(T.clean_simple(F.concat(input_, F.lit("\n"), output))))


def prefix_key(c: Column, n: int = 500, compose: bool = True) -> Column:
    """DED-04: composed, without white space, lower case, first n characters."""
    return F.substring(F.lower(T.sub(T.nfc(c) if compose else c, r"(?U)\s+", "")), 1, n)


def refilter_reasons(reasons: Column, duplicate: Column, policy: str = "append") -> Column:
    """DED-03: duplicate_story joins the other reasons ("append"), or only stands where there are none ("only")."""
    mark = F.array(F.lit("duplicate_story"))
    add = duplicate if policy == "append" else duplicate & (F.size(reasons) == 0)
    return F.when(add, F.concat(reasons, mark)).otherwise(reasons)


def by_priority(sources: list[tuple[DataFrame, str]], key: Column, ord_col: str = "ord") -> DataFrame:
    """DED-09, SET-01: union in order of priority; the first source, then the first row, wins. Blank keys go."""
    both = None
    for rank, (df, name) in enumerate(sources):
        one = df.withColumn("src", F.lit(name)).withColumn("src_rank", F.lit(rank))
        both = one if both is None else both.unionByName(one)
    both = both.withColumn("__k", key).where(F.col("__k") != "")
    winners = both.groupBy("__k").agg(F.min(F.struct("src_rank", ord_col)).alias("w")).select(F.col("w.src_rank").alias("src_rank"), F.col(f"w.{ord_col}").alias(ord_col))
    return both.join(winners, ["src_rank", ord_col], "left_semi").drop("__k")


def harvest(best: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """DED-10: of best, the last row of each prompt with a high score; of pairs, those whose prompt best lacks."""
    good = best.where(F.col("score") >= threshold)
    kept = first_by(good, F.col("prompt"), last=True).select("prompt", "story", "score", F.lit("sft_best").alias("src"))
    more = first_by(pairs.where(F.col("score_chosen") >= threshold), F.col("prompt")).join(kept, "prompt", "left_anti")
    return kept.unionByName(more.select("prompt", F.col("chosen").alias("story"), F.col("score_chosen").alias("score"), F.lit("dpo_chosen").alias("src")))


def prompt_id(*slots: Column) -> Column:
    """DED-12: twelve hex digits of the SHA-1 of the slots joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *slots)), 1, 12)

"""Aggregates and evaluation statistics (AGG-*). Every one is a plain group-by with partial aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .ordered import below, kept
from .sampling import uniform


def share(flag: Column) -> Column:
    """Mean of a flag."""
    return F.avg(flag.cast("int"))


def counts(df: DataFrame, *by: str) -> DataFrame:
    """AGG-01."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, reasons: str = "reasons", *by: str) -> DataFrame:
    """AGG-01, SNK-04: rows by reason, most frequent first.

    The outer form of explode keeps the optimizer from inferring a filter that would evaluate all rules twice more.
    """
    return df.select(*by, F.explode_outer(reasons).alias("reason")).where("reason IS NOT NULL").groupBy(*by, "reason").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "reason")


def success_rates(df: DataFrame, flags: list[str], words: str = "word_count", latency: str = "latency_ms", status: str = "status") -> DataFrame:
    """AGG-02: rates over successful rows; mean latency leaves zeros out; no success counts as one."""
    ok = F.col(status) == "success"
    n = F.greatest(F.count(F.when(ok, 1)), F.lit(1))
    rates = [(F.count(F.when(ok & F.col(f), 1)) / n).alias(f"{f}_rate") for f in flags]
    return df.agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("success"), *rates, F.coalesce(F.avg(F.when(ok, F.col(words))), F.lit(0.0)).alias("avg_words"), F.coalesce(F.avg(F.when(ok & (F.col(latency) != 0), F.col(latency))), F.lit(0.0)).alias("avg_latency_ms"))


def side_metrics(df: DataFrame, side: str = "side", story: str = "story") -> DataFrame:
    """AGG-03: one row a side; latency keeps zeros; distinct-1 and -2 over Unicode words."""
    ok = F.col("status") == "success"
    base = df.groupBy(side).agg(
        F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("success"), F.count(F.when(~ok, 1)).alias("errors"),
        F.count(F.when(ok & (F.col("output_safety") != "ok"), 1)).alias("blocked_outputs"),
        F.count(F.when(ok & F.lower(story).rlike(r"(?U)\b(moral|lesson|teaching)\b"), 1)).alias("moral_outputs"),
        F.coalesce(F.avg(F.when(ok, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
    )
    words = df.where(ok).select(side, T.unicode_words(F.col(story)).alias("t"))
    return base.join(distinct_n(words, side, 1, "distinct_1"), side, "left").join(distinct_n(words, side, 2, "distinct_2"), side, "left").fillna(0.0, ["distinct_1", "distinct_2"])


def axis_means(df: DataFrame, axes: list[str], *by: str) -> DataFrame:
    """AGG-04: means of three decimals, and their own mean as overall; zeros without rows."""
    means = df.groupBy(*by).agg(*(F.round(F.coalesce(F.avg(a), F.lit(0.0)), 3).alias(a) for a in axes))
    return means.withColumn("overall", F.round(sum((F.col(a) for a in axes[1:]), F.col(axes[0])) / len(axes), 3))


def candidate_summary(df: DataFrame, by: str, score: str, story: str, actions: str, action: str) -> DataFrame:
    """AGG-05: mean and median score, stories with text, rows with any action, and with one given action."""
    return df.groupBy(by).agg(
        F.avg(score).alias("mean"), F.percentile(score, 0.5).alias("median"), F.count(F.when(F.trim(story) != "", 1)).alias("non_empty"),
        F.count(F.when(F.size(actions) > 0, 1)).alias("with_actions"), F.count(F.when(F.array_contains(actions, action), 1)).alias("with_action"),
    )


def distinct_share(tokens: Column, n: int) -> Column:
    """AGG-12 for one text: distinct over all n-grams, zero without any."""
    grams = T.ngrams(tokens, n)
    return F.when(F.size(grams) > 0, F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)


def half_up(c: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: scaled, to the nearest whole number, and back. ``F.round`` rounds the shortest
    decimal that names the double, which at ties is another number."""
    return F.round(c * 10.0**digits) / 10.0**digits


def evaluate_rows(df: DataFrame, story: str, raw: str) -> DataFrame:
    """SCR-13: adds the judge's axes and overall, distinct_1 and distinct_2 (four decimals) and flesch (one; 0 if blank)."""
    from corpusloom.functions import parse as P

    scores, names = P.parse_scores(F.col(raw)), df.columns
    df = df.withColumns({**{k: scores[k] for k in [*P.AXES, "overall"]}, "__t": T.tokens(F.col(story))})
    ease = F.when(T.strip(F.col(story)) != "", half_up(flesch(F.col(story)), 1)).otherwise(0.0)
    df = df.withColumns({"distinct_1": half_up(distinct_share(F.col("__t"), 1), 4), "distinct_2": half_up(distinct_share(F.col("__t"), 2), 4), "flesch": ease})
    return df.select(*names, *P.AXES, "overall", "distinct_1", "distinct_2", "flesch")


def percentile(c: Column | str, q: float) -> Column:
    """AGG-06: linear between neighbours at (n - 1) q."""
    return F.percentile(c, q)


def bootstrap_ci(df: DataFrame, ord_col: str, value: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """AGG-07: 95 % interval of the mean over resamples with replacement.

    The draw of a round is a digest of (seed, round, draw) modulo n; values are numbered 0 .. n - 1 in order of ord_col.
    For samples of judged items, not for corpora: rounds * n draws are made, dealt over the executors.
    """
    from .ordered import ranked

    n = df.count()
    numbered = ranked(df.select(F.col(ord_col).alias("__o"), F.col(value).cast("double").alias("__v")), ["__o"], "__n").select((F.col("__n") - 1).alias("i"), "__v")
    draws = df.sparkSession.range(rounds * n).select(F.floor(F.col("id") / n).alias("round"), (F.col("id") % n).alias("draw"))
    draws = draws.withColumn("i", uniform(seed, F.col("round"), F.col("draw"), n=n))
    means = draws.join(numbered, "i").groupBy("round").agg(F.avg("__v").alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("*").alias("rounds"))


def paired_summary(df: DataFrame, left: str, right: str, *by: str) -> DataFrame:
    """AGG-08: mean difference and wins, ties, losses."""
    d = F.col(left) - F.col(right)
    return df.groupBy(*by).agg(F.avg(d).alias("mean_difference"), F.count(F.when(d > 0, 1)).alias("wins"), F.count(F.when(d == 0, 1)).alias("ties"), F.count(F.when(d < 0, 1)).alias("losses"))


def coverage(flags: list[Column]) -> Column:
    """AGG-09: how many flags hold in a row."""
    return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))


def both_rate(a: Column, b: Column) -> Column:
    """AGG-11."""
    return share(a & b)


def gram_table(tokens: DataFrame, by: str, n: int) -> DataFrame:
    """by, gram, c: n-grams within documents, counted before the shuffle. tokens: by, t (array)."""
    return tokens.select(by, F.explode(F.transform(T.ngrams(F.col("t"), n), lambda g: F.array_join(g, "\u0001"))).alias("gram")).groupBy(by, "gram").agg(F.count("*").alias("c"))


def distinct_n(tokens: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """AGG-12: distinct n-grams over all n-grams of a group's documents."""
    return gram_table(tokens, by, n).groupBy(by).agg((F.count("*") / F.sum("c")).alias(name))


def shared_grams(docs: DataFrame, doc: str, n: int, by: str) -> DataFrame:
    """JOI-06: by, doc, shared (n-grams in common with each later document of by, counted with multiplicity and summed over
    them), total (the document's own n-grams). All pairs i < j count, none is enumerated: the result has a row a document.

    least(a, b) is the sum over levels k of [a >= k][b >= k], so every document counts, for each of its grams and levels,
    the later ones that reach the level. docs: doc (ordered, unique), t (array of tokens), by.
    """
    from .ordered import later_in_key

    grams = docs.select(by, doc, F.explode(F.transform(T.ngrams(F.col("t"), n), lambda g: F.array_join(g, "\u0001"))).alias("gram")).groupBy(by, doc, "gram").agg(F.count("*").alias("c"))
    levels = grams.select(by, doc, F.xxhash64("gram").alias("h"), "gram", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("k"))
    return later_in_key(levels, [by, "h", "gram", "k"], doc).groupBy(by, doc).agg(F.sum("later").alias("shared"), F.count("*").alias("total"))


def self_bleu(docs: DataFrame, doc: str, n: int, by: str | None = None) -> DataFrame:
    """AGG-13: mean over document pairs i < j of clipped n-gram precision of i against j, from ``shared_grams``."""
    docs = docs.withColumn("__by", F.col(by) if by else F.lit(""))
    sizes = docs.groupBy("__by").agg(F.count("*").alias("docs"))
    summed = shared_grams(docs, doc, n, "__by").groupBy("__by").agg(F.sum(F.col("shared") / F.col("total")).alias("s"))
    pairs = F.col("docs") * (F.col("docs") - 1) / 2
    out = sizes.join(summed, "__by", "left").select("__by", F.when(pairs > 0, F.coalesce("s", F.lit(0.0)) / pairs).otherwise(F.lit(0.0)).alias("self_bleu"), "docs")
    return out.withColumnRenamed("__by", by) if by else out.drop("__by")


def syllables(word: Column) -> Column:
    """Vowel groups of a word, one at least; a silent final e does not count."""
    core = F.regexp_replace(F.lower(word), "([^aeiouy])e$", "$1")
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(core, F.lit("[aeiouy]+"), F.lit(0))))


def flesch(c: Column) -> Column:
    """AGG-14: Flesch reading ease with the syllable rule above; zero for text without words."""
    words = T.words(c, T.WORDS_APOSTROPHE)
    w, s = F.size(words), F.greatest(F.lit(1), F.size(T.sentences(c)))
    syl = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, x: a + x)
    # products of whole numbers, so that a tie of the rounded score is met exactly
    return F.when(w > 0, 206.835 - 1015 * w / 1000 / s - 846 * syl / 10 / w).otherwise(0.0)


def kappa(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """AGG-15: quadratic-weighted kappa in one pass; 0 without rows, 1 where its denominator is zero."""
    n = F.count("*")
    num, den = F.sum((F.col(x) - F.col(y)) ** 2), F.sum(F.col(x) ** 2) + F.sum(F.col(y) ** 2) - 2 * F.sum(x) * F.sum(y) / n
    return df.groupBy(*by).agg(F.when(n == 0, 0.0).when(den == 0, 1.0).otherwise(1.0 - num / den).alias("kappa"), n.alias("n"))


def discordant(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Weighted number of pairs with x rising and y falling, by merging runs twice as long each time."""
    order = np.lexsort((y, x))
    y, c, at, total, width = y[order], c[order], np.arange(len(x)), 0, 0
    while len(x) > 1 << width:
        block, right = at >> (width + 1), at >> width & 1
        by = np.lexsort((1 - right, -y, block))
        weight = np.where(right[by] == 0, c[by], 0)
        above = np.cumsum(weight) - weight
        starts = np.flatnonzero(np.diff(block[by], prepend=-1))
        above -= np.repeat(above[starts], np.diff(np.append(starts, len(by))))
        total += int((above * np.where(right[by] == 1, c[by], 0)).sum())
        width += 1
    return total


def tau(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """AGG-16: Kendall's tau-b over the rows of a group; 0 for fewer than two rows or constant columns.

    No pairs are made. Rows are counted by (x, y) first. Both columns are cut into ranges, a value that alone fills a range
    being one of its own; pairs in different ranges of both columns follow from the counts of range pairs, pairs within a
    range of x, or in different ranges of x and the same of y, are counted by merging inside that range.
    """
    keys = list(by) or ["__all"]
    df = df.select(*by, *([F.lit(0).alias("__all")] if not by else []), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = df.groupBy(*keys, "x", "y").agg(F.count("*").alias("c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(0.5))
    ends = cells.groupBy(*keys).agg(*(F.percentile_approx(v, cuts, F.lit(10 * parts)).alias(f"{v}_cuts") for v in "xy"))
    placed = cells.join(ends, keys).withColumns({f"{v}_cuts": F.array_sort(F.array_distinct(f"{v}_cuts")) for v in "xy"})
    placed = placed.withColumns({f"{v}_below": below(F.col(f"{v}_cuts"), parts, F.col(v)) for v in "xy"})
    # an odd range number is that of a cut itself
    range_of = lambda v: (2 * F.col(f"{v}_below") + F.coalesce((F.get(f"{v}_cuts", F.col(f"{v}_below")) == F.col(v)).cast("int"), F.lit(0))).alias(f"{v}_range")
    placed = kept(placed.select(*keys, "x", "y", "c", range_of("x"), range_of("y")))

    def inside(columns: list[str], other: str):
        """Discordant pairs within each range of columns[-1]; with other, of different ranges of it."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in keys) + ", d long"

        def count(rows: pd.DataFrame) -> pd.DataFrame:
            first = (rows[other] if other else rows["x"]).to_numpy()
            return rows.iloc[:1][keys].assign(d=discordant(first, rows["y"].to_numpy(), rows["c"].to_numpy()))

        several = placed.where(f"{columns[-1]} % 2 = 0")  # a range of one value has no discordant pair of its own
        return several.groupBy(*columns).applyInPandas(count, schema)

    within = inside([*keys, "x_range"], "").unionByName(inside([*keys, "y_range"], "x_range"))
    boxes = placed.groupBy(*keys, "x_range", "y_range").agg(F.sum("c").cast("long").alias("c"))

    def across(rows: pd.DataFrame) -> pd.DataFrame:  # at most as many rows as pairs of ranges
        return rows.iloc[:1][keys].assign(d=discordant(rows["x_range"].to_numpy(), rows["y_range"].to_numpy(), rows["c"].to_numpy()))

    parted = boxes.groupBy(*keys).applyInPandas(across, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema.fields if f.name in keys) + ", d long")
    falling = within.unionByName(parted).groupBy(*keys).agg(F.sum("d").alias("d"))
    pairs = lambda n: n * (n - 1) / 2
    ties = lambda *v: placed.groupBy(*keys, *v).agg(F.sum("c").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("t_" + "".join(v)), F.sum("n").alias("n"))
    joined = falling.join(ties("x"), keys).join(ties("y").drop("n"), keys).join(ties("x", "y").drop("n"), keys)
    every = pairs(F.col("n"))
    nx, ny = every - F.col("t_x"), every - F.col("t_y")
    s = every - F.col("t_x") - F.col("t_y") + F.col("t_xy") - 2 * F.col("d")
    return joined.select(*by, F.when((nx == 0) | (ny == 0), 0.0).otherwise(s / F.sqrt(nx * ny)).alias("tau"), F.col("n").cast("long").alias("n"))


def perplexity(nll: Column | str, tokens: Column | str) -> Column:
    """AGG-18, 32: exp of summed loss over summed tokens; infinite without tokens."""
    return F.when(F.sum(tokens) <= 0, F.lit(float("inf"))).otherwise(F.exp(F.sum(nll) / F.sum(tokens)))


def drift(now: Column, before: Column, limit: float = 0.10) -> tuple[Column, Column]:
    """AGG-19: relative change, and whether it is within the limit."""
    change = (now - before) / before
    return change, F.abs(change) <= limit


def loss_by_position(df: DataFrame, losses: str, bins: int, *by: str) -> DataFrame:
    """AGG-20: mean loss by relative position; empty bins stay, with null."""
    n = F.size(losses)
    rows = df.select(*by, n.alias("n"), F.posexplode(losses).alias("k", "loss"))
    binned = rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("k") / F.col("n") * bins)).cast("int")).groupBy(*by, "bin").agg(F.avg("loss").alias("loss"))
    every = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if by else df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(binned, [*by, "bin"], "left")


def zipf(df: DataFrame, text_col: str = "text", top: int = 2000) -> DataFrame:
    """AGG-21: the most frequent tokens with their rank (a top-k report)."""
    best = T.vocabulary(df, text_col, r"\S+").orderBy(F.desc("n"), "token").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))


def histogram_overlap(df: DataFrame, value: str, side: str, left: str, right: str, bins: int = 15) -> DataFrame:
    """AGG-22: shared area of two histograms over joint equal bins; the last bin is closed."""
    ends = df.where(F.col(side).isin(left, right)).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.where(F.col(side).isin(left, right)).crossJoin(F.broadcast(ends))  # one row of two numbers
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.withColumn("bin", F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))))
    per = binned.groupBy("bin").agg(F.count(F.when(F.col(side) == left, 1)).alias("a"), F.count(F.when(F.col(side) == right, 1)).alias("b"))
    totals = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return per.crossJoin(F.broadcast(totals)).agg(F.sum(F.least(F.col("a") / F.greatest("ta", F.lit(1)), F.col("b") / F.greatest("tb", F.lit(1)))).alias("overlap"))


def log_fit(df: DataFrame, x: str, y: str, rank: str | None = None, skip: float = 0.1) -> DataFrame:
    """AGG-23: slope, intercept and R squared of ln y on ln x; the first tenth of the points (by rank) is left out."""
    if rank is not None:
        n = df.count()
        df = df.where(F.col(rank) > max(1, n // int(1 / skip)))
    a, b = F.log(x), F.log(y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def fit_errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """AGG-24: Pearson correlation and mean squared error."""
    return df.agg(F.corr(predicted, actual).alias("pearson"), F.avg((F.col(predicted) - F.col(actual)) ** 2).alias("mse"))


def spearman_ordinal(df: DataFrame, x: str, y: str, ord_col: str) -> DataFrame:
    """AGG-25: correlation of ordinal ranks; equals are ranked in order of ord_col."""
    from .ordered import ranked

    both = ranked(ranked(df.select(ord_col, x, y), [x, ord_col], "__rx"), [y, ord_col], "__ry")
    return both.agg(F.corr("__rx", "__ry").alias("spearman"), F.count("*").alias("n"))


def pair_accuracy(chosen: str, rejected: str) -> Column:
    """AGG-26."""
    return share(F.col(chosen) > F.col(rejected))


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """AGG-28: the value at place n // 2 in order (not a mean of two), with least, greatest and mean."""
    # percentile_disc picks the first value whose share reaches q, so q just above a half is place n // 2
    median = F.expr(f"percentile_disc(0.5000000000001D) WITHIN GROUP (ORDER BY {value})").cast(df.schema[value].dataType)
    return df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), median.alias("median"))


def criteria_means(df: DataFrame, model: str, criteria: list[str]) -> DataFrame:
    """AGG-29: mean of each criterion by model; blanks and text that is no number are skipped."""
    long = df.unpivot([model], criteria, "criterion", "value")
    return long.groupBy(model, "criterion").agg(F.avg(F.expr("try_cast(value AS double)")).alias("mean"))


def advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """SCR-10, WIN-04: reward less the group's mean, over its sample deviation; groups of one get zero."""
    w = Window.partitionBy(group)
    n, sd = F.count("*").over(w), F.stddev_samp(reward).over(w)
    return df.withColumn("advantage", F.when(n >= 2, (F.col(reward) - F.avg(reward).over(w)) / (sd + 1e-4)).otherwise(0.0))


def training_series(df: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """Section 2.13: the long table behind a chart, one row a step and metric."""
    return df.unpivot([step], metrics, "metric", "value")

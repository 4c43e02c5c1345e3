"""Deterministic sampling, splitting and quotas (SMP-*). Orders come from md5(seed|key), never from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import kept


def digest(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def uniform(seed: int | str, *keys: Column, n: int | None = None) -> Column:
    """A whole number from the first 32 bits of the digest, modulo n where given."""
    u = F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("long")
    return u if n is None else u % n


def lowest(df: DataFrame, seed: int | str, key: str, n: int, name: str = "chosen") -> DataFrame:
    """Marks the n rows of least (digest, key); keys are unique.

    The n-th row is found over keys alone: counts of digest prefixes (65536 at most) name the prefix in which it falls,
    and only that prefix's rows, a 65536th of all, are ordered. The rows themselves are then marked by one comparison.
    """
    mine = F.struct(digest(seed, F.col(key)).alias("d"), F.col(key).alias("k"))
    keys = df.select(mine.alias("m")).select("m.*").withColumn("p", F.substring("d", 1, 4)).persist()
    counts = {r["p"]: r["count"] for r in keys.groupBy("p").count().collect()}
    left, edge = n, None
    for p in sorted(counts):
        if counts[p] > left:
            edge = p
            break
        left -= counts[p]
    if edge is None:
        keys.unpersist()
        return df.withColumn(name, F.lit(True))
    last = keys.where(F.col("p") == edge).orderBy("d", "k").limit(left).agg(F.max(F.struct("d", "k")).alias("m")).first()["m"] if left else None
    keys.unpersist()
    d = digest(seed, F.col(key))
    chosen = F.substring(d, 1, 4) < edge
    if last is not None:
        chosen = chosen | (d < last["d"]) & (F.substring(d, 1, 4) == edge) | (d == last["d"]) & (F.col(key) <= F.lit(last["k"]))
    return df.withColumn(name, chosen)


def half_even(x: float) -> int:
    return round(x)


def split_train_valid(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """SMP-01: valid gets max(1, round(n * ratio)) rows."""
    df = kept(df)  # counted, searched and returned
    n = df.count()
    return lowest(df, seed, key, max(1, half_even(n * ratio)), "__v").withColumn("split", F.when(F.col("__v"), "valid").otherwise("train")).drop("__v")


def split_small(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """SMP-02: as SMP-01, but a fifth (one at least) of fewer than ten rows."""
    n = df.count()
    take = max(1, n // 5) if n < 10 else max(1, half_even(n * ratio))
    return lowest(df, seed, key, take, "__v").withColumn("split", F.when(F.col("__v"), "valid").otherwise("train")).drop("__v")


def split_three(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """SMP-03: a tenth each for val and test (one at least) of ten rows or more, else all train."""
    n = df.count()
    if n < 10:
        return df.withColumn("split", F.lit("train"))
    k = max(1, n // 10)
    both = lowest(lowest(df, seed, key, 2 * k, "__a"), seed, key, k, "__b")
    return both.withColumn("split", F.when(F.col("__b"), "val").when(F.col("__a"), "test").otherwise("train")).drop("__a", "__b")


def split_reward(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """SMP-04: val gets max(30, a tenth)."""
    return lowest(df, seed, key, max(30, df.count() // 10), "__v").withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__v")


def nested_sizes(df: DataFrame, key: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """SMP-05: one row per row and size it belongs to; smaller sets are subsets of larger ones."""
    marked = df
    for size in sizes:
        marked = lowest(marked, seed, key, size, f"__s{size}")
    which = F.array(*(F.when(F.col(f"__s{s}"), F.lit(s)) for s in sizes))
    out = marked.withColumn("size", F.explode(F.filter(which, lambda x: x.isNotNull())))
    return out.drop(*(f"__s{s}" for s in sizes))


def slot_dropout(df: DataFrame, key: str, slots: list[str], p: float = 0.3, p_all: float = 0.05, overrides: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """SMP-06: with probability p_all every slot is blank, else each with p or its own probability. Keys stay."""
    share = lambda q: F.lit(int(q * 2**32))
    every = uniform(f"{seed}|all", F.col(key)) < share(p_all)
    blank = {s: F.when(every | (uniform(f"{seed}|{s}", F.col(key)) < share((overrides or {}).get(s, p))), F.lit("")).otherwise(F.col(s)) for s in slots}
    return df.withColumns(blank)


def augment(seed_rows: DataFrame, pool: DataFrame, key: str, target: int, labels: list[str], seed: int = 42) -> DataFrame:
    """SMP-07: all seed rows, and as many of the pool as are missing to target, labelled in turn by their rank."""
    needed = max(0, target - seed_rows.count())
    chosen = lowest(pool, seed, key, needed).where("chosen").drop("chosen") if needed else pool.limit(0)
    turn = F.row_number().over(Window.orderBy(digest(seed, F.col(key)), key)) - 1  # needed rows, which is the target's size
    labelled = chosen.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), (turn % len(labels) + 1).cast("int")))
    return seed_rows.withColumn("label", F.lit(None).cast("string")).unionByName(labelled)


def combinations(dims: list[DataFrame], seed: int, n: int) -> DataFrame:
    """SMP-08: n distinct combinations of small dimension tables of one column, by digest."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(F.broadcast(d))  # word lists of a prompt generator
    return out.orderBy(digest(seed, *(F.col(c) for c in out.columns)), *out.columns).limit(n)


def batches(df: DataFrame, key: str, steps: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """SMP-09: for each step the size rows of least digest of (step, key), numbered k.

    Each step keeps size rows a partition and orders those alone; steps are those of one run, so a thousand at most.
    """
    wanted = [r["step"] for r in steps.select("step").distinct().orderBy("step").limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("draw batches for a thousand steps at a time")
    out = None
    for step in wanted:
        order = [digest(seed, F.lit(step), F.col(key)), F.col(key)]
        few = df.orderBy(*order).limit(size).withColumn("step", F.lit(step).cast(steps.schema["step"].dataType))
        few = few.withColumn("k", F.row_number().over(Window.orderBy(*order)))  # size rows
        out = few if out is None else out.unionByName(few)
    return df.limit(0).withColumns({"step": F.lit(None).cast(steps.schema["step"].dataType), "k": F.lit(1)}) if out is None else out

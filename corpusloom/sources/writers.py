"""Writers (SNK-*). Output is sharded; single files are for fixtures only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import stats


def jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """SNK-01."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """SNK-02: appends rows whose key is not there yet, so that a repeated call adds nothing."""
    from .readers import _exists

    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.schema(df.schema).json(path).select(*keys).distinct(), keys, "left_anti")
    row = F.struct(*df.columns)
    once = df.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("__row"))  # of rows with one key always the same
    once.select("__row.*").write.mode("append").json(path)


def manifest(df: DataFrame, split: str = "split", source: str = "source") -> DataFrame:
    """SNK-03: one row: totals by split and by source."""
    per = lambda c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    return df.agg(F.count("*").alias("total")).crossJoin(F.broadcast(per(split))).crossJoin(F.broadcast(per(source)))  # single rows


def dataset(df: DataFrame, path: str, split: str = "split", source: str = "source") -> None:
    """SNK-03: one folder a split, and the manifest."""
    df.write.mode("overwrite").partitionBy(split).json(f"{path}/data")
    manifest(df, split, source).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def filter_summary(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """SNK-04: reasons by (-count, name)."""
    return stats.reason_counts(df, reasons)


def report(df: DataFrame, source: str, words: str, score: str, reasons: str, top: int = 12) -> tuple[DataFrame, DataFrame]:
    """SNK-05: word and score figures by source, and each source's most frequent rejections."""
    from corpusloom.operators.ranking import top_per_group

    figures = df.groupBy(source).agg(F.count("*").alias("n"), F.min(words).alias("min_words"), F.max(words).alias("max_words"), F.avg(words).alias("avg_words"), F.avg(score).alias("avg_score"))
    rejected = df.select(source, F.explode(reasons).alias("reason")).groupBy(source, "reason").agg(F.count("*").alias("n"))
    return figures, top_per_group(rejected, source, [F.desc("n"), "reason"], top)


def markdown(df: DataFrame, limit: int = 10_000) -> str:
    """SNK-06: a small result as a table of text; one of more rows than limit is refused, never cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them as CSV or JSON lines")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *(line(r) for r in rows)])


def csv(df: DataFrame, fields: list[str], path: str) -> None:
    """SNK-07: a fixed order of fields; a byte-order mark opens the header's first name."""
    named = df.select(*(F.col(f).alias("\ufeff" + f if i == 0 else f) for i, f in enumerate(fields)))
    named.write.mode("overwrite").option("header", True).csv(path)


def sha_manifest(spark: SparkSession, path: str, skip: str = r"(?i)/(\.cache|__pycache__)/|readme") -> DataFrame:
    """SNK-09: path, bytes and SHA-256 of each file, caches and readme files left out. Order by path to print it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.col("path").rlike(skip)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def zip_folder(spark: SparkSession, path: str, archive: str) -> str:
    """SNK-08: a folder of finished files as one archive, for hand-outs: an archive is written by one process, so the driver
    takes the files one by one from the executors. Both paths may lie in any store that Spark reaches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").orderBy("path")
    target = spark._jvm.org.apache.hadoop.fs.Path(archive)
    out = spark._jvm.java.util.zip.ZipOutputStream(target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True))
    try:
        top = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
        for row in files.toLocalIterator():
            out.putNextEntry(spark._jvm.java.util.zip.ZipEntry(row["path"].partition(top)[2]))
            out.write(bytearray(row["content"]))
            out.closeEntry()
    finally:
        out.close()
    return archive


def sse(event: Column) -> Column:
    """SNK-10: a struct as a server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))

"""Shared plumbing: Arrow batches in, columns appended, shared storage for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Texts handed to one numpy step, in bytes; keeps a worker's arrays small whatever the row count.
SLICE_BYTES = 4 << 20


def bound_batches(spark: SparkSession, max_bytes: int = 16 << 20) -> None:
    """Arrow batches by bytes, as rows may be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    try:
        low = now is not None and 0 < int(str(now).rstrip("bB")) <= max_bytes
    except ValueError:
        low = False
    if not low:
        spark.conf.set(key, str(max_bytes))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of rows whose texts stay under limit, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as it takes to clash with none of names."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list], list[pa.Array]]],
    fields: list[StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds the columns that make()(texts) returns, one array a field; make() runs once a task.

    keep: input columns to carry (all by default). An input column with the name of a new one gives way.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    schema = StructType(kept + fields)
    names = [f.name for f in kept]
    src = text_col if text_col in names else unused(names, "text")[0]
    frame = df.select(*[df[n] for n in names], *([df[text_col].alias(src)] if src not in names else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(src))
            for at, n in slices(text):
                part = batch.slice(at, n)
                arrays = compute(text.slice(at, n).to_pylist())
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(cols + arrays, names=names + [f.name for f in fields])

    return frame.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a temporary one if driver and
    executors are one process, as in tests; else an error, as executors do not see each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Has the file system remove path when the application ends; until then results may still read it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    drop_at_end(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes settled tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a Bloom filter at most (8 MB).
BLOOM_BITS = 1 << 26


def part_by_members(df: DataFrame, key: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows whose key may be among members (one column of keys of the same type), and those whose key is not.

    Long rows of the second kind then need no shuffle for a join with members. A Bloom filter decides: ten bits a member, no
    more than BLOOM_BITS; beyond that more rows are of the first kind, and none is lost. Its words, as few, are combined on
    the executors and sent back as a scalar subquery, so that rows are told apart inside the JVM.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    bits = min(BLOOM_BITS, max(1 << 12, 1 << (10 * members.count()).bit_length()))
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in range(4)]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    filled = members.select(F.explode(F.array(*places(F.col(members.columns[0])))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("v"))
    words = [0] * (bits // 64)
    for r in filled.toLocalIterator():
        words[r["w"]] = r["v"]
    body = spark.createDataFrame([(words,)], "words array<long>").scalar()
    flag = unused(df.columns, "possible")[0]
    marked = df.withColumn(flag, reduce(Column.__and__, (F.getbit(F.get(body, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(key))))
    return marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are out of use."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column, modulus: int):
    """crc32 of a key's text, modulo: the rule that sets rows aside for judging."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))

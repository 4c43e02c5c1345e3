"""Operator 10, document fingerprints by order MinHash.

Every k-mer of a text is numbered by its occurrence (the second "abc" differs from the first), hashed, and dealt by its
hash into ``COMPONENTS`` bins. Of each bin the ``TUPLE`` least hashes are selected, put back into the order in which they
stand in the text, and hashed as a tuple: one 32-bit component of the fingerprint. Two texts agree in a component if
they share its minimal k-mers in the same order, so the share of equal components falls with their edit distance, also
where a rearrangement leaves the set of k-mers as it was. A bin with fewer k-mers takes what it has, an empty bin
repeats the next filled one with its own number hashed in, and short texts count as a single k-mer.

The query also edits each text with the head of the next document in descending order of id. Documents are dealt into
ranges of ids, each range is read in order once, and the first document of a range is also sent to the range before, so
neither texts nor ids meet in one place.

Defined results: null counts as empty; an empty text has the fingerprint of the empty k-mer; equal texts have equal
fingerprints; rows with the same id follow in order of their text, repeated rows one another; null ids come last; a single
row is its own next; an empty table gives no rows. Ids are whole numbers of up to 64 bits. A text of any length is one
sketch, in memory of some tens of bytes a character. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import append_columns, bound_batches

KMER, COMPONENTS, TUPLE = 10, 64, 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every run of k points, by doubling."""
    base, out, done = 0x9E3779B97F4A7C15, points + np.uint64(1), 1
    for bit in bin(k)[3:]:
        out, done = out[:-done] * np.uint64(pow(base, done, 2**64)) + out[done:], 2 * done
        if bit == "1":
            out, done = out[:-1] * np.uint64(base) + (points[done:] + np.uint64(1)), done + 1
    return out


def sketch(text: str, k: int = KMER, components: int = COMPONENTS, size: int = TUPLE) -> np.ndarray:
    """The components, as unsigned 32-bit numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < k:
        points = np.concatenate([points, np.full(k - len(points), 0x110000, np.uint64)])
    n = len(points) - k + 1
    grams = rolling(points, k)
    # number equal k-mers by occurrence
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    hashes = mix(grams)
    if same.any():
        again = np.concatenate([[False], same])
        several = again | np.concatenate([same, [False]])
        run = np.cumsum(~again[several])
        places = order[several]
        places = places[np.argsort(run * n + places)]  # within a run by place
        times = np.arange(len(run)) - np.flatnonzero(~again[several])[run - 1]
        hashes[places] = mix(hashes[places] + times.astype(np.uint64))
    # few hashes can be selected: those below a bound that leaves every bin enough, else all
    chosen = np.arange(n)
    if n > 64 * components * size:
        few = np.flatnonzero(hashes < np.uint64(2**64 // n * 24 * components * size))
        if (np.bincount((hashes[few] % np.uint64(components)).astype(np.int64), minlength=components) >= size).all():
            chosen = few
    own = hashes[chosen]
    bins = (own % np.uint64(components)).astype(np.int64)
    by = np.lexsort((own, bins))
    bins = bins[by]
    first = np.searchsorted(bins, np.arange(components))
    count = np.searchsorted(bins, np.arange(components), side="right") - first
    out = np.zeros(components, np.uint64)
    filled = count > 0
    pick = np.full((components, size), -1, np.int64)
    for j in range(size):
        has = count > j
        pick[has, j] = by[first[has] + j]
    # back to text order; missing ones stand first and hash as zero
    place = np.where(pick >= 0, chosen[np.maximum(pick, 0)], -1)
    pick = np.take_along_axis(pick, np.argsort(place, axis=1), axis=1)
    for j in range(size):
        out = mix(out * np.uint64(31) + np.where(pick[:, j] >= 0, own[np.maximum(pick[:, j], 0)], np.uint64(0)) + np.uint64(j + 1))
    empty = np.flatnonzero(~filled)
    if len(empty):
        full = np.flatnonzero(filled)
        source = full[np.searchsorted(full, empty) % len(full)]
        out[empty] = mix(out[source] + (empty + 1).astype(np.uint64))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every whole text: eight hex digits a component."""
    return append_columns(docs, text_col, lambda: lambda texts: [pa.array([sketch(t or "").astype(">u4").tobytes().hex() for t in texts])], [StructField(name, StringType())], keep)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many characters of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def own_partitions(spark, count: int) -> list[int]:
    """For each of count partitions a number that Spark's hash partitioning deals to it, so that a range of rows fills a
    partition of its own. Found among a few times as many small numbers, which are hashed on the executors."""
    tried, found = 0, {}
    while len(found) < count:
        more = count * (len(bin(count)) + 4)
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(count)).alias("at")
        for r in spark.range(tried, tried + more).groupBy(at).agg(F.min("id").alias("id")).collect():  # a row a partition
            found.setdefault(r["at"], r["id"])
        tried += more
    return [found[i] for i in range(count)]


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / ranges for i in range(1, ranges)]
    marks = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), F.lit(max(10_000, 4 * ranges)))).first()[0] if cuts else None
    marks = sorted(set(marks or []), reverse=True)  # one id a range
    # range 0 holds the largest ids, a null id goes to the last range; a range's number, how many marks lie above the id, is
    # found by halving
    part = F.lit(0)
    if marks:
        above, steps = F.array(*map(F.lit, marks)), [1 << k for k in reversed(range(len(marks).bit_length()))]
        further = lambda at, step: F.when((at + step <= len(marks)) & (F.element_at(above, F.least(at + step, F.lit(len(marks)))) > F.col("doc_id")), at + step).otherwise(at)
        part = F.when(F.col("doc_id").isNull(), len(marks)).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further))
    dealt = rows.withColumn("part", part.cast("int"))
    heads = {r["part"]: r["top"] for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a row a range
    if not heads:
        return _result(rows.limit(0).select("doc_id").withColumn("part", F.lit(0)), docs, id_col)
    filled = sorted(heads)
    before = {b: a for a, b in zip(filled, filled[1:], strict=False)}
    before[filled[0]] = filled[-1]  # after the last comes the first
    of_range = lambda values, kind: F.element_at(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("part") + 1)
    count = filled[-1] + 1
    # the head of a range also goes to the end of the range before it
    is_head = F.col("doc_id").eqNullSafe(of_range([heads.get(i) for i in range(count)], "long"))
    here, there = F.struct(F.col("part").alias("p"), F.lit(0).alias("ghost")), F.struct(of_range([before.get(i) for i in range(count)], "int").alias("p"), F.lit(1).alias("ghost"))
    sent = dealt.withColumn("t", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))).select("doc_id", "text", F.col("t.p").alias("part"), F.col("t.ghost").alias("ghost"))
    sent = sent.withColumn("seat", of_range(own_partitions(spark, max(ranges, count))[:count], "int"))
    sent = sent.repartition(max(ranges, count), "seat").drop("seat").sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text")
    return _result(sent, docs, id_col)


def _result(sent: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])
    if "text" not in sent.columns:
        return sent.sparkSession.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in batches:
            out: list[list] = [[] for _ in schema.fields]
            for key, text, part, ghost in zip(*(batch.column(i) for i in (0, 1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held is not None and held[2] == part and held[3] == 1:
                    continue  # further rows of the next range's first id
                text, key = text.as_py(), key.as_py()
                own = sketch(text)
                if held is not None and held[2] == part:
                    changed = edited(held[1], text)
                    theirs = sketch(changed)
                    hexes = [s.astype(">u4").tobytes().hex() for s in (held[4], theirs)]
                    for column, value in zip(out, (held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), *hexes, likeness(held[4], theirs), likeness(held[4], own)), strict=True):
                        column.append(value)
                held = (key, text, part, ghost, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if i < 2 else pa.array(c, pa.string()) if i < 5 else pa.array(c, pa.float64()) for i, c in enumerate(out)], names=schema.fieldNames())

    return sent.mapInArrow(run, schema)

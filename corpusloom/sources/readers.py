"""Readers (SRC-*). Schemas are stated, never inferred; ordered tables carry ``ord``."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SSE = "type string, content string, step string, message string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """SRC-01 (missing_ok: an absent path is an empty table), SRC-02, SRC-05 (several paths are one table).

    Blank lines are skipped; broken ones become nulls.
    """
    paths = [path] if isinstance(path, str) else path
    if missing_ok:
        paths = [p for p in paths if _exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(paths)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-10: one JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_with_bom(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-11: header line, byte-order mark tolerated (Spark's reader drops it)."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)


def stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    """SRC-03: the same rows as a stream of files; stop by trigger(availableNow=True) or an order cut-off."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def held_out(text: Column, cond_len: Column) -> dict[str, Column]:
    """SRC-12: the prompt before the separator, and the reference between separator and end."""
    return {
        "prompt": F.regexp_replace(F.substring(text, F.lit(1), cond_len), r"\n+$", ""),
        "reference": F.regexp_extract(text, r"(?s)<\|story\|>(.*?)(?:<\|end\|>|$)", 1),
    }


def env_map(lines: Column) -> Column:
    """SRC-14: KEY=value lines of an array as a map: comments, blanks and lines without = are skipped, quotes dropped,
    the first mapping of a key stays."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.transform(lines, strip), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    pairs = F.transform(kept, lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(strip(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("v")))
    first = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(first)


def sse_frames(body: Column, schema: str = SSE) -> Column:
    """SRC-15: the events of a server-sent stream: lines that start with "data: " and hold JSON."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("data: "))
    return F.filter(F.transform(lines, lambda x: F.from_json(F.substring(x, F.lit(7), F.length(x)), schema)), lambda e: e.isNotNull())


def ndjson_text(body: Column) -> Column:
    """SRC-16: the pieces of a chunked reply up to the one that says done, joined."""
    chunks = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "message struct<content:string>, done boolean"))
    last = F.array_min(F.filter(F.transform(chunks, lambda c, i: F.when(F.coalesce(c["done"], F.lit(False)), i + 1)), lambda i: i.isNotNull()))
    kept = F.slice(chunks, 1, F.coalesce(last, F.size(chunks)))
    return F.array_join(F.transform(kept, lambda c: F.coalesce(c["message"]["content"], F.lit(""))), "")


def spine(archive: bytes) -> list[tuple[int, str]]:
    """Pages of an EPUB in reading order."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        read = lambda name: z.read(name).decode("utf-8", "replace")
        found = re.search(r'full-path="([^"]+)"', read("META-INF/container.xml"))
        if not found:
            return []
        package = found.group(1)
        home, listing, names = package.rpartition("/")[0], read(package), set(z.namelist())
        items = {}
        for tag in re.findall(r"<item\b[^>]*>", listing, re.I):
            key, href = re.search(r'\bid="([^"]+)"', tag), re.search(r'\bhref="([^"]+)"', tag)
            if key and href:
                items[key.group(1)] = href.group(1)
        block = re.search(r"<spine\b[^>]*>(.*?)</spine>", listing, re.I | re.S)
        order = re.findall(r'<itemref\b[^>]*\bidref="([^"]+)"', block.group(1) if block else listing, re.I)
        paths = [f"{home}/{items[i]}" if home else items[i] for i in order if i in items]
        return [(n, read(p)) for n, p in enumerate(paths) if p in names]


def epub(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: source, spine_ord, html: one row a page of every archive of a folder."""
    return epub_pages(spark.read.format("binaryFile").load(path))


def epub_pages(files: DataFrame) -> DataFrame:
    """SRC-06 on archives in a table (path, content): a Python worker opens them; what is no archive has no pages."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = spine(bytes(content))
                except (zipfile.BadZipFile, KeyError):
                    rows = []  # no archive: no pages
                if rows:
                    yield pd.DataFrame({"source": [source.rpartition("/")[2]] * len(rows), "spine_ord": np.array([n for n, _ in rows], "int32"), "html": [h for _, h in rows]})

    return files.select("path", "content").mapInPandas(run, "source string, spine_ord int, html string")


def page_folder(spark: SparkSession, path: str, skip: list[str] | None = None) -> DataFrame:
    """SRC-08: unpacked pages of a folder of books."""
    files = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("source"), F.col("value").alias("html"))
    return in_spine_order(files, skip)


def in_spine_order(files: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """SRC-08: source, spine_ord, html: the pages of each book in order of their names; names in skip are left out."""
    from pyspark.sql import Window

    if skip:
        files = files.where(~F.col("name").isin(skip))
    return files.withColumn("spine_ord", F.row_number().over(Window.partitionBy("source").orderBy("name")) - 1).select("source", "spine_ord", "html")


def anchor_sections(page: Column, separator: str) -> Column:
    """SRC-09: what follows each separator of a single-page book; what stands before the first goes."""
    parts = F.split(page, separator, -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: models as a small table."""
    return spark.read.schema("id string, name string, ollama string, kind string, `desc` string").option("multiLine", True).json(path)

"""Operator 9, language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (one to three, words bounded by spaces) in order. A document's
own ``TOP`` n-grams are compared to each profile by out-of-place distance: how far each stands from its place in the
profile, ``TOP`` where it is missing. The nearest profile wins.

Profiles are counted on the executors over a hash sample of about ``PER_LANGUAGE`` documents a language; every whole
document is compared.

Defined results: text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
learned; ties between languages go to the first in alphabetical order; score is 1 less the ratio of the nearest to the
second distance (1 for a single profile).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import append_columns, bound_batches

TOP, PER_LANGUAGE = 400, 1000
SPACE = np.int64(32)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray | None:
    """Codes of all one- to three-letter n-grams, three 21-bit code points a code; None without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[points]
    if not letters.any():
        return None
    points = np.concatenate([[SPACE], np.where(letters, points, SPACE), [SPACE]]).astype(np.int64)
    blank = points == SPACE
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    one = points[keep]
    two = one[:-1] << 21 | one[1:]
    return np.concatenate([one[one != SPACE], two, two[:-1] << 21 | one[2:]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.diff(np.concatenate([at, [len(codes)]]))


def most_frequent(codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The top distinct codes, most frequent first, equals by code."""
    values, counts = counted(codes)
    return values[np.argsort(-counts, kind="stable")[:top]]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", top: int = TOP, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles of the languages in lang_col, as code arrays in order of frequency. Rows with a null are left out."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return {}
    rate = F.element_at(F.map_from_arrays(F.array(*map(F.lit, sizes)), F.array(*(F.lit(min(1.0, per_language / n)) for n in sizes.values()))), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "text")

    def count(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (codes := grams(text)) is not None:
                    values, counts = counted(codes)
                    total.setdefault(lang, []).append(pd.Series(counts, values))
                    if len(total[lang]) >= 200:
                        joined = pd.concat(total[lang])
                        total[lang] = [joined.groupby(level=0).sum()]
        for lang, parts in total.items():
            joined = pd.concat(parts).groupby(level=0).sum()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(joined), pa.string()), pa.array(joined.index.to_numpy(), pa.int64()), pa.array(joined.to_numpy(), pa.int64())], names=["lang", "code", "n"])

    ranked = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("k") <= top)
    found = ranked.select("lang", "code", "k").collect()  # top rows a language
    return {lang: np.array([r["code"] for r in sorted((r for r in found if r["lang"] == lang), key=lambda r: r["k"])], np.int64) for lang in sorted({r["lang"] for r in found})}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.places[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text)
        if codes is None or not self.names:
            return "und", 0.0
        own = most_frequent(codes, self.top)
        at = np.searchsorted(self.codes, own)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == own[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        places = self.places[at]
        distance = np.where(places < 0, self.top, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        if len(distance) == 1:
            return self.names[0], 1.0
        second = float(np.partition(distance, 1)[1])
        return self.names[best], 1.0 - float(distance[best]) / second if second else 0.0


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, top: int = TOP) -> DataFrame:
    """Adds lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # top codes a language

    def make():
        tool = Profiles(shared.value, top)

        def compute(texts: list) -> list[pa.Array]:
            out = [tool.predict(t) for t in texts]
            return [pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())]

        return compute

    return append_columns(docs, text_col, make, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], keep)

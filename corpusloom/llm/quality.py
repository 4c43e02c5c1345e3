"""Operator 4, quality: a compression classifier.

Two zstandard dictionaries are trained, on excerpts of good and of bad labelled text. A text is cut into short blocks, each
block is compressed once with either dictionary, and the difference of the two summed sizes, normalised by their own sum and
by the text's length, becomes a score by logistic calibration on labelled texts that are in neither dictionary. The
calibration is conditioned on length, as a short text's difference is less sure.

Training reads bounded samples, taken by a hash of the document id, which also deals half of the labelled documents to the
dictionaries and half to the calibration: of ``EXCERPTS`` texts per class up to ``PIECES`` excerpts of ``EXCERPT`` characters
each, spread evenly over the whole text, fill a sample of ``SAMPLE`` bytes one of each text in turn; and ``CALIBRATED`` whole
texts per class (their sizes are taken on the executors; the driver gets a few numbers a text). The sampled texts are written
once and read from there. Scores are computed for every whole text.

Defined results: a null text counts as empty, an empty text is scored like any other by its (zero) sizes; labels that
are null or not 0 or 1 are ignored, and of several labels of an id the higher counts; where an id has several texts, the
least of them is learned from; without labels of both classes, or with too few for a dictionary, every score is 0.5;
repeated rows get the same score; a text of any length is compressed block by block; an empty table gives no rows; an input
column with the score's name gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import append_columns, settle

EXCERPTS, EXCERPT, PIECES, CALIBRATED = 400, 400, 16, 2500
DICTIONARY, BLOCK, LEVEL, LEAST_PULL = 1 << 15, 256, 3, 0.1
SAMPLE = 8 * DICTIONARY
_SIZES = ["good_size", "bad_size", "raw_size"]
_compressors: dict[tuple[bytes, bytes], list] = {}


def sampled(labels: DataFrame, label: str, per_class: int, salt: int, id_col: str = "doc_id") -> DataFrame:
    """At most per_class labelled ids of each class, by hash of the id: the same rows at any partitioning."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    parts = [marked.where(F.col("__y") == y).orderBy(F.xxhash64("__id", F.lit(salt)), "__id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def dictionary(texts: list[list[str]], size: int = DICTIONARY, sample: int = SAMPLE) -> bytes:
    """A zstandard dictionary trained on the texts' excerpts, taken one of each text in turn; where there are too few to
    train on, the excerpts themselves."""
    import zstandard as Z

    pieces, total = [], 0
    for turn in range(max(map(len, texts), default=0)):
        for cuts in texts:
            if turn < len(cuts) and total < sample:
                pieces.append(cuts[turn].encode())
                total += len(pieces[-1])
    try:
        return Z.train_dictionary(size, pieces).as_bytes()
    except Z.ZstdError:
        return b"\n".join(pieces)[:size]


def compressors(good: bytes, bad: bytes) -> list:
    import zstandard as Z

    if (good, bad) not in _compressors:
        out = []
        for content in (good, bad):
            d = Z.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            out.append(Z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors.clear()
        _compressors[good, bad] = out
    return _compressors[good, bad]


def sizes(text: str | None, tools: list) -> tuple[int, int, int]:
    """Sizes of the text's blocks under either dictionary, and of the text."""
    raw = (text or "").encode()
    good, bad = (t.compress for t in tools)
    a = b = 0
    for i in range(0, max(1, len(raw)), BLOCK):
        piece = raw[i : i + BLOCK]
        a += len(good(piece))
        b += len(bad(piece))
    return a, b, len(raw)


def features(table: np.ndarray) -> np.ndarray:
    """From the sizes: the difference over the sizes' sum and over the length, either also times log length, and log length."""
    good, bad, n = np.asarray(table, float).reshape(-1, 3).T
    length = np.log(n + 16)
    own, whole = (bad - good) / (bad + good + 64), (bad - good) / (n + 64)
    return np.stack([own, whole, own * length, whole * length, length], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, prior: np.ndarray | None = None, rounds: int = 40, least: float = 0.05, free: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method, pulled towards prior by ridge * rows + least: (mean, scale, weights). Without a prior the columns
    are standardised; free: the intercept is not pulled."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if prior is None else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    prior = np.zeros(z.shape[1]) if prior is None else prior
    w, pull = prior.copy(), np.full(z.shape[1], ridge * len(y) + least)
    if free:
        pull[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        t = z @ v
        return float(np.logaddexp(0, t).sum() - y @ t + (pull / 2 * (v - prior) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * (w - prior))
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-6:  # a full step may overshoot where classes part well
            size /= 2
        if then > now - 1e-9 * abs(now):
            break
        w, now = w + size * step, then
    return mean, scale, w


def logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Written once: __id, the columns of chosen, and __text, the least one that is not empty. chosen: __id and a bounded
    number of rows."""
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("length(__text) > 0")
    others = [c for c in chosen.columns if c != "__id"]
    found = text.join(F.broadcast(chosen), "__id").groupBy("__id").agg(*(F.max(c).alias(c) for c in others), F.min("__text").alias("__text"))
    return settle(found, name)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", excerpts: int = EXCERPTS, calibrated: int = CALIBRATED) -> dict | None:
    """Dictionaries and calibration from rows of labels; None where a class has no labelled text."""
    from pyspark.sql.types import LongType

    for_dictionary = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(2)) == 0
    chosen = sampled(labels.where(for_dictionary), label, excerpts, 1, id_col).withColumn("__use", F.lit(0))
    chosen = chosen.unionByName(sampled(labels.where(~for_dictionary), label, calibrated, 2, id_col).withColumn("__use", F.lit(1)))
    known = labelled_texts(docs, chosen, id_col, text_col, "quality")
    pieces = F.greatest(F.lit(1), F.ceil(F.length("__text") / EXCERPT))
    many = F.least(pieces, F.lit(PIECES))
    cuts = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring("__text", (F.floor((i + 0.5) * pieces / many) * EXCERPT + 1).cast("int"), F.lit(EXCERPT)))
    rows = known.where("__use = 0").select("__id", "__y", cuts.alias("cuts")).collect()  # 2 * EXCERPTS rows at most
    rows.sort(key=lambda r: r["__id"])
    kinds = [dictionary([r["cuts"] for r in rows if r["__y"] == y]) for y in (1, 0)]
    if not all(kinds):
        return None
    good, bad = kinds
    fields = [StructField(n, LongType()) for n in _SIZES]

    def make():
        tools = compressors(good, bad)
        return lambda texts: [pa.array(c, pa.int64()) for c in np.array([sizes(t, tools) for t in texts], np.int64).reshape(-1, 3).T]

    seen = append_columns(known.where("__use = 1"), "__text", make, fields, keep=["__id", "__y"]).collect()  # 2 * CALIBRATED rows of a few numbers
    seen.sort(key=lambda r: r["__id"])
    y = np.array([r["__y"] for r in seen], float)
    if len(set(y)) < 2:
        return None
    table = np.array([[r[n] for n in _SIZES] for r in seen])
    return {"good": good, "bad": bad, "model": fit_logistic(features(table), y, least=LEAST_PULL, free=True)}


def score(docs: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the score of every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most and a few numbers

    def make():
        m = shared.value
        if m is None:
            return lambda texts: [pa.array([0.5] * len(texts), pa.float64())]
        tools = compressors(m["good"], m["bad"])
        return lambda texts: [pa.array(logistic(features(np.array([sizes(t, tools) for t in texts])), m["model"]), pa.float64())]

    return append_columns(docs, text_col, make, [StructField(name, DoubleType())], keep)

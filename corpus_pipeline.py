"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

quality -> toxicity -> SimHash near-dedup -> suffix-array dedup -> packing. All but the last return the columns of
documents; the last returns the pieces of packed sequences. Models are trained on the rows a stage is given, with the
labels of the same folder.

Defined results: a null or empty text is scored like any other; it is one near-duplicate group with the others, of which the
smallest id stays; rows equal in id and text are copies, of which one stays; rows with a null id stay as far as their texts
do; an empty table gives no rows; texts of any length are read whole; columns beyond those of documents are carried along,
whatever their names, and none is overwritten but text and n_chars, which follow the cuts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import packing, quality, queries, simhash, suffix_dedup, toxicity
from corpusloom.llm.common import drop_at_end, shared_dir, unused

#: The stages run trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None
#: Jaccard similarity from which documents are near duplicates.
NEAR = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model, [score] = quality.train(docs, queries.learnable(spark, sf_dir, 5, 0)), unused(docs.columns, "score")
    return quality.score(docs, model, name=score).where(F.col(score) >= queries.QUALITY_FROM).select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    model, [score] = toxicity.train(docs, queries.learnable(spark, sf_dir, 3, 1)), unused(docs.columns, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < queries.TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.deduplicate(docs, size=simhash.WIDE_SHINGLE, similarity=NEAR).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; the first copy stays. n_chars follows the text."""
    cut = suffix_dedup.strip_repeats(docs, keep="first")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(queries.PACK_VOCABULARY))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; those between are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    *before, (_, last) = STAGES
    for i, (name, stage) in enumerate(before):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}-{name}")
        docs = spark.read.parquet(f"{home}/{i}-{name}")
    drop_at_end(spark, home)
    return last(spark, docs, sf_dir)

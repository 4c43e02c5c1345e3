"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.base import spread

#: Tokenizer files are found by name in the installed package, on the driver and on every executor.
PACK_VOCABULARY = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df  # tables of texts


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(PACK_VOCABULARY))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import default_field, extract

    return extract(_read(spark, sf_dir, "pages"), default_field(), keep=["page_id", "url"])


def learnable(spark: SparkSession, sf_dir: str, modulus: int, aside: int, table: str = "labels") -> DataFrame:
    """Rows that may be learned from: those whose id's checksum does not set them aside."""
    from .common import crc_mod

    return _read(spark, sf_dir, table).where(crc_mod(F.col("doc_id"), modulus) != aside)


def _held_out(modulus: int, aside: int):
    from .common import crc_mod

    return F.coalesce(crc_mod(F.col("doc_id"), modulus) == aside, F.lit(False)).alias("held_out")


QUALITY_FROM, TOXIC_FROM = 0.3, 0.7


def quality_model(spark: SparkSession, sf_dir: str):
    from . import quality

    return quality.train(_read(spark, sf_dir, "documents"), learnable(spark, sf_dir, 5, 0))


def toxicity_model(spark: SparkSession, sf_dir: str):
    from . import toxicity

    return toxicity.train(_read(spark, sf_dir, "documents"), learnable(spark, sf_dir, 3, 1))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    scored = quality.score(_read(spark, sf_dir, "documents"), quality_model(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import strip_repeats

    return strip_repeats(_read(spark, sf_dir, "documents"), keep="none", digest=True, columns=["doc_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    scored = toxicity.score(_read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    found = components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import album, copies

    return copies(album(_read(spark, sf_dir, "embeddings")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _read(spark, sf_dir, "documents")
    named = langid.predict(docs, langid.train(learnable(spark, sf_dir, 4, 2, "documents")), keep=["doc_id"])
    return named.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edit_sensitivity

    return edit_sensitivity(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_html_extract": op3_html_extract,
        "op4_quality": op4_quality,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_simhash": op7_simhash,
        "op8_media_copies": op8_media_copies,
        "op9_language": op9_language,
        "op10_order_minhash": op10_order_minhash,
    }


def oracle_sql() -> dict[str, str]:
    """Operators whose rows SQL can express."""
    return {}

"""Model calls as injected functions (UDF-01 to 03, 05): nothing here reaches a network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def generator(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """UDF-01: fn(prompt) -> text as a column function; null prompts stay null."""

    @F.pandas_udf(StringType())
    def call(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return call


def translator(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """UDF-05: fn(text) -> text in another language; blank texts are not sent, and a text that fn fails on stays as it is."""

    def one(text: str) -> str:
        if not text.strip():
            return text
        try:
            return fn(text)
        except Exception:  # noqa: BLE001  whatever an injected call raises
            return text

    return generator(one)


def judge(df: DataFrame, prompt: str, story: str, fn: Callable[[str, str], str], attempts: int = 8, wait: float = 0.05, longest: float = 10.0) -> DataFrame:
    """UDF-02, 03: adds raw (what fn(story, prompt) said) and status; a call that fails attempts times is an error row.

    After a failure it waits, twice as long each time, longest seconds at most.
    """
    schema = StructType([*df.schema.fields, StructField("raw", StringType()), StructField("status", StringType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, status = [], []
            for p, s in zip(batch[prompt], batch[story], strict=True):
                for left in reversed(range(attempts)):
                    try:
                        raw.append(fn(s, p))
                        status.append("success")
                        break
                    except Exception:  # noqa: BLE001  whatever an injected call raises
                        if not left:
                            raw.append(None)
                            status.append("error")
                        else:
                            time.sleep(min(longest, wait * 2 ** (attempts - 1 - left)))
            yield batch.assign(raw=raw, status=status)

    return df.mapInPandas(run, schema)

"""Registry of queries with their SQL twins, the tables they read, and SQL fragments for the twins (DuckDB's dialect)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query (spark, sf_dir) -> DataFrame; sql gives the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages", "conversations") else df  # tables of texts


def spread(df: DataFrame, small: int = 16 << 20) -> DataFrame:
    """df over all cores, if it is so small that a row group or two would keep a single core busy: less than small bytes a
    core by the optimizer's estimate, which is that of the files. Larger tables stay as their files deal them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small * cores else df


def num(c: Column, digits: int = 6) -> Column:
    """Doubles are compared after rounding: sums depend on their order in the last bits."""
    return F.round(c.cast("double"), digits)


# stories: documents dressed as stories with slots, in six forms of moral; SQL twin beside it


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text, six = read(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id") % 6
    end = lambda s: F.concat(text, F.lit(s))
    story = (
        F.when(six == 0, end("\n\nMoral: kindness matters."))
        .when(six == 1, F.concat(F.lit("Moral: early.\n"), text))
        .when(six == 2, end("\n\n- a point\nMoral: Share what you have"))
        .when(six == 3, end("\n\nMoral:\n"))
        .when(six == 4, text)
        .otherwise(F.concat(F.lit("The "), F.col("source"), F.lit(" lived in a "), F.col("lang"), F.lit(" village. "), text, F.lit("\n\nMoral: Kindness matters!")))
    )
    return d.select(
        "doc_id", "lang", "source", F.col("source").alias("character"), F.concat("lang", F.lit(" village")).alias("setting"), F.lit("kindness matters").alias("teaching"), story.alias("story"),
        F.concat(F.lit("Character: "), "source", F.lit("\nSetting: "), "lang", F.lit(" village"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("\nTeaching: kindness matters")).alias("input"),
    )


STORIES = """stories AS (
  SELECT doc_id, lang, source, source AS character, lang || ' village' AS setting, 'kindness matters' AS teaching,
    CASE doc_id % 6
      WHEN 0 THEN text || E'\\n\\nMoral: kindness matters.'
      WHEN 1 THEN E'Moral: early.\\n' || text
      WHEN 2 THEN text || E'\\n\\n- a point\\nMoral: Share what you have'
      WHEN 3 THEN text || E'\\n\\nMoral:\\n'
      WHEN 4 THEN text
      ELSE 'The ' || source || ' lived in a ' || lang || ' village. ' || text || E'\\n\\nMoral: Kindness matters!' END AS story,
    'Character: ' || source || E'\\nSetting: ' || lang || ' village' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE E'\\nTeaching: kindness matters' END AS input
  FROM documents)"""


class Q:
    """SQL fragments."""

    NL = "chr(10)"
    MORAL_LINE = r"(?im)^\s*Moral\s*:\s*(.*)$"

    @staticmethod
    def sub(x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    @staticmethod
    def strip(x: str) -> str:
        return Q.sub(x, r"^\s+|\s+$")

    @staticmethod
    def rstrip(x: str) -> str:
        return Q.sub(x, r"\s+$")

    @staticmethod
    def collapse(x: str) -> str:
        return Q.strip(Q.sub(x, r"\s+", " "))

    @staticmethod
    def unescape(x: str) -> str:
        for a, b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
            x = f"replace({x}, '{a}', {b})"
        return x

    @staticmethod
    def clean(x: str) -> str:
        """TXT-01. White space here includes the no-break space that a reference may leave."""
        return Q.collapse(f"replace({Q.unescape(x)}, chr(160), ' ')")

    @staticmethod
    def found(x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    @staticmethod
    def words(x: str) -> str:
        return Q.found(x, "[A-Za-z'']+")

    @staticmethod
    def words2(x: str) -> str:
        return Q.found(x, "[A-Za-z]+(?:''[A-Za-z]+)?")

    @staticmethod
    def normalized(x: str) -> str:
        return f"list_transform({Q.words(x)}, lambda w: trim(lower(w), ''''))"

    @staticmethod
    def content(x: str) -> str:
        from corpusloom.functions.text import STOP_WORDS

        stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
        return f"list_distinct(list_filter({Q.normalized(x)}, lambda w: length(w) > 2 AND NOT list_contains([{stop}], w)))"

    @staticmethod
    def tokens(x: str) -> str:
        return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"

    @staticmethod
    def sentences(x: str, stops: str = ".!?") -> str:
        cut = f"string_split(regexp_replace({x}, '([{stops}])\\s+', '\\1' || chr(1), 'g'), chr(1))"
        return f"list_filter(list_transform({cut}, lambda s: {Q.strip('s')}), lambda s: s <> '')"

    @staticmethod
    def lines(x: str) -> str:
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {Q.strip('s')}), lambda s: s <> '')"

    @staticmethod
    def paragraphs(x: str) -> str:
        return f"list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda s: {Q.strip('s')}), lambda s: s <> '')"

    @staticmethod
    def lengths(parts: str, second: bool = False) -> str:
        return f"list_transform({parts}, lambda s: len({(Q.words2 if second else Q.words)('s')}))"

    @staticmethod
    def longest(lengths: str) -> str:
        return f"coalesce(list_max({lengths}), 0)"

    @staticmethod
    def word(x: str, choices: str) -> str:
        """Whole words, by Unicode letters, any case."""
        return rf"regexp_matches({x}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{choices})(?:$|[^\p{{L}}\p{{N}}_])')"

    @staticmethod
    def last_is_moral(x: str) -> str:
        return f"starts_with(lower({Q.strip(f'string_split({x}, chr(10))[-1]')}), 'moral:')"

    @staticmethod
    def reasons(rules: dict[str, str]) -> str:
        cases = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items())
        return f"array_to_string(list_filter([{cases}], lambda r: r IS NOT NULL), ',')"

    @staticmethod
    def keyword(x: str) -> str:
        return f"lower(regexp_extract({x}, '(\\S+)\\s*$', 1))"

    @staticmethod
    def uniform(seed: str, *keys: str) -> str:
        return f"('0x' || substr(md5('{seed}' || '|' || {" || '|' || ".join(f'CAST({k} AS VARCHAR)' for k in keys)}), 1, 8))::BIGINT"

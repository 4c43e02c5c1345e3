"""Text normalisation and tokenisation as Column -> Column functions (TXT-*, TOK-*).

White space and word classes are Unicode ones, as ``(?U)`` asks of the regular expressions; lines end at "\\n" only
(``(?d)``). Everything runs inside the JVM but the three functions that say otherwise.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# fixed values: punctuation that is folded to ASCII
ASCII_FOLD = {"\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...", "\u00a0": " "}
TEACHER_FOLD = {"\u2014": ", ", "\u2013": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "..."}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}
STOP_WORDS = "a an the and or to of in on with for is are was were can be by his her their our your my".split()
FOOTER_PATTERN = r"(?iU)\(?\s*Tr[íi]ch|NXB|First News|Dịch[\s-]?giả|Nguồn:|Tạo bởi|vnthuquan|nguyenkimvy"

WORDS = r"[A-Za-z']+"
WORDS_APOSTROPHE = r"[A-Za-z]+(?:'[A-Za-z]+)?"
WORDS_UNICODE = r"(?U)\w+"
MORAL_LINE = r"(?imUd)^\s*Moral\s*:\s*(.*)$"
DEFAULT_MORAL = "Moral: Be kind and learn from each day."


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    return sub(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return sub(c, r"(?U)\s+$", "")


def fold(c: Column, table: dict[str, str]) -> Column:
    """Replaces characters; those that become one character in a single pass."""
    single = {a: b for a, b in table.items() if len(a) == len(b) == 1}
    if single:
        c = F.translate(c, "".join(single), "".join(single.values()))
    for a, b in table.items():
        if a not in single:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    """The XML character references; ``unescape_full`` knows all of HTML."""
    for a, b in ENTITIES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@F.pandas_udf(StringType())
def unescape_full(s: pd.Series) -> pd.Series:
    """All of HTML's character references (a Python worker; no built-in knows them)."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """TXT-18, canonical composition (a Python worker; no built-in composes)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


# TXT ---------------------------------------------------------------------------------------------------------------


def clean_simple(c: Column) -> Column:
    """TXT-02: white space collapsed and trimmed; null becomes empty."""
    return strip(sub(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_text(c: Column, full: bool = False) -> Column:
    """TXT-01: character references decoded, white space collapsed and trimmed; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    return clean_simple(unescape_full(c) if full else unescape(c))


def clean_paragraphs(c: Column, full: bool = False) -> Column:
    """TXT-03: references decoded, zero-width characters dropped, blanks collapsed, line breaks kept up to two."""
    c = F.coalesce(c, F.lit(""))
    c = unescape_full(c) if full else unescape(c)
    c = F.translate(sub(c, "[\u200b\u200c\u200d]", ""), "\u00a0", " ")
    return strip(sub(sub(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_tags(c: Column, full: bool = False) -> Column:
    """TXT-04: tags become spaces, then TXT-03."""
    return clean_paragraphs(sub(c, r"<[^>]+>", " "), full)


def strip_html_blocks(c: Column, full: bool = False) -> Column:
    """TXT-05: block tags end lines, other tags vanish, lines are collapsed and empty ones dropped."""
    c = sub(c, r"(?i)<br[^>]*>", "\n")
    c = sub(c, r"(?iU)</?(p|div|h\d|li)[^>]*>", "\n")
    c = sub(c, r"<[^>]+>", "")
    c = unescape_full(c) if full else unescape(c)
    lines = F.transform(F.split(c, "\n"), lambda x: strip(sub(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def cut_footer(c: Column) -> Column:
    """TXT-06: the first footer line and all after it go, then trailing lines with Latin letters but no accents."""
    lines = F.split(c, "\n")
    kept = F.slice(lines, 1, F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(FOOTER_PATTERN), i)), lambda i: i.isNotNull())), F.size(lines)))
    noise = lambda x: x.rlike("[A-Za-z]") & ~x.rlike("[À-ɏḀ-ỿ]")
    last = F.array_max(F.transform(kept, lambda x, i: F.when(~noise(x), i + 1)))
    return strip(F.array_join(F.slice(kept, 1, F.coalesce(last, F.lit(0))), "\n"))


def fold_ascii(c: Column) -> Column:
    """TXT-07."""
    return fold(c, ASCII_FOLD)


def fold_teacher(c: Column) -> Column:
    """TXT-08."""
    return fold(c, TEACHER_FOLD)


def has_moral(c: Column) -> Column:
    return F.lower(c).contains("moral:")


def normalize_output(c: Column, teaching: Column) -> Column:
    """TXT-09: emphasis dropped, folded, cleaned (line breaks go), one form of moral, teaching added where none is."""
    c = clean_text(fold_ascii(F.replace(c, F.lit("**"), F.lit(""))))
    c = sub(c, r"(?iU)\bThe moral of the story is\s*:", "Moral:")
    c = sub(c, r"(?iU)\bThe moral\s*:", "Moral:")
    c = sub(c, r"(?iU)\s*Moral\s*:\s*", "\n\nMoral: ")
    c = strip(sub(c, r"\n{3,}", "\n\n"))
    return F.when((teaching != "") & ~has_moral(c), F.concat(rstrip(c), F.lit("\n\nMoral: "), teaching)).otherwise(c)


_EMPTY_MORAL = r"(?imUd)^\s*Moral\s*:\s*$"


def _filled(c: Column, teaching: Column) -> Column:
    """Empty moral lines take the teaching."""
    return F.regexp_replace(c, F.lit(_EMPTY_MORAL), F.concat(F.lit("Moral: "), sub(teaching, r"([\\$])", r"\\$1")))


def normalize_synthetic(c: Column, teaching: Column) -> Column:
    """TXT-10."""
    c = strip(c)
    c = F.concat(c, F.when(has_moral(c), "").otherwise(F.concat(F.lit("\n\nMoral: "), teaching)))
    return strip(_filled(c, teaching))


def normalize_rewrite(c: Column, teaching: Column) -> Column:
    """TXT-11."""
    c = sub(sub(sub(strip(c), r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    c = _filled(c, teaching)
    return strip(F.concat(c, F.when(has_moral(c), "").otherwise(F.concat(F.lit("\n\nMoral: "), teaching))))


def punctuate(c: Column, empty: str = "") -> Column:
    """TXT-13: a full stop where no terminator ends the text; empty text becomes ``empty`` ("" or ".")."""
    c = strip(c)
    return F.when(c == "", F.lit(empty)).when(c.rlike(r"[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))


def normalize_moral_line(c: Column, teaching: Column) -> Column:
    """TXT-12: what stands before the last moral line, and one final moral line; the teaching or a stock moral fills in."""
    c = strip(c)
    fallback = F.when(strip(teaching) != "", F.concat(F.lit("Moral: "), punctuate(teaching))).otherwise(F.lit(DEFAULT_MORAL))
    pattern = F.lit(MORAL_LINE)
    text = strip(F.element_at(F.regexp_extract_all(c, pattern, F.lit(1)), -1))
    # what stands before the last match: all but that match and what follows it
    rest = F.length(F.element_at(F.split(c, MORAL_LINE), -1)) + F.length(F.element_at(F.regexp_extract_all(c, pattern, F.lit(0)), -1))
    before = F.substring(c, F.lit(1), F.length(c) - rest)
    final = F.when(text != "", F.concat(F.lit("Moral: "), punctuate(text))).otherwise(fallback)
    found = c.rlike(MORAL_LINE)
    return strip(F.when(found, F.concat(rstrip(before), F.lit("\n\n"), final)).otherwise(F.concat(rstrip(c), F.lit("\n\n"), fallback)))


def trim_to_last_sentence(c: Column) -> Column:
    """TXT-14: cut after the last terminator and a closing quote; unchanged without one."""
    cut = F.regexp_extract(c, r"(?s)\A(.*[.!?][\"\u201d\u2019']?)", 1)
    return F.when((cut == "") | (F.length(cut) >= F.length(rstrip(c))), c).otherwise(cut)


def clean_story(c: Column) -> Column:
    """TXT-15."""
    return strip(sub(sub(strip(c), r"<\|[^|]*\|>", ""), r"(?i)</?(?:story|s)>", ""))


def normalized(c: Column) -> Column:
    """TXT-16: lower-case ASCII letters and digits, single spaces."""
    return F.trim(sub(F.lower(c), r"[^a-z0-9]+", " "))


def clean_topic(c: Column) -> Column:
    """TXT-17: a leading number or roman numeral goes."""
    return strip(sub(sub(c, r"(?U)^\d+[-–.\s]+", ""), r"(?U)^[IVXLCDM]+\s*[-.–]\s*", ""))


def escape_html(c: Column) -> Column:
    """TXT-19, first half: markup characters become references."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def light_markdown(c: Column) -> Column:
    """TXT-19: escaped, **bold**, paragraphs at blank lines, line breaks."""
    c = sub(escape_html(c), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    paragraphs = F.filter(F.split(c, r"\n{2,}"), lambda p: strip(p) != "")
    return F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


# TOK ---------------------------------------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """TOK-01: runs without white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def words(c: Column, pattern: str = WORDS) -> Column:
    """TOK-02 (WORDS), TOK-03 (WORDS_APOSTROPHE)."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def normalized_words(c: Column) -> Column:
    """TOK-04: lower-case words without outer apostrophes; words of apostrophes alone stay as empty strings."""
    return F.transform(words(c), lambda w: sub(F.lower(w), r"^'+|'+$", ""))


def unicode_words(c: Column) -> Column:
    """TOK-05."""
    return words(F.lower(c), WORDS_UNICODE)


def content_words(c: Column) -> Column:
    """TOK-06: distinct normalised words of over two letters that are no stop words."""
    return F.array_except(F.filter(normalized_words(c), lambda w: F.length(w) > 2), F.array(*map(F.lit, STOP_WORDS)))


def ngrams(t: Column, n: int) -> Column:
    """TOK-07: contiguous n-grams as arrays; none for fewer than n tokens. Shifted copies of the tokens are zipped, so
    that t is evaluated n times and not once a gram."""
    zipped = F.arrays_zip(*(F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0))).alias(f"g{k}") for k in range(n)))
    grams = F.transform(zipped, lambda r: F.array(*(r[f"g{k}"] for k in range(n))))
    return F.slice(grams, 1, F.greatest(F.size(t) - n + 1, F.lit(0)))


def sentences(c: Column, terminators: str = ".!?") -> Column:
    """TOK-08: cut after terminators that white space follows; trimmed, empty ones dropped."""
    cut = F.split(sub(c, rf"(?U)([{terminators}])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def without_moral(c: Column) -> Column:
    return sub(c, MORAL_LINE, "")


def word_lengths(parts: Column, pattern: str = WORDS) -> Column:
    """TOK-09: words of each sentence or paragraph."""
    return F.transform(parts, lambda s: F.size(words(s, pattern)))


def paragraphs(c: Column) -> Column:
    """TOK-10."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def sentence_lines(c: Column) -> Column:
    """Trimmed lines that hold text."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def mean(a: Column) -> Column:
    """Mean of an array of numbers; null for an empty one."""
    return F.try_divide(F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x), F.size(a))


def vocabulary(df, text_col: str = "text", pattern: str = WORDS_UNICODE):
    """TOK-11, data side: how often each token occurs in the corpus."""
    return df.select(F.explode(words(F.col(text_col), pattern)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def encoder(encode: Callable[[list[str]], list[list[int]]], limit: int = 512):
    """TOK-12: ids of a text, cut at limit, by an injected batch encoder (a Python worker)."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series([list(x)[:limit] for x in encode(s.fillna("").tolist())])

    return ids


def label_mask(ids: Column, n_cond: Column) -> Column:
    """TOK-13: the first n_cond labels are -100, so that they carry no loss."""
    n = F.least(n_cond, F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(-100), n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))

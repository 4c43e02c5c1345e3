"""Parsing and extraction (PRS-*): slots, morals, key-value lines, judge output. Column -> Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# fixed values: labels, keys and patterns
SLOTS = {"character": "Main Character", "setting": "Setting", "challenge": "Challenge", "outcome": "Outcome", "teaching": "Teaching"}
SLOT_ALIASES = {"character": ["Main Character", "Character"], "setting": ["Setting"], "challenge": ["Challenge"], "outcome": ["Outcome"], "teaching": ["Teaching", "Moral"]}
STORY_KEYS = ["output", "story", "fable", "text", "response", "completion"]
FIELD_KEYS = {
    "character": ["character", "main_character", "protagonist"],
    "setting": ["setting", "place", "location"],
    "challenge": ["challenge", "problem", "conflict"],
    "outcome": ["outcome", "resolution", "ending"],
    "teaching": ["teaching", "moral", "lesson", "moral_lesson"],
}
PARENTS = ["input", "prompt", "metadata", "template", "narrative", "story_elements"]
AXES = ["grammar", "creativity", "moral_clarity", "prompt_adherence"]
LESSON_WORDS = r"(?iU)\b(learn|kind|share|honest|patient|wise|friend|help)\w*\b"
TAG_TEACHINGS = {
    "honest": "honesty earns trust",
    "friend": "friendship grows through kindness",
    "kind": "kindness makes hard days easier",
    "share": "sharing turns plenty into friendship",
    "patience": "patience helps skill grow",
    "team": "teamwork makes hard tasks easier",
    "courage": "courage grows with careful steps",
    "persist": "perseverance helps us finish",
    "empathy": "empathy helps us understand others",
}
OTHER_TEACHING = "kind choices make a better day"
INSTRUCTION = "Write a short English fable for children with a clear moral."
MORAL_MARKERS = r"(?iU)(câu chuyện.{0,20}(ca ngợi|phê phán|khuyên|muốn nói|nói lên|dạy|nhắc|ngụ ý)|qua (câu chuyện|đó).{0,30}(khuyên|dạy|nói|ca ngợi|rằng)|truyện (này |trên )?(muốn nói|khuyên|dạy|ca ngợi)|ngụ ý (?:rằng|là|muốn)|hàm ý|bài học (ở đây|rút ra|hôm nay)|muốn nói (?:lên )?rằng)"
NARRATIVE_OPENERS = r"(?iU)^(rồi|thế là|sau đó|sau cùng|cuối cùng|bỗng|liền|từ đó|và rồi|kể từ)\b"


def blank_to_null(c: Column) -> Column:
    return F.when(T.strip(c) != "", c)


def parse_slots(prompt: Column) -> dict[str, Column]:
    """PRS-01: the five slots of a bulleted prompt, to the end of their lines; empty where missing."""
    return {k: T.strip(F.regexp_extract(prompt, rf"(?Ud)-\s*{label}\s*:\s*(.+)", 1)) for k, label in SLOTS.items()}


def parse_aliases(prompt: Column) -> dict[str, Column]:
    """PRS-02: any case, whole lines, the first alias that matches; null where none does."""
    one = lambda label: F.when(prompt.rlike(p := rf"(?imUd)^\s*-\s*{label}\s*:\s*(.+?)\s*$"), T.clean_text(F.regexp_extract(prompt, p, 1)))
    return {k: F.coalesce(*map(one, labels)) for k, labels in SLOT_ALIASES.items()}


def first_text(record: Column, keys: list[str]) -> Column:
    """PRS-03: the first key of a JSON record that holds a string with text; null where none does."""
    return F.coalesce(*(blank_to_null(T.clean_text(F.get_json_object(record, f"$.{k}"))) for k in keys))


def nested_text(record: Column, keys: list[str]) -> Column:
    """PRS-03: as first_text, then inside the parents that may hold the fields."""
    return F.coalesce(first_text(record, keys), *(blank_to_null(T.clean_text(F.get_json_object(record, f"$.{p}.{k}"))) for p in PARENTS for k in keys))


def infer_moral(story: Column) -> Column:
    """PRS-04: a labelled last line, else a last sentence of at most twenty words with a lesson word; empty otherwise."""
    labelled = F.regexp_extract(story, r"(?iUd)(?:^|\n)\s*(?:Moral|Lesson|Teaching)\s*:\s*(.+)$", 1)
    last = T.clean_text(F.element_at(T.sentences(story), -1))
    short = (F.size(T.tokens(last)) <= 20) & last.rlike(LESSON_WORDS)
    return F.when(labelled != "", T.clean_text(labelled)).when(short, T.strip(T.sub(last, "^Moral:", ""))).otherwise("")


def build_input(slots: dict[str, Column]) -> Column:
    """PRS-05: a labelled line for each slot with text; a stock line if there is none."""
    lines = F.filter(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k.capitalize()}: "), c)) for k, c in slots.items())), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("Teaching: include a clear moral at the end")


def format_records(df: DataFrame, record: str) -> DataFrame:
    """PRS-06: adds instruction, input and output of a JSON record; output is null where there is no story.

    Fields are read in one step, the story is made in the next, so that no field is parsed twice.
    """
    r, names = F.col(record), list(df.columns)
    prompt = F.coalesce(F.get_json_object(r, "$.prompt"), F.lit(""))
    fields = {k: F.coalesce(nested_text(r, keys), parse_aliases(prompt)[k]) for k, keys in FIELD_KEYS.items()}
    df = df.withColumns({**{f"__{k}": c for k, c in fields.items()}, "__story": nested_text(r, STORY_KEYS)})
    story = T.sub(T.clean_text(F.replace(F.col("__story"), F.lit("**"), F.lit(""))), r"(?iU)\bThe moral\s*:", "Moral:")
    df = df.withColumn("__plain", story)
    teaching = F.coalesce("__teaching", F.lit(""))
    told = F.when((teaching != "") & ~T.has_moral(F.col("__plain")), F.concat(T.rstrip(F.col("__plain")), F.lit(" Moral: "), teaching)).otherwise(F.col("__plain"))
    df = df.withColumn("output", F.when(F.col("__story").isNotNull(), told))
    slots = {k: F.col(f"__{k}") for k in FIELD_KEYS}
    slots["teaching"] = F.coalesce("__teaching", infer_moral(F.col("output")))
    return df.withColumn("instruction", F.lit(INSTRUCTION)).withColumn("input", build_input(slots)).select(*names, "instruction", "input", "output")


def key_values(c: Column) -> Column:
    """PRS-07, SRC-14's shape: lines with a colon as a map of lower-case keys; the last of equals wins."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(T.strip(F.substring_index(x, ":", 1))).alias("k"), T.strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("v")))
    # the last of equals: a pair stays if no later one has its key
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(last)


def teaching_of(input_: Column, output: Column) -> Column:
    """PRS-08: the input's teaching line, else the output's last line moral; without a final full stop."""
    own = F.regexp_extract(input_, r"(?imUd)^\s*Teaching\s*:\s*(.+?)\s*$", 1)
    moral = F.regexp_extract(output, r"(?iUd)(?:^|\n)\s*Moral\s*:\s*(.+?)\s*$", 1)
    return T.sub(T.clean_text(F.when(own != "", own).otherwise(moral)), r"\.+$", "")


def teaching_of_tags(tags: Column) -> Column:
    """PRS-09: the teaching of the first known tag word."""
    line = F.lower(F.array_join(tags, " "))
    out = None
    for key, teaching in TAG_TEACHINGS.items():
        out = F.when(line.contains(key), teaching) if out is None else out.when(line.contains(key), teaching)
    return out.otherwise(OTHER_TEACHING)


def infer_character(story: Column) -> Column:
    """PRS-09: who a story introduces; empty if it names no one."""
    first = F.regexp_extract(story, r"(?iU)\bthere (?:was|lived) (?:a|an|the) ([A-Za-z ]{3,40}?)(?: named| who|\.|,)", 1)
    named = r"(?iU)\b(?:a|an|the) ([A-Za-z]+) named ([A-Z][a-z]+)"
    second = F.concat_ws(" ", F.regexp_extract(story, named, 1), F.regexp_extract(story, named, 2))
    return F.lower(T.clean_text(F.when(first != "", first).otherwise(second)))


def children_story(text: Column, characters: Column, setting: Column, tags: Column) -> dict[str, Column]:
    """PRS-09: a children's story as (input, output); null where no character is known."""
    given = F.array_join(F.slice(F.filter(F.transform(characters, lambda x: T.clean_text(x)), lambda x: x != ""), 1, 2), ", ")
    character = blank_to_null(F.coalesce(blank_to_null(given), infer_character(text)))
    teaching = teaching_of_tags(tags)
    lines = [
        F.concat(F.lit("Character: "), character),
        F.concat(F.lit("Setting: "), F.coalesce(blank_to_null(T.clean_text(setting)), F.lit("a child-friendly place"))),
        F.lit("Challenge: the character faces a small problem and must choose wisely"),
        F.lit("Outcome: the character learns and makes a kind choice"),
        F.concat(F.lit("Teaching: "), teaching),
    ]
    ok = character.isNotNull() & (T.clean_text(text) != "")
    return {"input": F.when(ok, F.concat_ws("\n", *lines)), "output": F.when(ok, T.normalize_output(text, teaching))}


def closing_moral(story: Column) -> Column:
    """PRS-11: the last paragraph, if it is short and no dialogue."""
    last = F.element_at(T.sentence_lines(story), -1)
    return F.when((F.length(last) < 250) & ~last.rlike('^[-–•"«]'), last).otherwise("")


def marked_moral(body: Column, fable: Column) -> Column:
    """PRS-12: the sentence that a moral marker starts, else (fables) a closing sentence that reads like a maxim."""
    flat = F.replace(body, F.lit("\n"), F.lit(" "))
    at = F.regexp_instr(flat, F.lit(MORAL_MARKERS))
    marked = F.element_at(T.sentences(F.substring(flat, at, F.length(flat)), ".!?…"), 1)
    last = F.element_at(T.sentences(flat, ".!?…"), -1)
    plain = last.rlike(r"(?U)^-|:\s*-") | last.rlike(NARRATIVE_OPENERS) | (F.length(last) > 220) | ~last.rlike(r"[.!…?]$")
    return F.when(at > 0, F.coalesce(marked, F.lit(""))).when(fable & last.isNotNull() & ~plain, last).otherwise("")


def title_segments(lines: Column, first_title: Column) -> Column:
    """PRS-13: an array of (topic, body) cut at lines that start with an asterisk; repeated titles are dropped."""
    start = F.struct(F.array().cast("array<struct<topic:string,body:array<string>>>").alias("done"), F.coalesce(first_title, F.lit("")).alias("topic"), F.array().cast("array<string>").alias("body"))

    def flush(s: Column) -> Column:
        return F.when(F.size(s["body"]) > 0, F.concat(s["done"], F.array(F.struct(s["topic"].alias("topic"), s["body"].alias("body"))))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        marker = x.rlike(r"(?U)^\*\s*.+")
        fresh = F.struct(flush(s).alias("done"), T.strip(T.sub(x, r"(?U)^\*\s*", "")).alias("topic"), F.array().cast("array<string>").alias("body"))
        more = F.struct(s["done"].alias("done"), s["topic"].alias("topic"), F.when(x == s["topic"], s["body"]).otherwise(F.concat(s["body"], F.array(x))).alias("body"))
        return F.when(marker, fresh).otherwise(more)

    return F.transform(F.aggregate(lines, start, step, flush), lambda r: F.struct(r["topic"].alias("topic"), T.cut_footer(F.array_join(r["body"], "\n")).alias("body")))


def heading_segments(page: Column, heading: str = "h2", cut: bool = True) -> Column:
    """PRS-14, SRC-07, 09: an array of (topic, body): each heading with the paragraphs up to the next."""
    pattern = rf"(?is)<{heading}[^>]*>(.*?)</{heading}>"
    titles = F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)), lambda x: T.strip_html_blocks(x))
    sections = F.slice(F.split(page, pattern, -1), 2, F.greatest(F.size(titles), F.lit(1)))
    text = lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: T.strip_html_blocks(x)), "\n")
    return F.transform(F.arrays_zip(titles.alias("topic"), sections.alias("s")), lambda r: F.struct(r["topic"].alias("topic"), (T.cut_footer(text(r["s"])) if cut else text(r["s"])).alias("body")))


#: How numbered titles and chapter lines start.
NUMBERED_TITLE = r"^\d+\s*[-–.]\s*.+"
CHAPTER_LINE = r"(?iu)^chương\s+\d+"


def classed_paragraphs(page: Column, name: str) -> Column:
    """SRC-07, 08: the texts of the paragraphs whose class starts with name, blank ones dropped."""
    found = F.regexp_extract_all(page, F.lit(rf'(?s)<p[^>]*class="{name}[^"]*"[^>]*>(.*?)</p>'), F.lit(1))
    return F.filter(F.transform(found, lambda x: T.strip_tags(x)), lambda x: x != "")


def numbered_stories(paragraphs: Column, title: str = NUMBERED_TITLE, chapter: str = CHAPTER_LINE) -> Column:
    """SRC-07: an array of (title, body): a numbered line opens a story, a chapter line ends one, what follows neither goes."""
    none, lines = F.lit(None).cast("string"), F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<title:string,body:string>>").alias("done"), none.alias("title"), lines.alias("body"))

    def flush(s: Column) -> Column:
        return F.when(s["title"].isNotNull() & (F.size(s["body"]) > 0), F.concat(s["done"], F.array(F.struct(s["title"].alias("title"), F.array_join(s["body"], "\n").alias("body"))))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        opens = x.rlike(title) & ~x.rlike(chapter)
        fresh = F.struct(flush(s).alias("done"), F.when(opens, x).alias("title"), lines.alias("body"))
        more = F.struct(s["done"].alias("done"), s["title"].alias("title"), F.when(s["title"].isNotNull(), F.concat(s["body"], F.array(x))).otherwise(s["body"]).alias("body"))
        return F.when(opens | x.rlike(chapter), fresh).otherwise(more)

    return F.aggregate(paragraphs, start, step, flush)


def titled_story(title: Column, paragraphs: Column) -> Column:
    """SRC-08: the paragraphs after the first one that holds the title, or is part of it, one a line."""
    marks = F.transform(paragraphs, lambda x, i: F.when(F.contains(x, title) | F.contains(title, x), i + 1))
    at = F.array_min(F.filter(marks, lambda i: i.isNotNull()))
    return F.array_join(F.when(at.isNotNull(), F.slice(paragraphs, at + 1, F.greatest(F.size(paragraphs) - at, F.lit(0)))).otherwise(F.array().cast("array<string>")), "\n")


@F.pandas_udf(StringType())
def balanced_object(s: pd.Series) -> pd.Series:
    """PRS-15: the first balanced JSON object of free text, minding strings and escapes (a Python worker: a bracket scan
    is no regular expression); null where there is none."""

    def scan(raw: str | None) -> str | None:
        if not raw or (start := raw.find("{")) < 0:
            return None
        depth, quoted, i = 0, False, start
        while i < len(raw):
            ch = raw[i]
            if quoted:
                if ch == "\\":
                    i += 1
                elif ch == '"':
                    quoted = False
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if depth == 0:
                    return raw[start : i + 1]
            i += 1
        return None

    return s.map(scan)


def axis_of_json(data: Column, axis: str) -> tuple[Column, Column]:
    """PRS-16: (score, reason) of {"axis": {"score", "reason"}} or {"axis": score}; what is no number is 0."""
    nested = F.get_json_object(data, f"$.{axis}.score")
    flat = F.get_json_object(data, f"$.{axis}")
    number = F.coalesce(nested.try_cast("double"), F.when(~F.coalesce(flat.startswith("{"), F.lit(False)), flat.try_cast("double")), F.lit(0.0))
    return number.cast("int"), T.strip(F.coalesce(F.get_json_object(data, f"$.{axis}.reason"), F.lit("")))


def axis_of_text(raw: Column, axis: str) -> tuple[Column, Column]:
    """PRS-17: the same from text that is no valid JSON, by tolerant patterns."""
    nested = F.regexp_extract(raw, rf'(?s)"{axis}"\s*:\s*\{{[^{{}}]*?"score"\s*:\s*(\d+)', 1)
    flat = F.regexp_extract(raw, rf'"{axis}"\s*:\s*(\d+)', 1)
    score = F.coalesce(F.when(nested != "", nested).otherwise(F.when(flat != "", flat)).try_cast("int"), F.lit(0))
    reason = F.regexp_extract(raw, rf'(?s)"{axis}"\s*:\s*\{{[^{{}}]*?"reason"\s*:\s*"((?:\\.|[^"\\])*)"', 1)
    return score, T.strip(F.replace(F.replace(reason, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'")))


def parse_scores(raw: Column, data: Column | None = None) -> dict[str, Column]:
    """PRS-18: the axes' scores, their mean as overall (two decimals), and a map of the reasons given."""
    data = F.coalesce(data if data is not None else balanced_object(raw), F.lit("{}"))
    out, why = {}, []
    for axis in AXES:
        (score, reason), (score2, reason2) = axis_of_json(data, axis), axis_of_text(raw, axis)
        out[axis] = F.when(score == 0, score2).otherwise(score)
        why.append(F.struct(F.lit(axis).alias("k"), F.when(reason == "", reason2).otherwise(reason).alias("v")))
    overall = F.round(sum((out[a] for a in AXES[1:]), out[AXES[0]]) / len(AXES), 2)
    return {**out, "overall": overall, "rationale": F.map_filter(F.map_from_entries(F.array(*why)), lambda _k, v: v != "")}


def strict_scores(raw: Column, axes: list[str] = AXES, low: int = 1, high: int = 10) -> Column:
    """PRS-19: exactly these keys, whole numbers in range."""
    keys = F.json_object_keys(raw)
    ok = F.array_sort(keys) == F.array_sort(F.array(*map(F.lit, axes)))
    for a in axes:
        ok = ok & F.coalesce(F.get_json_object(raw, f"$.{a}").rlike(r"^\d+$") & F.get_json_object(raw, f"$.{a}").try_cast("int").between(low, high), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def index_of_id(c: Column) -> Column:
    """PRS-20: the number in the last two characters, from zero."""
    return F.right(c, F.lit(2)).try_cast("int") - 1


def number_map(pairs: Column) -> Column:
    """PRS-21: an array of k=v as a map of numbers."""
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(T.strip(F.substring_index(p, "=", 1)).alias("k"), F.substring_index(p, "=", -1).try_cast("double").alias("v"))))


def retry_seconds(message: Column, attempt: Column) -> Column:
    """PRS-22: one second over the wait a message asks for, else 2 ** attempt up to thirty."""
    pattern = r"(?iU)retry in ([0-9.]+)\s*(ms|s)"
    n = F.regexp_extract(message, pattern, 1).try_cast("double")
    seconds = F.when(F.lower(F.regexp_extract(message, pattern, 2)) == "ms", n / 1000).otherwise(n)
    return F.coalesce(seconds + 1.0, F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0)))

"""Golden values of text, parsing and rule functions, with their edges."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import injected
from corpusloom.functions import parse as P
from corpusloom.functions import rules as R
from corpusloom.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("He ran. She sat.", "He ran. She sat."),
        ("He ran. She", "He ran."),
        ('He said "go." Then', 'He said "go."'),
        ("no end here", "no end here"),
        ("", ""),
        ("Done.   ", "Done.   "),
    ],
)
def test_trim_to_last_sentence(spark, text, want):
    assert one(spark, T.trim_to_last_sentence(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "story, teaching, want",
    [
        ("A tale.", "patience and teamwork matter", "A tale.\n\nMoral: patience and teamwork matter."),
        ("A tale.\nMoral:", "patience and teamwork matter", "A tale.\n\nMoral: patience and teamwork matter."),
        ("A tale.\nMoral: share!", "", "A tale.\n\nMoral: share!"),
        ("A tale.", " ", "A tale.\n\nMoral: Be kind and learn from each day."),
        ("Moral: one\nmid\nMoral: two\ntail", "", "Moral: one\nmid\n\nMoral: two."),
        ("a\nMoral:\nNext line", "t", "a\n\nMoral: Next line."),  # white space after the label may cross the line
    ],
)
def test_moral_line(spark, story, teaching, want):
    assert one(spark, T.normalize_moral_line(F.col("s"), F.col("t")), s=story, t=teaching) == want


def test_words_and_sentences(spark):
    assert one(spark, T.unicode_words(F.lit("Đụ má, ngon"))) == ["đụ", "má", "ngon"]
    assert one(spark, T.tokens(F.lit(" a b \n c "))) == ["a", "b", "c"]
    assert one(spark, T.sentences(F.lit("A. B! C?  D"))) == ["A.", "B!", "C?", "D"]
    assert one(spark, T.ngrams(F.array(*map(F.lit, "abc")), 2)) == [["a", "b"], ["b", "c"]]
    assert one(spark, T.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, T.normalized_words(F.lit("Don't 'quote' '"))) == ["don't", "quote", ""]
    assert one(spark, T.label_mask(F.array(*map(F.lit, [5, 6, 7])), F.lit(2))) == [-100, -100, 7]
    assert one(spark, T.label_mask(F.array(*map(F.lit, [5])), F.lit(9))) == [-100]


def test_clean(spark):
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.clean_text(F.lit(" a &amp;lt; b c "))) == "a &lt; b c"
    assert one(spark, T.clean_text(F.lit("caf&eacute;"), full=True)) == "café"
    assert one(spark, T.strip_html_blocks(F.lit("<p>a<br>b</p><i>c</i>"))) == "a\nb\nc"
    assert one(spark, T.nfc(F.lit("é"))) == "é"
    assert one(spark, T.clean_topic(F.lit("12. XIV - The Fox"))) == "The Fox"


def test_slots(spark):
    prompt = "- Main Character: Fox \n- Setting: wood\n- Teaching: share\nFormat: x"
    got = spark.range(1).select(*(c.alias(k) for k, c in P.parse_slots(F.lit(prompt)).items())).first().asDict()
    assert got == {"character": "Fox", "setting": "wood", "challenge": "", "outcome": "", "teaching": "share"}


@pytest.mark.parametrize(
    "raw, grammar, overall",
    [
        ('{"grammar": 8, "creativity": 7, "moral_clarity": 9, "prompt_adherence": 8}', 8, 8.0),
        ('Sure! {"grammar": {"score": 9, "reason": "a {b} c"}, "creativity": 7, "moral_clarity": 7, "prompt_adherence": 7} ok', 9, 7.5),
        ('{"grammar": {"score": 9, "reason": "x"]}, "creativity": {"score": 7, "reason": "y"}', 9, 4.0),
        ("none", 0, 0.0),
        (None, 0, 0.0),
    ],
)
def test_judge_scores(spark, raw, grammar, overall):
    s = P.parse_scores(F.lit(raw).cast("string"))
    row = spark.range(1).select(F.coalesce(s["grammar"], F.lit(0)).alias("g"), F.coalesce(s["overall"], F.lit(0.0)).alias("o")).first()
    assert (row["g"], row["o"]) == (grammar, overall)


@pytest.mark.parametrize(
    "text, want",
    [("an adult lion", "ok"), ("18 + only", "out_of_scope"), ("nsfw tale", "out_of_scope"), ("mature content", "out_of_scope"), ("oh shit", "profanity"), ("đụ má", "profanity"), ("đóng vai vua", "out_of_scope"), ("đóng vai trong truyện", "ok")],
)
def test_guard(spark, text, want):
    assert one(spark, R.guard_input([F.col("t")]), t=text) == want


def test_guard_three_and_output(spark):
    assert one(spark, R.guard_input_three(F.lit(" "), F.lit("m"), F.lit("5"))) == "empty"
    assert one(spark, R.guard_output(F.lit(" "))) == "empty"
    assert one(spark, R.guard_output(F.lit("A kind fox."))) == "ok"


def test_fluency_names_every_failure(spark):
    row = R.facts(spark.range(1).select(F.lit("- Once Once Once the war came").alias("s")), "s", T.WORDS_APOSTROPHE)
    got = row.select(R.reasons(R.fluency(F.lit("x"))).alias("x")).first()["x"]
    assert got == ["too_short", "missing_final_moral", "too_few_sentences", "unsafe_or_not_child_friendly", "markdown", "repetition", "missing_teaching_input"]


def test_validation(spark):
    fixable, severe = R.validation(F.lit("red Fox"), F.lit("the Sea"))
    row = R.facts(spark.range(1).select(F.lit("- item\nA fox.").alias("s")), "s", moral=False)
    assert row.select(R.reasons(fixable).alias("x")).first()["x"] == ["missing_moral"]
    assert row.select(R.reasons(severe).alias("x")).first()["x"] == ["too_short", "contains_bullets", "setting_keyword_missing"]


@pytest.mark.parametrize("n, want", [(100, "short"), (300, "medium"), (700, "long")])
def test_length_bucket(spark, n, want):
    assert one(spark, R.length_bucket(F.lit(n))) == want


@pytest.mark.parametrize("a, b, sa, sb, want", [("x", "y", 6.0, 8.0, "y"), ("x", "y", 8.0, 7.25, None), ("x", "y", 0.0, 8.0, None), ("x", " x ", 6.0, 8.0, None)])
def test_preference_pair(spark, a, b, sa, sb, want):
    out = R.preference_pair(F.lit(a), F.lit(b), F.lit(sa), F.lit(sb))
    assert one(spark, out["chosen"]) == want


def test_training_text_points_at_the_separator(spark):
    text, cond = R.training_text({"character": F.lit("Fox")}, F.lit(" A tale. "), F.lit("short"))
    row = spark.range(1).select(text.alias("t"), cond.alias("c")).first()
    assert row["t"][row["c"] :] == "<|story|>A tale.<|end|>"


def test_injected_judge_retries_then_reports(spark):
    calls = spark.createDataFrame([("p", "s"), ("bad", "s")], "prompt string, story string")

    def fn(story, prompt):
        if prompt == "bad":
            raise ValueError(prompt)
        return "{}"

    got = {r["prompt"]: (r["raw"], r["status"]) for r in injected.judge(calls, "prompt", "story", fn, 2).collect()}
    assert got == {"p": ("{}", "success"), "bad": (None, "error")}


def test_key_values_last_wins(spark):
    assert one(spark, P.key_values(F.lit("A: 1\nno\na : 2: 3"))) == {"a": "2: 3"}


def test_segments(spark):
    got = one(spark, P.title_segments(F.array(*map(F.lit, ["Mở đầu", "* Một", "Một", "thân é", "* Hai", "bé"])), F.lit("")))
    assert [(r["topic"], r["body"]) for r in got] == [("", "Mở đầu"), ("Một", "thân é"), ("Hai", "bé")]
    page = "<h2>A</h2><p>x é</p><p>y é</p><h2>B</h2><p>z é</p>"
    assert [(r["topic"], r["body"]) for r in one(spark, P.heading_segments(F.lit(page)))] == [("A", "x é\ny é"), ("B", "z é")]


def test_numbered_stories(spark):
    page = '<p class="c">before</p><p class="c">1 - One</p><p class="c2">a <b>b</b></p><p>no class</p><p class="c"> </p><p class="c">c</p><p class="c">2. Empty</p><p class="c">CHƯƠNG 2</p><p class="c">lost</p><p class="x">3. other class</p><p class="c">3. Last</p><p class="c">z</p>'
    got = one(spark, P.numbered_stories(P.classed_paragraphs(F.lit(page), "c")))
    assert [(r["title"], r["body"]) for r in got] == [("1 - One", "a b\nc"), ("3. Last", "z")]
    assert one(spark, P.titled_story(F.lit("One"), P.classed_paragraphs(F.lit(page), "c"))).split("\n")[0] == "a b"
    assert one(spark, P.titled_story(F.lit("absent"), P.classed_paragraphs(F.lit(page), "c"))) == ""
    assert one(spark, P.numbered_stories(P.classed_paragraphs(F.lit(""), "c"))) == []

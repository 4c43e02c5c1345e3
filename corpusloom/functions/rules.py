"""Rule sets that explain every rejection (QF-*, GRD-*, MET-*), and row-local scores (SCR-*).

A rule set is an ordered mapping of names to boolean columns; ``reasons`` lists the names that hold. All rules of a set
are plain expressions over one row, so a scan evaluates them in a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# fixed values: word lists and patterns
FLUENCY_UNSAFE = "blood bloody kill killed killing die died death murder weapon knife gun war battle violence violent poison romance romantic dating marry marriage betrayal revenge curse haunted demon evil torture suicide".split()
SYNTHETIC_UNSAFE = "kill blood weapon war violent scary haunted death die romance dating marry".split()
SFT_UNSAFE = r"fall(?:s|ing)? in love|love triangle|romance|romantic|date|dating|marry|marriage|betrayal|betray|kill|blood|weapon|war|vicious|poisonous|abandoned|deserted|ruined|fortress|mine|scapegoat\w*|hidden agenda|injustice|oppression|rebellion|identity crisis|prophecy|ethical dilemma|moral compromise|renounces violence|violence|deceiver|deceived|deception|spy|sabotage|bounty|manipulative|ancient enemies|sworn enemy|villain|banished|ruthless|harm|fight|fighting|battle of wits|victim|rebellious|forced to confront|haunted|seethed|challenge to authority"
BANNED_VI = ["đụ", "địt", "lồn", "cặc", "đm", "đmm", "vcl", "đụ má"]
BANNED_EN = "fuck fucking shit bitch bastard asshole dick cunt".split()
SCOPE_EN = [
    r"ignore (the )?(previous )?(instructions|prompt)",
    r"write (me )?(some )?(malware|code|a program|an essay|an email)",
    r"(hack|exploit|virus)",
    r"(sexual|porn|explicit|erotic|erotica|nude|nudity)",
    r"\b(18|21)\s*\+",
    r"\bnsfw\b",
    r"\b[xr]-?\s*rated\b",
    r"\bfor\s+adults?\s+only\b",
    r"\badults?[- ]only\b",
    r"\bage[- ]restricted\b",
    r"\b(adult|mature|grown[- ]?up)\s+(content|theme|themes|material|humou?r|joke|jokes|audience|audiences|reader|readers|lesson|lessons)\b",
    r"\b(gore|gory|graphic\s+violence)\b",
]
SCOPE_VI = [r"bỏ qua (hướng dẫn|chỉ thị)", r"viết (mã|code|phần mềm)", r"mã độc|virus|hack", r"(làm|viết) (bài tập|luận văn|email)", r"đóng vai(?! .*truyện)"]
FLUENCY_BAD = {
    "mojibake": r"[âÃ\uFFFD]",
    "markdown": r"(?mUd)^\s{0,3}[-*#]\s+",
    "meta_text": r"(?iU)\b(as an ai|i cannot|here is|the story is about)\b",
    "chapter_title": r"(?iU)^\s*(chapter|title)\s*[:\d]",
    "explicit_the_moral": r"(?iU)\bthe moral of the story is\s*:",
}
FINAL_MORAL = r"(?iUd)(?:^|\n)\s*Moral\s*:\s*(.+?)\s*$"
BULLETS = r"(?mUd)^\s*[-*]\s+"
SKIP_TOPIC = r"(?iU)(lời giới thiệu|giới thiệu|mục lục|lời nói đầu|lời tựa|tiểu sử|người kể chuyện)"


def any_word(words: list[str]) -> str:
    return rf"(?iU)\b({'|'.join(words)})\b"


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())


def last_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), -1)


def ends_with_moral(c: Column) -> Column:
    return F.lower(T.strip(last_line(c))).startswith("moral:")


def keyword(c: Column) -> Column:
    """The last word, lower case; empty for blank text."""
    return F.lower(F.regexp_extract(c, r"(?U)(\S+)\s*$", 1))


def lacks(story: Column, slot: Column) -> Column:
    k = keyword(slot)
    return (k != "") & ~F.contains(F.lower(story), k)


def longest(lengths: Column) -> Column:
    return F.coalesce(F.array_max(lengths), F.lit(0))


def facts(df: DataFrame, output: str, words: str = T.WORDS, strip: bool = True, moral: bool = True) -> DataFrame:
    """What several rules read, each computed once in a step of its own: __out (the trimmed text), __n (its words) and
    __lengths (words of each sentence; without the moral line unless moral)."""
    df = df.withColumn("__out", T.strip(F.col(output)) if strip else F.col(output))
    body = F.col("__out") if moral else T.without_moral(F.col("__out"))
    return df.withColumns({"__n": F.size(T.words(F.col("__out"), words)), "__lengths": T.word_lengths(T.sentences(body), words)})


def fluency(input_: Column, min_words: int = 110, max_words: int = 280) -> dict[str, Column]:
    """QF-01, sixteen rules over facts(df, output, T.WORDS_APOSTROPHE)."""
    out, n, lengths = F.col("__out"), F.col("__n"), F.col("__lengths")
    both = F.concat(input_, F.lit("\n"), out)
    final = out.rlike(FINAL_MORAL)
    return {
        "too_short": n < min_words,
        "too_long": n > max_words,
        "missing_final_moral": ~final,
        "moral_not_last_line": final & ~ends_with_moral(out),
        "multiple_morals": F.size(T.words(out, r"(?iU)\bMoral\s*:")) > 1,
        "too_few_sentences": F.size(lengths) < 6,
        "long_sentence": longest(lengths) > 42,
        "many_long_sentences": F.size(F.filter(lengths, lambda x: x > 32)) >= 3,
        "unsafe_or_not_child_friendly": both.rlike(any_word(FLUENCY_UNSAFE)),
        **{name: both.rlike(p) for name, p in FLUENCY_BAD.items()},
        "repetition": out.rlike(r"(?iU)\b(\w{4,})\b(?:\W+\1\b){2}"),
        "missing_teaching_input": ~input_.contains("Teaching:"),
    }


def synthetic(story: Column, character: Column, setting: Column) -> dict[str, Column]:
    """QF-02, eleven rules over facts(df, story)."""
    clean, n = F.col("__out"), F.col("__n")
    lower = F.lower(clean)
    has = T.has_moral(clean)
    bare = T.rstrip(sub_quotes(T.clean_simple(clean)))
    return {
        "too_short": n < 110,
        "too_long": n > 280,
        "missing_moral": ~has,
        "moral_not_final_line_style": has & ~story.rlike(r"(?iUd)(?:^|\n)\s*Moral\s*:"),
        "contains_bullets": story.rlike(BULLETS),
        "unsafe_terms": lower.rlike(any_word(SYNTHETIC_UNSAFE)),
        "long_single_paragraph": ~clean.contains("\n\n") & (n > 220),
        "run_on_sentence": longest(F.col("__lengths")) > 55,
        "incomplete_ending": (clean != "") & ~ends_with_moral(clean) & ~bare.rlike(r"[.!?]$"),
        "character_missing": ~F.contains(lower, keyword(character)),
        "setting_missing": ~F.contains(lower, keyword(setting)),
    }


def sub_quotes(c: Column) -> Column:
    return T.sub(c, "[\"'\u201d]+$", "")


def title_like(story: Column) -> Column:
    """The first line with text looks like a title."""
    first = F.element_at(T.sentence_lines(story), 1)
    parts = T.tokens(first)
    n = F.size(parts)
    capital = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    short = (n <= 7) & ~first.rlike(r"[.!?:]$")
    return F.coalesce(short | ((n <= 8) & (capital >= F.greatest(F.lit(3), n - 1))), F.lit(False))


def rewrite(story: Column, teaching: Column, character: Column, setting: Column) -> dict[str, Column]:
    """QF-03, fifteen rules over facts(df, story, moral=False) of text that T.normalize_rewrite has normalised."""
    lower, n = F.lower(story), F.col("__n")
    parts, lengths = T.paragraphs(story), F.col("__lengths")
    count = lambda piece: (F.length(lower) - F.length(F.replace(lower, F.lit(piece), F.lit("")))) / len(piece)
    drift = story.rlike(r"(?U)\b(I|we|my|our)\b") & lower.rlike(r"(?U)\b(lived|was|were|said|asked)\b") & (count(" i ") + count(" my ") + count(" we ") >= 2)
    return {
        "too_short": n < 120,
        "too_long": n > 260,
        "too_few_paragraphs": F.size(parts) < 2,
        "too_many_paragraphs": F.size(parts) > 5,
        "run_on_sentence": longest(lengths) > 45,
        "high_avg_sentence_length": F.coalesce(T.mean(lengths) > 25, F.lit(False)),
        "paragraph_too_long": longest(T.word_lengths(parts)) > 120,
        "missing_moral": ~story.rlike(r"(?imUd)^\s*Moral\s*:\s*\S+"),
        "moral_not_final_line": ~story.rlike(r"(?imUd)\n\s*Moral\s*:"),
        "title_like_first_line": title_like(story),
        "bad_punctuation_or_symbols": story.contains("&") | story.contains("_") | story.contains("..."),
        "possible_pov_drift": drift,
        "teaching_missing": (teaching != "") & ~F.contains(lower, F.lower(teaching)),
        "character_keyword_missing": lacks(story, character),
        "setting_keyword_missing": lacks(story, setting),
    }


def validation(character: Column, setting: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """QF-04: (fixable, severe) over facts(df, story, moral=False)."""
    clean, n = F.col("__out"), F.col("__n")
    morals = F.regexp_extract_all(clean, F.lit(T.MORAL_LINE), F.lit(1))
    found = F.size(morals) > 0
    empty = T.strip(F.element_at(morals, -1)) == ""
    after = T.strip(F.element_at(F.split(clean, T.MORAL_LINE), -1)) != ""
    fixable = {"missing_moral": ~found, "empty_moral": found & empty, "moral_not_final": found & ~empty & after}
    severe = {
        "too_short": n < 80,
        "too_long": n > 700,
        "contains_bullets": clean.rlike(BULLETS),
        "run_on_sentence": longest(F.col("__lengths")) > 65,
        "paragraph_too_long": longest(T.word_lengths(T.paragraphs(clean))) > 180,
        "character_keyword_missing": lacks(clean, character),
        "setting_keyword_missing": lacks(clean, setting),
    }
    return fixable, severe


def passes_sft(output: Column, input_: Column, min_words: int = 60, max_words: int = 450) -> Column:
    """QF-05."""
    n = F.size(T.words(output))
    unsafe = F.lower(F.concat(input_, F.lit(" "), output)).rlike(rf"(?U)\b(?:{SFT_UNSAFE})\b")
    return ~unsafe & n.between(min_words, max_words) & (input_.contains("Teaching:") | T.has_moral(output))


def clean_target(output: Column, input_: Column) -> Column:
    """QF-06."""
    return F.size(T.tokens(output)).between(80, 380) & output.contains("Moral:") & input_.contains("Character:") & input_.contains("Teaching:")


def is_prose(story: Column) -> Column:
    """QF-07, prose test: a paragraph of 80 characters, or over 35 % of 50."""
    lines = T.sentence_lines(story)
    at_least = lambda n: F.size(F.filter(lines, lambda p: F.length(p) >= n))
    return (F.size(lines) > 0) & ((at_least(80) >= 1) | (at_least(50) / F.size(lines) > 0.35))


def length_and_prose(story: Column, low: int = 100, high: int = 6000) -> Column:
    """QF-07: why a story is dropped ("short", "long", "poetry"), or "kept"."""
    n = F.length(story)
    return F.when(n < low, "short").when(n > high, "long").when(~is_prose(story), "poetry").otherwise("kept")


def book_filter(body: Column, topic: Column, least: int = 120) -> Column:
    """QF-08, row-local half: long enough and no front matter."""
    return (F.length(T.strip(body)) >= least) & ~topic.rlike(SKIP_TOPIC)


def within_chars(story: Column, low: int, high: int) -> Column:
    """QF-09."""
    return F.length(story).between(low, high)


def pretrain_reject(fable: Column, low: int = 60, high: int | None = 320) -> Column:
    """QF-10: "empty", "too_short", "too_long" or null."""
    n = F.size(T.tokens(fable))
    out = F.when(T.strip(F.coalesce(fable, F.lit(""))) == "", "empty").when(n < low, "too_short")
    return out if high is None else out.when(n > high, "too_long")


def distill_accept(story: Column, n_tokens: Column, most: int = 400) -> Column:
    """QF-11; n_tokens from an injected tokenizer."""
    return (n_tokens <= most) & F.size(T.tokens(story)).between(120, 280) & ~story.contains("\n#") & ~story.contains("**")


def failure_reasons(m: dict[str, Column], actions: Column) -> Column:
    """QF-12: reasons from metrics and post-processing actions, sorted and distinct."""
    found = reasons({
        "missing_or_empty_moral": ~m["has_moral_footer"],
        "empty_moral": m["empty_moral"],
        "unclean_ending": ~m["clean_ending"],
        "weak_moral_alignment": ~m["moral_exact"],
        "weak_outcome_coverage": ~m["outcome_covered"],
        "run_on_sentence": m["has_run_on_sentence"],
    })
    return F.array_sort(F.array_distinct(F.concat(found, F.transform(actions, lambda a: F.concat(F.lit("action_"), a)))))


# GRD ---------------------------------------------------------------------------------------------------------------


def banned(c: Column) -> Column:
    """GRD-01: a banned token, or a banned phrase anywhere."""
    low = F.lower(c)
    phrases = [b for b in BANNED_VI if " " in b]
    hit = F.arrays_overlap(T.words(low, T.WORDS_UNICODE), F.array(*map(F.lit, BANNED_VI))) | F.arrays_overlap(T.words(low, "[a-z']+"), F.array(*map(F.lit, BANNED_EN)))
    for p in phrases:
        hit = hit | low.contains(p)
    return F.coalesce(hit, F.lit(False))


def out_of_scope(c: Column) -> Column:
    """GRD-05 is the last pattern: a look-ahead."""
    low = F.lower(c)
    hit = F.lit(False)
    for p in SCOPE_EN + SCOPE_VI:
        hit = hit | low.rlike("(?U)" + p)
    return hit


def guard_input(slots: list[Column]) -> Column:
    """GRD-02: "profanity", "out_of_scope" or "ok"; empty slots are allowed."""
    text = F.concat_ws(" ", *(F.coalesce(s, F.lit("")) for s in slots))
    return F.when(banned(text), "profanity").when(out_of_scope(text), "out_of_scope").otherwise("ok")


def guard_input_three(topic: Column, moral: Column, age: Column) -> Column:
    """GRD-03: as GRD-02, but a blank field decides first ("empty")."""
    blank = (T.strip(topic) == "") | (T.strip(moral) == "") | (T.strip(age) == "")
    return F.when(blank, "empty").otherwise(guard_input([topic, moral, age]))


def guard_output(c: Column) -> Column:
    """GRD-04: "empty", "profanity" or "ok"."""
    return F.when(T.strip(c) == "", "empty").when(banned(c), "profanity").otherwise("ok")


# MET ---------------------------------------------------------------------------------------------------------------


def phrase_present(phrase: Column, story: Column) -> Column:
    line = lambda c: F.array_join(T.normalized_words(c), " ")
    return (F.size(T.words(phrase)) == 0) | F.contains(line(story), line(phrase))


def moral_text(c: Column) -> Column:
    """PRS-10: everything after the first "moral:"."""
    return T.strip(F.regexp_extract(c, r"(?isU)\bmoral\s*:\s*(.+)$", 1))


def empty_moral(c: Column) -> Column:
    return c.rlike(r"(?isU)\bmoral\s*:\s*$")


def story_metrics(story: Column, character: Column, teaching: Column, outcome: Column) -> dict[str, Column]:
    """MET-01: the metrics that depend on text."""
    words = T.normalized_words(story)
    moral = moral_text(story)
    body = T.sub(story, r"(?isU)\bmoral\s*:\s*.+$", "")
    lengths = F.transform(T.sentences(body), lambda s: F.size(T.words(s)))
    teach, lesson, result = T.content_words(teaching), T.content_words(moral), T.content_words(outcome)
    overlap = F.size(F.array_intersect(teach, lesson))
    covered = F.size(F.array_intersect(result, words))
    return {
        "word_count": F.size(words),
        "has_moral_label": story.rlike(r"(?iU)\bmoral\s*:"),
        "has_moral_footer": moral != "",
        "empty_moral": empty_moral(story),
        "character_exact": phrase_present(character, story),
        "moral_keyword_overlap": overlap,
        "moral_exact": (F.size(teach) > 0) & (overlap == F.size(teach)),
        "outcome_keyword_overlap": covered,
        "outcome_covered": (F.size(result) > 0) & (covered >= F.greatest(F.lit(1), F.floor(F.size(result) / 2))),
        "clean_ending": T.strip(story).rlike("[.!?\"'](?U:\\s*)$"),
        "max_sentence_words": longest(lengths),
        "has_run_on_sentence": longest(lengths) > 65,
    }


def exact_moral(story: Column, teaching: Column) -> Column:
    """MET-02: the last line with text is a moral that says the teaching."""
    line = F.element_at(T.sentence_lines(story), -1)
    return F.coalesce(line.startswith("Moral:") & (T.normalized(F.substring(line, F.lit(7), F.length(line))) == T.normalized(teaching)), F.lit(False))


def has_phrase(c: Column, phrase: str) -> Column:
    """MET-03."""
    return F.lower(c).contains(phrase.lower())


def mentions_moral(c: Column) -> Column:
    """MET-04."""
    return F.lower(c).rlike(r"(?U)\b(moral|lesson|teaching)\b")


# SCR ---------------------------------------------------------------------------------------------------------------


def fluency_score(output: Column, input_: Column) -> Column:
    """SCR-01: up to ten points, over facts(df, output, T.WORDS_APOSTROPHE, strip=False)."""
    n, average = F.col("__n"), T.mean(F.col("__lengths"))
    points = [
        (n.between(120, 260), 2),
        (ends_with_moral(output), 3),
        (input_.contains("Character:") & input_.contains("Setting:") & input_.contains("Teaching:"), 2),
        (average.between(8, 24), 2),
        (output.contains("\n\n"), 1),
    ]
    return sum((F.when(c, p).otherwise(0) for c, p in points[1:]), F.when(points[0][0], points[0][1]).otherwise(0))


def length_bucket(n: Column) -> Column:
    """SCR-02."""
    return F.when(n < 200, "short").when(n < 450, "medium").otherwise("long")


def verdict(value: Column, passes: Column, warns: Column) -> Column:
    """SCR-03: one row of a verdict table."""
    return F.when(passes, "PASS").when(warns, "WARN").otherwise("FAIL")


def tokens_per_second(n: Column, ms: Column) -> Column:
    """SCR-04: null without a latency."""
    return F.when(ms > 0, n / (ms / 1000.0))


# fixed values: prompt wording
PROMPT_BASE = "Write one coherent children's fable. Keep the events connected and easy to follow. Do not stop until you write a final line that starts exactly with 'Moral:'."
PROMPT_LABELS = {"character": "Main character", "setting": "Setting", "challenge": "Challenge", "outcome": "Outcome", "teaching": "Teaching/Moral"}
LENGTH_HINTS = {"short": "Keep it short (about 120-160 words).", "medium": "Write a medium-length fable (about 200-260 words).", "long": "Write a fuller fable (about 280-340 words)."}
SEPARATOR, END = "<|story|>", "<|end|>"


def fable_prompt(slots: dict[str, Column], hint: Column | None = None) -> Column:
    """SCR-05: a line for each slot that is not blank, and a hint at the length."""
    lines = F.filter(F.array(*(F.when(T.strip(slots[k]) != "", F.concat(F.lit(f"- {label}: "), T.strip(slots[k]))) for k, label in PROMPT_LABELS.items() if k in slots)), lambda x: x.isNotNull())
    out = F.when(F.size(lines) > 0, F.concat(F.lit(PROMPT_BASE + " Use these narrative elements:\n"), F.array_join(lines, "\n"))).otherwise(F.lit(PROMPT_BASE))
    return out if hint is None else F.when(T.strip(hint) != "", F.concat(out, F.lit("\n"), T.strip(hint))).otherwise(out)


def training_text(slots: dict[str, Column], fable: Column, bucket: Column) -> tuple[Column, Column]:
    """SCR-06: (text, cond_len); cond_len is where the separator starts."""
    hint = F.element_at(F.create_map(*(F.lit(x) for kv in LENGTH_HINTS.items() for x in kv)), bucket)
    prefix = F.concat(fable_prompt(slots, hint), F.lit("\n"))
    return F.concat(prefix, F.lit(SEPARATOR), T.strip(fable), F.lit(END)), F.length(prefix)


def chat_text(system: Column, user: Column, assistant: Column) -> Column:
    """SCR-07: one conversation as a chat template writes it."""
    turn = lambda role, c: F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), c, F.lit("<|eot_id|>"))
    return F.concat(F.lit("<|begin_of_text|>"), turn("system", system), turn("user", user), turn("assistant", assistant))


def enhance(df: DataFrame, story: str, teaching: str, character: str, setting: str, rewritten: str | None = None) -> DataFrame:
    """SCR-08: validate, take an injected rewrite where rules are severe, normalise the moral, validate again.

    Adds enhanced, actions, final_fixable and final_severe; each step reads the column of the one before.
    """
    slots, names = (F.col(character), F.col(setting)), df.columns
    df = facts(df, story, moral=False)
    _, severe = validation(*slots)
    took = (F.size(reasons(severe)) > 0) & F.col(rewritten).isNotNull() if rewritten else F.lit(False)
    df = df.withColumn("__took", took)
    df = df.withColumn("__draft", F.when(F.col("__took"), F.col(rewritten)).otherwise(F.col(story)) if rewritten else F.col(story))
    df = df.withColumn("enhanced", T.normalize_moral_line(F.col("__draft"), F.col(teaching)))
    df = facts(df, "enhanced", moral=False)
    fixable, severe = validation(*slots)
    actions = reasons({"rewrite": F.col("__took"), "moral_postprocess": F.col("enhanced") != T.strip(F.col("__draft"))})
    return df.withColumns({"actions": actions, "final_fixable": reasons(fixable), "final_severe": reasons(severe)}).select(*names, "enhanced", "actions", "final_fixable", "final_severe")


def preference_pair(a: Column, b: Column, score_a: Column, score_b: Column, margin: float = 1.0) -> dict[str, Column]:
    """SCR-09: null columns where the pair is dropped (equal texts, a failed score, too small a margin); ties choose a."""
    ok = (T.strip(a) != T.strip(b)) & (score_a > 0) & (score_b > 0) & (F.abs(score_a - score_b) >= margin)
    second = score_b > score_a
    pick = lambda x, y: F.when(ok, F.when(second, y).otherwise(x))
    return {"chosen": pick(a, b), "rejected": pick(b, a), "score_chosen": pick(score_a, score_b), "score_rejected": pick(score_b, score_a)}


def schedule(step: Column, warmup: int, stable: int, total: int) -> Column:
    """SCR-11: warm-up, plateau, linear decay to zero."""
    decay = F.greatest(F.lit(0.0), (total - step) / float(max(1, total - stable)))
    return F.when(step < warmup, step / float(max(1, warmup))).when(step < stable, F.lit(1.0)).otherwise(decay)


def compare_sides(left: dict[str, Column], right: dict[str, Column], overall: tuple[Column, Column]) -> dict[str, Column]:
    """SCR-12: axes won by either side, the overall lead, and who wins."""
    wins = lambda a, b: sum((F.when(a[k] > b[k], 1).otherwise(0) for k in a), F.lit(0))
    delta = overall[0] - overall[1]
    return {"left_wins": wins(left, right), "right_wins": wins(right, left), "delta": delta, "winner": F.when(delta > 0, "left").when(delta < 0, "right").otherwise("tie")}

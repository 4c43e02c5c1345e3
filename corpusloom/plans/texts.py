"""Queries over TXT-* and TOK-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .base import STORIES, Q, query, read, stories


def _md5(c):
    return F.md5(c)


@query("txt_clean_simple", f"SELECT doc_id, md5({Q.collapse('text')}) AS digest, length({Q.collapse('text')}) AS n FROM documents")
def txt_clean_simple(spark, sf):
    c = T.clean_simple(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query("txt_clean_text", f"SELECT page_id, md5({Q.clean('html')}) AS digest FROM pages")
def txt_clean_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.clean_text(F.col("html"))).alias("digest"))


_PARA = lambda x: Q.strip(Q.sub(Q.sub(f"replace({x}, chr(160), ' ')", r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@query("txt_clean_paragraphs", f"SELECT doc_id, md5({_PARA(Q.unescape('text'))}) AS digest FROM (SELECT doc_id, replace(text, '. ', E'.  \\t\\n\\n\\n\\n') || '&nbsp;&amp; end' AS text FROM documents)")
def txt_clean_paragraphs(spark, sf):
    text = F.concat(F.replace(F.col("text"), F.lit(". "), F.lit(".  \t\n\n\n\n")), F.lit("&nbsp;&amp; end"))
    return read(spark, sf, "documents").select("doc_id", F.md5(T.clean_paragraphs(text)).alias("digest"))


@query("txt_strip_tags", f"SELECT page_id, md5({_PARA(Q.unescape(Q.sub('html', '<[^>]+>', ' ')))}) AS digest FROM pages")
def txt_strip_tags(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


_BLOCKS = Q.unescape(Q.sub(Q.sub(Q.sub("html", "(?i)<br[^>]*>", "\n"), r"(?i)</?(p|div|h\d|li)[^>]*>", "\n"), "<[^>]+>"))
_BLOCK_LINES = f"array_to_string(list_filter(list_transform(string_split(replace({_BLOCKS}, chr(160), ' '), chr(10)), lambda s: {Q.strip(Q.sub('s', '[ ' + chr(92) + 't]+', ' '))}), lambda s: s <> ''), chr(10))"


@query("txt_strip_html_blocks", f"SELECT page_id, md5({_BLOCK_LINES}) AS digest FROM pages")
def txt_strip_html_blocks(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.strip_html_blocks(F.col("html"))).alias("digest"))


_FOOT = r"(?i)\(?\s*Tr[íi]ch|NXB|First News|Dịch[\s-]?giả|Nguồn:|Tạo bởi|vnthuquan|nguyenkimvy"


@query(
    "txt_cut_footer",
    f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN E'\\nNguồn: x\\nmore' ELSE E'\\nLe Loup' END AS text FROM documents),
    a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM t),
    b AS (SELECT doc_id, l[1:coalesce(list_min(list_transform(l, lambda s, i: CASE WHEN regexp_matches(s, '{_FOOT}') THEN i END)) - 1, len(l))] AS k FROM a),
    c AS (SELECT doc_id, k[1:coalesce(list_max(list_transform(k, lambda s, i: CASE WHEN NOT (regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '[À-ɏḀ-ỿ]')) THEN i END)), 0)] AS k FROM b)
    SELECT doc_id, len(k) AS n_lines, md5({Q.strip("coalesce(array_to_string(k, chr(10)), '')")}) AS digest FROM c""",
)
def txt_cut_footer(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, "\nNguồn: x\nmore").otherwise("\nLe Loup")
    body = T.cut_footer(F.concat("text", tail))
    n = F.when(body == "", 0).otherwise(F.size(F.split(body, "\n")))
    return read(spark, sf, "documents").select("doc_id", n.cast("long").alias("n_lines"), F.md5(body).alias("digest"))


_FANCY = "chr(8220) || text || chr(8221) || ' ' || chr(8211) || chr(8212) || chr(8230) || chr(160) || chr(8216) || chr(8217)"


def _fold_sql(x: str, dash: str) -> str:
    for a, b in ((8211, "'-'"), (8212, dash), (8216, "chr(39)"), (8217, "chr(39)"), (8220, "'\"'"), (8221, "'\"'"), (8230, "'...'")):
        x = f"replace({x}, chr({a}), {b})"
    return x


_fold_a = _fold_sql(f"replace({_FANCY}, chr(160), ' ')", "'-'")
_fold_b = _fold_sql(_FANCY, "', '")


@query("txt_fold_punctuation", f"SELECT doc_id, md5({_fold_a}) AS ascii_digest, md5({_fold_b}) AS teacher_digest FROM documents")
def txt_fold_punctuation(spark, sf):
    c = F.concat(F.lit("“"), "text", F.lit("” –—… ‘’"))
    return read(spark, sf, "documents").select("doc_id", F.md5(T.fold_ascii(c)).alias("ascii_digest"), F.md5(T.fold_teacher(c)).alias("teacher_digest"))


_NORM_OUT = Q.clean("replace(story, '**', '')")
_NORM_OUT = Q.sub(_NORM_OUT, r"(?i)\bThe moral of the story is\s*:", "Moral:")
_NORM_OUT = Q.sub(_NORM_OUT, r"(?i)\bThe moral\s*:", "Moral:")
_NORM_OUT = Q.strip(Q.sub(Q.sub(_NORM_OUT, r"(?i)\s*Moral\s*:\s*", "\n\nMoral: "), r"\n{3,}", "\n\n"))


@query(
    "txt_normalize_output",
    f"""WITH {STORIES}, a AS (SELECT doc_id, teaching, {_NORM_OUT} AS s FROM (SELECT doc_id, teaching, replace(story, 'Moral: k', 'The moral of the story is : **k') AS story FROM stories))
    SELECT doc_id, md5(CASE WHEN contains(lower(s), 'moral:') THEN s ELSE {Q.rstrip('s')} || E'\\n\\nMoral: ' || teaching END) AS digest FROM a""",
)
def txt_normalize_output(spark, sf):
    c = F.replace(F.col("story"), F.lit("Moral: k"), F.lit("The moral of the story is : **k"))
    return stories(spark, sf).select("doc_id", F.md5(T.normalize_output(c, F.col("teaching"))).alias("digest"))


_EMPTY = r"(?im)^\s*Moral\s*:\s*$"
_SYN = f"CASE WHEN contains(lower({Q.strip('story')}), 'moral:') THEN {Q.strip('story')} ELSE {Q.strip('story')} || E'\\n\\nMoral: ' || teaching END"
_REW = Q.sub(Q.sub(Q.sub(Q.strip("story"), r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
_REW = f"regexp_replace({_REW}, '{_EMPTY}', 'Moral: ' || teaching, 'g')"


@query(
    "txt_normalize_story",
    f"""WITH {STORIES}, a AS (SELECT doc_id, teaching, {_SYN} AS s, {_REW} AS r FROM stories)
    SELECT doc_id, md5({Q.strip(f"regexp_replace(s, '{_EMPTY}', 'Moral: ' || teaching, 'g')")}) AS synthetic_digest,
      md5({Q.strip(f"CASE WHEN contains(lower(r), 'moral:') THEN r ELSE {Q.rstrip('r')} || E'{chr(92)}n{chr(92)}nMoral: ' || teaching END")}) AS rewrite_digest FROM a""",
)
def txt_normalize_story(spark, sf):
    s, t = F.col("story"), F.col("teaching")
    return stories(spark, sf).select("doc_id", F.md5(T.normalize_synthetic(s, t)).alias("synthetic_digest"), F.md5(T.normalize_rewrite(s, t)).alias("rewrite_digest"))


def moral_line_sql(story: str = "story", teaching: str = "teaching") -> str:
    """Relation (doc_id, s) with one final moral line; of relation stories."""
    punct = lambda x: f"CASE WHEN {x} = '' OR regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END"
    fallback = f"CASE WHEN {Q.strip(teaching)} <> '' THEN 'Moral: ' || {punct(Q.strip(teaching))} ELSE 'Moral: Be kind and learn from each day.' END"
    return f"""(SELECT *, {Q.strip(f"CASE WHEN len(m) = 0 THEN {Q.rstrip('c')} || E'{chr(92)}n{chr(92)}n' || fb ELSE {Q.rstrip('b')} || E'{chr(92)}n{chr(92)}n' || CASE WHEN mt = '' THEN fb ELSE 'Moral: ' || {punct('mt')} END END")} AS fixed
      FROM (SELECT *, {Q.strip("coalesce(m[-1], '')")} AS mt, left(c, length(c) - length(coalesce(w[-1], '')) - length(tail)) AS b
        FROM (SELECT *, regexp_extract_all(c, '{Q.MORAL_LINE}', 1) AS m, regexp_extract_all(c, '{Q.MORAL_LINE}', 0) AS w, regexp_split_to_array(c, '{Q.MORAL_LINE}')[-1] AS tail, {fallback} AS fb
          FROM (SELECT *, {Q.strip(story)} AS c FROM stories))))"""


@query("txt_moral_line", f"WITH {STORIES} SELECT doc_id, md5(fixed) AS digest FROM {moral_line_sql()}")
def txt_moral_line(spark, sf):
    return stories(spark, sf).select("doc_id", F.md5(T.normalize_moral_line(F.col("story"), F.col("teaching"))).alias("digest"))


_CUT = "(text || ' unfinished ' || source)"
_HEAD = f"regexp_extract({_CUT}, '(?s)^(.*[.!?][\"”’'']?)', 1)"


@query(
    "txt_punctuate_and_trim",
    f"""SELECT doc_id, md5(CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END) AS punctuated,
      md5(CASE WHEN h = '' OR length(h) >= length(regexp_replace(c, '\\s+$', '')) THEN c ELSE h END) AS trimmed
    FROM (SELECT doc_id, {Q.strip('source')} AS t, {_CUT} AS c, {_HEAD} AS h FROM documents)""",
)
def txt_punctuate_and_trim(spark, sf):
    c = F.concat("text", F.lit(" unfinished "), "source")
    return read(spark, sf, "documents").select("doc_id", F.md5(T.punctuate(F.col("source"))).alias("punctuated"), F.md5(T.trim_to_last_sentence(c)).alias("trimmed"))


@query(
    "txt_story_and_topic_forms",
    f"""SELECT doc_id, md5({Q.strip(Q.sub(Q.sub(Q.strip("' <|story|>' || text || '</s><|end|> '"), '<' + chr(92) + '|[^|]*' + chr(92) + '|>'), '(?i)</?(?:story|s)>'))}) AS story,
      md5(trim({Q.sub('lower(text)', '[^a-z0-9]+', ' ')})) AS plain,
      {Q.strip(Q.sub(Q.sub("(doc_id || '. ' || CASE WHEN doc_id % 2 = 0 THEN 'XIV - ' ELSE '' END || source)", '^' + chr(92) + 'd+[-–.' + chr(92) + 's]+'), '^[IVXLCDM]+' + chr(92) + 's*[-.–]' + chr(92) + 's*'))} AS topic FROM documents""",
)
def txt_story_and_topic_forms(spark, sf):
    topic = F.concat(F.col("doc_id").cast("string"), F.lit(". "), F.when(F.col("doc_id") % 2 == 0, "XIV - ").otherwise(""), F.col("source"))
    return read(spark, sf, "documents").select("doc_id", F.md5(T.clean_story(F.concat(F.lit(" <|story|>"), "text", F.lit("</s><|end|> ")))).alias("story"), F.md5(T.normalized(F.col("text"))).alias("plain"), T.clean_topic(topic).alias("topic"))


@query("txt_nfc", "SELECT doc_id, md5(nfc_normalize(text || 'e' || chr(769))) AS digest FROM documents")
def txt_nfc(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.nfc(F.concat("text", F.lit("é")))).alias("digest"))


_ESC = "replace(replace(replace('**' || source || '** <i> & ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BOLD = Q.sub(_ESC, r"\*\*(.+?)\*\*", r"<strong>\1</strong>")


@query(
    "txt_light_markdown",
    f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(regexp_split_to_array({_BOLD}, '\\n{{2,}}'), lambda p: {Q.strip('p')} <> ''), lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '')) AS digest FROM documents""",
)
def txt_light_markdown(spark, sf):
    c = F.concat(F.lit("**"), "source", F.lit("** <i> & "), "text")
    return read(spark, sf, "documents").select("doc_id", F.md5(T.light_markdown(c)).alias("digest"))


@query(
    "tok_counts",
    f"""SELECT doc_id, len({Q.tokens('text')}) AS tokens, len({Q.words('text')}) AS words, len({Q.words2('text')}) AS words_apostrophe,
      md5(array_to_string({Q.normalized('text')}, ' ')) AS normalized, len({Q.found('lower(text)', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}) AS unicode_words FROM documents""",
)
def tok_counts(spark, sf):
    c, n = F.col("text"), lambda a: F.size(a).cast("long")
    return read(spark, sf, "documents").select("doc_id", n(T.tokens(c)).alias("tokens"), n(T.words(c)).alias("words"), n(T.words(c, T.WORDS_APOSTROPHE)).alias("words_apostrophe"), F.md5(F.array_join(T.normalized_words(c), " ")).alias("normalized"), n(T.unicode_words(c)).alias("unicode_words"))


@query("tok_content_words", f"SELECT doc_id, len(c) AS n, md5(array_to_string(list_sort(c), ' ')) AS digest FROM (SELECT doc_id, {Q.content('text')} AS c FROM documents)")
def tok_content_words(spark, sf):
    c = T.content_words(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(c), " ")).alias("digest"))


@query(
    "tok_ngrams",
    f"""WITH t AS (SELECT doc_id, {Q.tokens('text')} AS t FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM t)
    SELECT doc_id, count(*) AS bigrams, count(DISTINCT g) AS distinct_bigrams FROM g GROUP BY doc_id""",
)
def tok_ngrams(spark, sf):
    g = read(spark, sf, "documents").select("doc_id", F.explode(F.transform(T.ngrams(T.tokens(F.col("text")), 2), lambda x: F.array_join(x, " "))).alias("g"))
    return g.groupBy("doc_id").agg(F.count("*").alias("bigrams"), F.count_distinct("g").alias("distinct_bigrams"))


@query(
    "tok_sentences",
    f"""SELECT doc_id, len(l) AS sentences, {Q.longest('l')} AS longest, len(list_filter(l, lambda x: x > 32)) AS over_32, round(list_avg(l), 6) AS mean, len(p) AS paragraphs
    FROM (SELECT doc_id, {Q.lengths(Q.sentences('text'))} AS l, {Q.paragraphs("replace(text, chr(10), chr(10) || chr(10))")} AS p FROM documents)""",
)
def tok_sentences(spark, sf):
    lengths = T.word_lengths(T.sentences(F.col("text")))
    p = T.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    n = lambda a: F.size(a).cast("long")
    return read(spark, sf, "documents").select("doc_id", n(lengths).alias("sentences"), F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest"), n(F.filter(lengths, lambda x: x > 32)).alias("over_32"), F.round(T.mean(lengths), 6).alias("mean"), n(p).alias("paragraphs"))


@query(
    "tok_label_mask",
    f"""SELECT doc_id, len(l) AS n, list_sum(l) AS total FROM (SELECT doc_id, list_transform(i, lambda x, k: CASE WHEN k <= 5 THEN -100 ELSE x END) AS l FROM (SELECT doc_id, list_transform({Q.tokens('text')}, lambda w: length(w)) AS i FROM documents)) WHERE len(l) > 0""",
)
def tok_label_mask(spark, sf):
    ids = F.transform(T.tokens(F.col("text")), lambda w: F.length(w))
    labels = T.label_mask(ids, F.lit(5))
    out = read(spark, sf, "documents").select("doc_id", labels.alias("l")).where("size(l) > 0")
    return out.select("doc_id", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("tok_vocabulary", "SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY w")
def tok_vocabulary(spark, sf):
    return T.vocabulary(read(spark, sf, "documents"))


@query("tok_encode", "SELECT doc_id, len(i) AS n, CAST(list_sum(i) AS BIGINT) AS total FROM (SELECT doc_id, list_transform(string_split(left(text, 512), ''), lambda c: unicode(c)) AS i FROM documents)")
def tok_encode(spark, sf):
    """An injected encoder; here code points, so that no vocabulary is needed."""
    ids = T.encoder(lambda texts: [[ord(c) for c in t] for t in texts], 512)
    out = read(spark, sf, "documents").select("doc_id", ids(F.col("text")).alias("ids"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

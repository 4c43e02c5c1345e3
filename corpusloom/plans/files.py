"""Queries over what sources parse and sinks write (SRC-*, SNK-*, UDF-*): tables are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import injected
from corpusloom.functions import parse as P
from corpusloom.functions import rules as R
from corpusloom.operators import invariants, joins, sampling
from corpusloom.sources import readers, scratch, writers
from corpusloom.streaming import jobs

from .base import STORIES, Q, num, query, read, stories


@query("src_held_out", f"WITH {STORIES} SELECT doc_id, rtrim(input || chr(10), chr(10)) AS prompt, md5(story) AS digest FROM stories WHERE NOT contains(story, '<|')")
def src_held_out(spark, sf):
    s = stories(spark, sf).where("NOT contains(story, '<|')").withColumn("text", F.concat("input", F.lit("\n<|story|>"), "story", F.lit("<|end|>")))
    out = readers.held_out(F.col("text"), F.length("input") + 1)
    return s.select("doc_id", out["prompt"].alias("prompt"), F.md5(out["reference"]).alias("digest"))


@query("src_registry_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fable:4b' WHEN 'O' THEN 'fable:30m' ELSE o_orderstatus END AS tag, o_orderstatus IN ('F', 'O') AS found FROM orders")
def src_registry_lookup(spark, sf):
    table = spark.createDataFrame([("F", "fable:4b"), ("O", "fable:30m")], "o_orderstatus string, tag string")
    return joins.lookup(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), table, "o_orderstatus", "tag", F.col("o_orderstatus")).select("o_orderkey", "tag", "found")


@query("src_env_map", "SELECT doc_id, unnest(['LANG', 'SOURCE']) AS key, unnest([lang, source || ' x=1']) AS value FROM documents")
def src_env_map(spark, sf):
    lines = F.array(F.lit("# comment"), F.lit(""), F.concat(F.lit(" LANG = '"), "lang", F.lit("' ")), F.concat(F.lit("SOURCE=\""), "source", F.lit(" x=1\"")), F.lit("LANG=late"), F.lit("nothing"))
    return read(spark, sf, "documents").select("doc_id", F.explode(readers.env_map(lines)))


@query("src_sse_frames", "SELECT conv_id, turn, 'token' AS type, length(text) AS n FROM conversations")
def src_sse_frames(spark, sf):
    c = read(spark, sf, "conversations")
    body = F.concat(F.lit(": ping\n"), writers.sse(F.struct(F.lit("token").alias("type"), F.col("text").alias("content"))))
    return c.select("conv_id", "turn", F.explode(readers.sse_frames(body)).alias("e")).select("conv_id", "turn", "e.type", F.length("e.content").alias("n"))


@query("src_ndjson_text", "SELECT conv_id, turn, md5(text || role) AS digest FROM conversations")
def src_ndjson_text(spark, sf):
    piece = lambda c, done: F.to_json(F.struct(F.struct(c.alias("content")).alias("message"), F.lit(done).alias("done")))
    body = F.concat_ws("\n", piece(F.col("text"), False), F.lit(""), piece(F.col("role"), True), piece(F.lit("late"), False))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(readers.ndjson_text(body)).alias("digest"))


@query("src_page_sections", "SELECT page_id, len(regexp_split_to_array(html, '<!-- ad [0-9]+ -->')) - 1 AS sections FROM pages")
def src_page_sections(spark, sf):
    """SRC-09."""
    return read(spark, sf, "pages").select("page_id", F.size(readers.anchor_sections(F.col("html"), "<!-- ad [0-9]+ -->")).cast("long").alias("sections"))


@query("snk_manifest", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 10 = 0) AS valid, count(DISTINCT source) AS sources FROM documents")
def snk_manifest(spark, sf):
    d = read(spark, sf, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "valid").otherwise("train"))
    return writers.manifest(d).select("total", F.col("by_split")["valid"].alias("valid"), F.size("by_source").cast("long").alias("sources"))


@query("snk_filter_summary", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({Q.reasons({'short': 'n_chars < 500', 'long': 'n_chars > 4000', 'english': chr(34) + 'lang' + chr(34) + ' = ' + chr(39) + 'en' + chr(39)})}, ',')) AS reason FROM documents) WHERE reason <> '' GROUP BY reason")
def snk_filter_summary(spark, sf):
    why = R.reasons({"short": F.col("n_chars") < 500, "long": F.col("n_chars") > 4000, "english": F.col("lang") == "en"})
    return writers.filter_summary(read(spark, sf, "documents").select(why.alias("reasons")))


@query(
    "snk_report",
    f"""WITH r AS (SELECT source, n_chars, unnest(string_split({Q.reasons({'short': 'n_chars < 500', 'long': 'n_chars > 4000', 'other': chr(34) + 'lang' + chr(34) + ' <> ' + chr(39) + 'en' + chr(39)})}, ',')) AS reason FROM documents), c AS (SELECT source, reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY ALL)
    SELECT source, reason, n, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, reason) AS k FROM c) WHERE k <= 2""",
)
def snk_report(spark, sf):
    why = R.reasons({"short": F.col("n_chars") < 500, "long": F.col("n_chars") > 4000, "other": F.col("lang") != "en"})
    d = read(spark, sf, "documents").select("source", "n_chars", why.alias("reasons"), F.lit(1).alias("score"))
    return writers.report(d, "source", "n_chars", "score", "reasons", 2)[1]


@query("snk_report_figures", "SELECT source, count(*) AS n, min(n_chars) AS min_words, max(n_chars) AS max_words, round(avg(n_chars), 6) AS avg_words, round(avg(doc_id % 10), 6) AS avg_score FROM documents GROUP BY source")
def snk_report_figures(spark, sf):
    d = read(spark, sf, "documents").select("source", "n_chars", F.array(F.lit("x")).alias("reasons"), (F.col("doc_id") % 10).alias("score"))
    out = writers.report(d, "source", "n_chars", "score", "reasons")[0]
    return out.withColumn("avg_words", num(F.col("avg_words"))).withColumn("avg_score", num(F.col("avg_score")))


_STORY = "doc_id long, lang string, text string"


def _told(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", "text")


@query("src_jsonl_scan", "SELECT doc_id, lang, sha256(text) AS digest FROM documents")
def src_jsonl_scan(spark, sf):
    """SRC-01, 02, SNK-01: JSON lines with a blank line after each row; an absent path adds no rows."""
    d, path = _told(spark, sf), scratch.folder(spark, "jsonl")
    writers.jsonl(d.where("doc_id % 2 = 0"), f"{path}/a")
    d.where("doc_id % 2 <> 0").select(F.concat(F.to_json(F.struct(*d.columns)), F.lit("\n")).alias("value")).write.text(f"{path}/b")
    both = readers.jsonl(spark, f"{path}/a", _STORY).unionByName(readers.jsonl(spark, f"{path}/b", _STORY))
    both = both.unionByName(readers.jsonl(spark, f"{path}/none", _STORY, missing_ok=True))
    return both.select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@query("src_union_files", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def src_union_files(spark, sf):
    """SRC-05: several files read as one table."""
    d, path = _told(spark, sf).select("doc_id", "lang"), scratch.folder(spark, "union")
    writers.jsonl(d, f"{path}/all")
    writers.jsonl(d.where("doc_id % 2 = 0"), f"{path}/even")
    return readers.jsonl(spark, [f"{path}/all", f"{path}/even"], "doc_id long, lang string").groupBy("lang").agg(F.count("*").alias("n"))


@query("src_stream_scan", "SELECT doc_id, lang, sha256(text) AS digest FROM documents WHERE doc_id % 3 <> 0")
def src_stream_scan(spark, sf):
    """SRC-03: the files there are, as a stream that stops after the last."""
    path = scratch.folder(spark, "stream")
    writers.jsonl(_told(spark, sf), f"{path}/in")
    jobs.run_available(readers.stream(spark, f"{path}/in", _STORY), lambda df: df.where("doc_id % 3 <> 0"), f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.schema(_STORY).parquet(f"{path}/out").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@query("src_epub_pages", "SELECT page_id, unnest([0, 1]) AS spine_ord, sha256(unnest([html, url])) AS digest FROM pages")
def src_epub_pages(spark, sf):
    """SRC-06: an archive of every page, with its url as a second page that the manifest lists first."""
    import io
    import zipfile

    def pack(batches):
        for batch in batches:
            out = []
            for html, url in zip(batch["html"], batch["url"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("META-INF/container.xml", '<rootfile full-path="OPS/book.opf"/>')
                    z.writestr("OPS/book.opf", '<manifest><item id="a" href="a.xhtml"/><item href="b.xhtml" id="b"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine>')
                    z.writestr("OPS/a.xhtml", url)
                    z.writestr("OPS/b.xhtml", html)
                out.append(data.getvalue())
            yield batch[["path"]].assign(content=out)

    pages = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), "html", "url")
    found = readers.epub_pages(pages.mapInPandas(pack, "path string, content binary"))
    return found.select(F.col("source").cast("long").alias("page_id"), "spine_ord", F.sha2("html", 256).alias("digest"))


@query("src_book_pages", "SELECT 'book' || page_id % 7 AS source, row_number() OVER (PARTITION BY page_id % 7 ORDER BY lpad(CAST(page_id AS VARCHAR), 9, '0')) - 1 AS spine_ord, sha256(html) AS digest FROM pages WHERE page_id NOT IN (7, 8)")
def src_book_pages(spark, sf):
    """SRC-08: unpacked pages in the order of their names, without those of the skip list."""
    name = F.concat(F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".xhtml"))
    files = read(spark, sf, "pages").select(F.concat(F.lit("book"), (F.col("page_id") % 7).cast("string")).alias("source"), name.alias("name"), "html")
    return readers.in_spine_order(files, ["000000007.xhtml", "000000008.xhtml"]).select("source", "spine_ord", F.sha2("html", 256).alias("digest"))


_CLASSED = """replace(replace(replace(html, '<h1>', '<p class="calibre_3">7. '), '</h1>', '</p>'), '<p>', '<p class="calibre_3 x">')"""
_UNTAGGED = f"list_filter(list_transform({Q.found('page', '(?s)<p[^>]*class=\"calibre_3[^\"]*\"[^>]*>(.*?)</p>', 1)}, lambda x: {Q.strip(Q.sub(Q.sub('replace(' + Q.unescape(Q.sub('x', '<[^>]+>', ' ')) + ', chr(160), chr(32))', '[ \t]+', ' '), '\n{3,}', chr(10) * 2))}), lambda x: x <> '')"


def _classed(spark, sf):
    html = F.replace(F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit('<p class="calibre_3">7. ')), F.lit("</h1>"), F.lit("</p>")), F.lit("<p>"), F.lit('<p class="calibre_3 x">'))
    return read(spark, sf, "pages").select("page_id", P.classed_paragraphs(html, "calibre_3").alias("ps"))


@query(
    "src_numbered_stories",
    f"""WITH a AS (SELECT page_id, {_UNTAGGED} AS ps FROM (SELECT page_id, {_CLASSED} AS page FROM pages)), b AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM a),
    c AS (SELECT *, regexp_matches(p, '(?i)^chương\\s+[0-9]+') AS chapter, regexp_matches(p, '^[0-9]+\\s*[-–.]\\s*.+') AS numbered FROM b),
    d AS (SELECT *, sum(CAST(chapter OR numbered AS INT)) OVER (PARTITION BY page_id ORDER BY k) AS grp FROM c)
    SELECT page_id, any_value(p) FILTER (WHERE numbered) AS title, sha256(string_agg(p, chr(10) ORDER BY k) FILTER (WHERE NOT numbered)) AS digest FROM d WHERE grp > 0 GROUP BY page_id, grp HAVING count(*) FILTER (WHERE numbered AND NOT chapter) > 0 AND count(*) FILTER (WHERE NOT numbered) > 0""",
)
def src_numbered_stories(spark, sf):
    """SRC-07: paragraphs of a class, grouped under numbered titles."""
    return _classed(spark, sf).select("page_id", F.inline(P.numbered_stories(F.col("ps")))).select("page_id", "title", F.sha2("body", 256).alias("digest"))


@query(
    "src_titled_stories",
    f"""WITH a AS (SELECT page_id, {_UNTAGGED} AS ps FROM (SELECT page_id, {_CLASSED} AS page FROM pages)), b AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM a),
    t AS (SELECT page_id, min(k) AS place FROM b WHERE contains(p, '7. ') OR contains('7. ', p) GROUP BY page_id)
    SELECT page_id, sha256(coalesce(string_agg(p, chr(10) ORDER BY k) FILTER (WHERE k > place), '')) AS digest FROM pages LEFT JOIN b USING (page_id) LEFT JOIN t USING (page_id) GROUP BY page_id""",
)
def src_titled_stories(spark, sf):
    """SRC-08: what follows the paragraph with the title."""
    return _classed(spark, sf).select("page_id", F.sha2(P.titled_story(F.lit("7. "), F.col("ps")), 256).alias("digest"))


@query("src_json_documents", "SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_json_documents(spark, sf):
    """SRC-10: one document a file, over several lines."""
    n, path = read(spark, sf, "nation"), scratch.folder(spark, "documents")
    whole = n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("nations")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.regexp_replace(F.to_json(F.struct("r_name", "nations")), r"([\[{,])", "$1\n  ")
    whole.select("r_regionkey", body.alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    docs = readers.json_document(spark, path, "r_name string, nations array<struct<n_name:string,n_nationkey:long>>")
    return docs.select("r_name", F.inline("nations")).select("r_name", "n_name", "n_nationkey")


@query("src_csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def src_csv_round_trip(spark, sf):
    """SRC-11, SNK-07: fields in a fixed order behind a byte-order mark."""
    path = scratch.folder(spark, "csv")
    writers.csv(read(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], path)
    return readers.csv_with_bom(spark, path, "s_suppkey long, s_name string, s_nationkey long")


@query("snk_append_once", "SELECT doc_id, lang, sha256(text) AS digest FROM documents")
def snk_append_once(spark, sf):
    """SNK-02: a second call with all rows adds those that the first did not have."""
    d, path = _told(spark, sf), scratch.folder(spark, "append")
    writers.append_new(d.where("doc_id % 3 = 0"), path, ["doc_id"])
    writers.append_new(d.unionByName(d.where("doc_id % 5 = 0")), path, ["doc_id"])
    return readers.jsonl(spark, path, _STORY).select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@query("snk_markdown_lines", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation UNION ALL SELECT unnest(['| n_nationkey | n_name | n_regionkey |', '|---|---|---|'])")
def snk_markdown_lines(spark, sf):
    """SNK-06."""
    table = writers.markdown(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"))
    return spark.createDataFrame([(line,) for line in table.split("\n")], "line string")


_LISTED = "SELECT string_agg(n_name || chr(10), '' ORDER BY n_name) AS body FROM nation GROUP BY n_regionkey"


def _listed(spark, sf, name):
    """A file of nations for each region."""
    path = scratch.folder(spark, name)
    n = read(spark, sf, "nation").select("n_regionkey", F.col("n_name").alias("value"))
    n.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    return path


@query("snk_sha_manifest", f"SELECT strlen(body) AS bytes, sha256(body) AS sha256 FROM ({_LISTED})")
def snk_sha_manifest(spark, sf):
    """SNK-09."""
    return writers.sha_manifest(spark, _listed(spark, sf, "digests")).select("bytes", "sha256")


@query("snk_zip_folder", f"SELECT strlen(body) AS bytes, sha256(body) AS sha256 FROM ({_LISTED})")
def snk_zip_folder(spark, sf):
    """SNK-08: the archive's files, read back."""
    import io
    import zipfile

    archive = writers.zip_folder(spark, _listed(spark, sf, "files"), scratch.folder(spark, "archive") + ".zip")

    def unpack(batches):
        for batch in batches:
            with zipfile.ZipFile(io.BytesIO(batch["content"].iloc[0])) as z:
                yield batch.iloc[:0].assign(body=[]) if not z.namelist() else batch.iloc[[0] * len(z.namelist())][[]].assign(body=[z.read(n) for n in z.namelist()])

    bodies = spark.read.format("binaryFile").load(archive).select("content").mapInPandas(unpack, "body binary")
    return bodies.select(F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))


@query("snk_text_digests", "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents")
def snk_text_digests(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query(
    "qf_invariants",
    """SELECT 'documents' AS "table", count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS n_blank, count(*) FILTER (WHERE n_chars IS NULL OR n_chars < 0) AS n_outside, 0 AS n_missing, count(*) = count(DISTINCT doc_id) AND count(*) FILTER (WHERE trim(coalesce(text, '')) = '') = 0 AS ok FROM documents
    UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id), 0, count(*) FILTER (WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)), 1, false FROM labels""",
)
def qf_invariants(spark, sf):
    """QF-13: documents are checked against their columns; labels lack one that is asked for."""
    d = invariants.check(read(spark, sf, "documents"), "doc_id", ["doc_id", "text", "lang", "source", "n_chars"], ["text"], {"n_chars": (0, 10**9)})
    lab = invariants.check(read(spark, sf, "labels"), "doc_id", ["doc_id", "quality", "toxic", "judge"], ranges={"quality": (0, 1), "toxic": (0, 1)})
    shape = lambda df, name: df.select(F.lit(name).alias("table"), "n_rows", "n_keys", "n_blank", "n_outside", F.size("missing").alias("n_missing"), "ok")
    return shape(d, "documents").unionByName(shape(lab, "labels"))


@query("udf_translate", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text) ELSE sha256('xx: ' || text) END AS digest FROM documents")
def udf_translate(spark, sf):
    """UDF-05 with a stand-in; texts that it fails on stay."""

    def call(text):
        if text.startswith("!"):
            raise ValueError("refused")
        return "xx: " + text

    d = read(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("!"), "text")).otherwise(F.col("text")))
    said = injected.translator(call)(F.col("text"))
    return d.select("doc_id", F.sha2(F.regexp_replace(said, "^!", ""), 256).alias("digest"))


@query("udf_generate_and_judge", "SELECT item_id, 'success' AS status, 8 AS grammar, md5('Once: ' || text) AS digest FROM benchmark")
def udf_generate_and_judge(spark, sf):
    """UDF-01 to 03 with stand-ins for the models."""
    gen = injected.generator(lambda p: "Once: " + p)
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt")).withColumn("story", gen("prompt"))
    judged = injected.judge(b, "prompt", "story", lambda story, prompt: '{"grammar": {"score": 8, "reason": "ok"}}')
    return judged.select("item_id", "status", P.parse_scores(F.col("raw"))["grammar"].alias("grammar"), F.md5("story").alias("digest"))


@query(
    "pipeline_corpus_build",
    f"""WITH {STORIES}, a AS (SELECT doc_id, lang, {Q.collapse('story')} AS o, story FROM stories), f AS (SELECT doc_id, lang, sha1(lower(o)) AS k, length(o) BETWEEN 300 AND 6000 AS ok FROM a),
    g AS (SELECT k, min(doc_id) AS first FROM f WHERE ok GROUP BY k), c AS (SELECT f.doc_id, lang FROM f LEFT JOIN g USING (k) WHERE ok AND NOT coalesce(first < f.doc_id, false)),
    n AS (SELECT greatest(1, round_even(count(*) * 0.1, 0)) AS v FROM c) SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= (SELECT v FROM n) THEN 'valid' ELSE 'train' END AS split FROM c""",
)
def pipeline_corpus_build(spark, sf):
    """Section 3.1 end to end: clean, judge, drop copies of accepted rows, split."""
    from corpusloom.functions import text as T
    from corpusloom.operators import dedup

    s = stories(spark, sf).select("doc_id", "lang", T.clean_simple(F.col("story")).alias("output")).withColumn("ok", F.length("output").between(300, 6000))
    marked = dedup.mark_accepted_only(s, dedup.story_key(F.col("output")), F.col("ok"), "doc_id")
    return sampling.split_train_valid(marked.where("ok AND NOT duplicate").select("doc_id", "lang"), "doc_id", 0.1)


@query("pipeline_request_decisions", "SELECT conv_id, turn, 'ok' AS decision FROM conversations WHERE NOT regexp_matches(lower(text), 'hack|exploit|virus|sexual|porn|explicit|erotic|nude|nudity|fuck|shit|bitch|bastard|asshole|dick|cunt|nsfw|gore|gory')")
def pipeline_request_decisions(spark, sf):
    """Section 3.3: the guard over requests, the same function as on a stream."""
    from corpusloom.streaming.jobs import decide

    c = decide(read(spark, sf, "conversations"), ["text"])
    return c.where(~F.lower("text").rlike("hack|exploit|virus|sexual|porn|explicit|erotic|nude|nudity|fuck|shit|bitch|bastard|asshole|dick|cunt|nsfw|gore|gory")).select("conv_id", "turn", "decision")

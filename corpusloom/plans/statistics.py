"""Queries over AGG-* and the series of section 2.13; scores come from labels, orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import joins, stats

from .base import STORIES, Q, num, query, read, stories
from .judging import _FLUENCY, _FLUENT, _METRICS, metrics
from .relational import _JUDGED, _judged


@query("agg_quality_reasons_by_lang", f"WITH {STORIES}, r AS (SELECT lang, unnest(string_split({Q.reasons(_FLUENCY)}, ',')) AS reason FROM {_FLUENT}) SELECT lang, reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY ALL")
def agg_quality_reasons_by_lang(spark, sf):
    """The flagship: every rule of the fluency set over every story, counted by language."""
    s = R.facts(stories(spark, sf), "story", T.WORDS_APOSTROPHE)
    s = s.select("lang", R.reasons(R.fluency(F.col("input"))).alias("reasons"))
    return stats.reason_counts(s, "reasons", "lang")


@query("agg_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def agg_counts(spark, sf):
    return stats.counts(read(spark, sf, "documents"), "lang", "source")


_FLAGS = ["has_moral_label", "has_moral_footer", "empty_moral", "character_exact", "moral_exact", "outcome_covered", "clean_ending", "has_run_on_sentence"]
_RATE = lambda f: f"round(count(*) FILTER (WHERE ok AND {f}) / greatest(count(*) FILTER (WHERE ok), 1), 6) AS {f}_rate"


@query(
    "agg_success_rates",
    f"""{_METRICS}, m AS (SELECT *, doc_id % 9 <> 0 AS ok, doc_id % 4 * 100 AS latency_ms FROM metrics)
    SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success, {', '.join(map(_RATE, _FLAGS))}, round(avg(word_count) FILTER (WHERE ok), 6) AS avg_words, round(avg(latency_ms) FILTER (WHERE ok AND latency_ms <> 0), 6) AS avg_latency_ms FROM m""",
)
def agg_success_rates(spark, sf):
    m = metrics(spark, sf).withColumn("status", F.when(F.col("doc_id") % 9 != 0, "success").otherwise("error")).withColumn("latency_ms", F.col("doc_id") % 4 * 100)
    out = stats.success_rates(m, _FLAGS)
    return out.select(*(num(F.col(c)).alias(c) if c.endswith("_rate") or c.startswith("avg_") else F.col(c) for c in out.columns))


_UW = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(
    "agg_side_metrics",
    f"""WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS side, doc_id % 9 <> 0 AS ok, CASE WHEN doc_id % 13 = 0 THEN 'blocked' ELSE 'ok' END AS s, text, doc_id % 4 * 100 AS ms FROM documents),
    t AS (SELECT side, {_UW} AS t FROM d WHERE ok), u AS (SELECT side, unnest(t) AS g FROM t), b AS (SELECT side, unnest(list_transform(list_zip(t, t[2:], true), lambda z: z[1] || ' ' || z[2])) AS g FROM t WHERE len(t) > 1),
    d1 AS (SELECT side, round(count(DISTINCT g) / count(*), 6) AS distinct_1 FROM u GROUP BY side), d2 AS (SELECT side, round(count(DISTINCT g) / count(*), 6) AS distinct_2 FROM b GROUP BY side)
    SELECT side, count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE ok AND s <> 'ok') AS blocked_outputs,
      count(*) FILTER (WHERE ok AND {Q.word('lower(text)', 'moral|lesson|teaching')}) AS moral_outputs, round(avg(ms) FILTER (WHERE ok), 6) AS avg_latency_ms, any_value(distinct_1) AS distinct_1, any_value(distinct_2) AS distinct_2
    FROM d JOIN d1 USING (side) JOIN d2 USING (side) GROUP BY side""",
)
def agg_side_metrics(spark, sf):
    i = F.col("doc_id")
    d = read(spark, sf, "documents").select(F.when(i % 2 == 0, "base").otherwise("tuned").alias("side"), F.when(i % 9 != 0, "success").otherwise("error").alias("status"), F.when(i % 13 == 0, "blocked").otherwise("ok").alias("output_safety"), F.col("text").alias("story"), (i % 4 * 100).alias("latency_ms"))
    out = stats.side_metrics(d)
    return out.select(*(num(F.col(c)).alias(c) if c in ("avg_latency_ms", "distinct_1", "distinct_2") else F.col(c) for c in out.columns))


@query(
    "agg_axis_means",
    "WITH j AS (SELECT l_returnflag AS model, l_quantity AS grammar, l_discount * 100 AS creativity, l_tax * 100 AS clarity FROM lineitem), m AS (SELECT model, round(avg(grammar), 3) AS grammar, round(avg(creativity), 3) AS creativity, round(avg(clarity), 3) AS clarity FROM j GROUP BY model) SELECT *, round((grammar + creativity + clarity) / 3, 3) AS overall FROM m",
)
def agg_axis_means(spark, sf):
    j = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("grammar"), (F.col("l_discount") * 100).alias("creativity"), (F.col("l_tax") * 100).alias("clarity"))
    return stats.axis_means(j, ["grammar", "creativity", "clarity"], "model")


@query("agg_median_p95", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def agg_median_p95(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(num(stats.percentile("value", 0.5)).alias("median"), num(stats.percentile("value", 0.95)).alias("p95"), num(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query(
    "agg_bootstrap_ci",
    f"""WITH v AS (SELECT row_number() OVER (ORDER BY s_nationkey) - 1 AS i, avg(s_acctbal) AS v FROM supplier GROUP BY s_nationkey), n AS (SELECT count(*) AS n FROM v),
    d AS (SELECT r.r, {Q.uniform('42', 'r.r', 'k.k')} % n AS i FROM range(10000) r(r), (SELECT unnest(range((SELECT n FROM n))) AS k) k, n), m AS (SELECT r, avg(v) AS m FROM d JOIN v USING (i) GROUP BY r)
    SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, count(*) AS rounds FROM m""",
)
def agg_bootstrap_ci(spark, sf):
    """Nations stand in for the prompts of a benchmark, their suppliers' mean balance for the judged scores."""
    v = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v"))
    out = stats.bootstrap_ci(v, "s_nationkey", "v")
    return out.select(num(F.col("low"), 4).alias("low"), num(F.col("high"), 4).alias("high"), "rounds")


@query("agg_coverage", "SELECT lang, round(avg(CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'und') AS INT) + CAST(n_chars > 1000 AS INT)), 6) AS covered, round(avg(CAST(contains(text, 'the') AND n_chars > 1000 AS INT)), 6) AS both_rate FROM documents GROUP BY lang")
def agg_coverage(spark, sf):
    a, b, c = F.contains("text", F.lit("the")), F.contains("text", F.lit("und")), F.col("n_chars") > 1000
    return read(spark, sf, "documents").groupBy("lang").agg(num(F.avg(stats.coverage([a, b, c]))).alias("covered"), num(stats.both_rate(a, c)).alias("both_rate"))


@query("agg_by_intervention", f"WITH {_JUDGED} SELECT candidate_id, prompt_id % 3 AS intervention, count(*) AS n, round(avg(overall), 6) AS mean FROM judged GROUP BY ALL")
def agg_by_intervention(spark, sf):
    """AGG-10: a group without rows has no row."""
    j = joins.unblind(*_judged(spark, sf))
    return j.groupBy("candidate_id", (F.col("prompt_id") % 3).alias("intervention")).agg(F.count("*").alias("n"), num(F.avg("overall")).alias("mean"))


_TOK = f"WITH t AS (SELECT lang, {Q.tokens('text')} AS t FROM documents)"


@query(
    "agg_distinct_n",
    f"""{_TOK}, u AS (SELECT lang, unnest(t) AS g FROM t), b AS (SELECT lang, unnest(list_transform(list_zip(t, t[2:], true), lambda z: z[1] || ' ' || z[2])) AS g FROM t WHERE len(t) > 1)
    SELECT lang, d1 AS distinct_1, d2 AS distinct_2 FROM (SELECT lang, round(count(DISTINCT g) / count(*), 6) AS d1 FROM u GROUP BY lang) JOIN (SELECT lang, round(count(DISTINCT g) / count(*), 6) AS d2 FROM b GROUP BY lang) USING (lang)""",
)
def agg_distinct_n(spark, sf):
    t = read(spark, sf, "documents").select("lang", T.tokens(F.col("text")).alias("t"))
    one, two = stats.distinct_n(t, "lang", 1, "distinct_1"), stats.distinct_n(t, "lang", 2, "distinct_2")
    return one.join(two, "lang").select("lang", num(F.col("distinct_1")).alias("distinct_1"), num(F.col("distinct_2")).alias("distinct_2"))


@query(
    "agg_self_bleu",
    f"""WITH t AS (SELECT doc_id, lang, {Q.tokens('text')} AS t FROM documents), g AS (SELECT doc_id, lang, unnest(list_transform(list_zip(t, t[2:], true), lambda z: z[1] || ' ' || z[2])) AS g FROM t WHERE len(t) > 1),
    c AS (SELECT doc_id, lang, g, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id),
    p AS (SELECT a.lang, a.doc_id, sum(least(a.c, b.c)) AS s FROM c a JOIN c b ON a.g = b.g AND a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT lang, sum(s / n) AS s FROM p JOIN n USING (doc_id) GROUP BY lang), k AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
    SELECT lang, round(coalesce(s, 0) / (docs * (docs - 1) / 2), 6) AS self_bleu, docs FROM k LEFT JOIN l USING (lang)""",
)
def agg_self_bleu(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", "lang", T.tokens(F.col("text")).alias("t"))
    return stats.self_bleu(t, "doc_id", 2, "lang").select("lang", num(F.col("self_bleu")).alias("self_bleu"), "docs")


_SYL = "list_transform(w, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '([^aeiouy])e$', '\\1'), '[aeiouy]+'))))"


@query("agg_flesch", f"SELECT lang, round(avg(CASE WHEN len(w) > 0 THEN 206.835 - 1.015 * len(w) / s - 84.6 * list_sum({_SYL}) / len(w) ELSE 0 END), 6) AS flesch FROM (SELECT lang, {Q.words2('text')} AS w, greatest(1, len({Q.sentences('text')})) AS s FROM documents) GROUP BY lang")
def agg_flesch(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(num(F.avg(stats.flesch(F.col("text")))).alias("flesch"))


_PAIR = "(SELECT o_orderkey, o_orderpriority AS g, o_orderkey * 7 % 11 AS x, o_custkey * 5 % 11 AS y FROM orders)"


def _pair(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") * 7 % 11).alias("x"), (F.col("o_custkey") * 5 % 11).alias("y"))


@query("agg_kappa", f"SELECT g, round(1 - sum((x - y) ** 2) / (sum(x * x) + sum(y * y) - 2.0 * sum(x) * sum(y) / count(*)), 6) AS kappa, count(*) AS n FROM {_PAIR} GROUP BY g")
def agg_kappa(spark, sf):
    return stats.kappa(_pair(spark, sf), "x", "y", "g").withColumn("kappa", num(F.col("kappa")))


_TAU = f"""WITH c AS (SELECT g, x, y, count(*) AS c FROM {_PAIR} GROUP BY ALL), q AS (SELECT a.g, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s, sum(CASE WHEN a.x <> b.x THEN a.c * b.c ELSE 0 END) / 2 AS nx, sum(CASE WHEN a.y <> b.y THEN a.c * b.c ELSE 0 END) / 2 AS ny FROM c a JOIN c b USING (g) GROUP BY a.g)
  SELECT g, round(CASE WHEN nx = 0 OR ny = 0 THEN 0 ELSE s / (sqrt(nx) * sqrt(ny)) END, 6) AS tau, CAST((SELECT sum(c) FROM c WHERE c.g = q.g) AS BIGINT) AS n FROM q"""


@query("agg_kendall_tau", _TAU)
def agg_kendall_tau(spark, sf):
    return stats.tau(_pair(spark, sf), "x", "y", "g").withColumn("tau", num(F.col("tau")))


@query(
    "agg_panel_agreement",
    f"""WITH j AS (SELECT prompt_id, candidate_id AS judge, overall FROM (WITH {_JUDGED} SELECT * FROM judged)), p AS (SELECT a.judge AS "left", b.judge AS "right", a.overall AS x, b.overall AS y FROM j a JOIN j b USING (prompt_id) WHERE a.judge < b.judge),
    k AS (SELECT 1 - sum((x - y) ** 2) / (sum(x * x) + sum(y * y) - 2.0 * sum(x) * sum(y) / count(*)) AS kappa FROM p GROUP BY "left", "right") SELECT round(avg(kappa), 6) AS cohen_kappa, count(*) AS pairs FROM k""",
)
def agg_panel_agreement(spark, sf):
    """AGG-17: candidates stand in for judges of common prompts."""
    p = joins.ranked_pairs(joins.unblind(*_judged(spark, sf)), "candidate_id", "prompt_id", "overall")
    k = stats.kappa(p.withColumn("x", F.bround("left_value", 0)).withColumn("y", F.bround("right_value", 0)), "x", "y", "left", "right")
    return k.agg(num(F.avg("kappa")).alias("cohen_kappa"), F.count("*").alias("pairs"))


@query("agg_perplexity", "SELECT l_returnflag AS model, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) AS ppl, round(exp(sum(l_tax * l_quantity) / sum(l_quantity)) / exp(sum(l_discount * l_quantity) / sum(l_quantity)) - 1, 6) AS drift, abs(exp(sum(l_tax * l_quantity) / sum(l_quantity)) / exp(sum(l_discount * l_quantity) / sum(l_quantity)) - 1) <= 0.1 AS within FROM lineitem GROUP BY 1")
def agg_perplexity(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("a", F.col("l_discount") * F.col("l_quantity")).withColumn("b", F.col("l_tax") * F.col("l_quantity"))  # noqa: E741
    g = l.groupBy(F.col("l_returnflag").alias("model")).agg(stats.perplexity("a", "l_quantity").alias("before"), stats.perplexity("b", "l_quantity").alias("now"))
    change, within = stats.drift(F.col("now"), F.col("before"))
    return g.select("model", num(F.col("before")).alias("ppl"), num(change).alias("drift"), within.alias("within"))


@query(
    "agg_loss_by_position",
    """WITH a AS (SELECT user_id % 4 AS g, list(value ORDER BY event_id) AS l FROM events GROUP BY user_id), r AS (SELECT g, len(l) AS n, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS k FROM a),
    b AS (SELECT g, CAST(least(9, floor(k / n * 10)) AS INT) AS bin, avg(v) AS loss FROM r GROUP BY ALL) SELECT e.g, e.bin, round(loss, 6) AS loss FROM (SELECT DISTINCT g, CAST(x.x AS INT) AS bin FROM a CROSS JOIN range(10) x(x)) e LEFT JOIN b USING (g, bin)""",
)
def agg_loss_by_position(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"]).alias("l"))
    out = stats.loss_by_position(e.select((F.col("user_id") % 4).alias("g"), "l"), "l", 10, "g")
    return out.select("g", "bin", num(F.col("loss")).alias("loss"))


@query("agg_zipf", "SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM (SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, token LIMIT 2000)")
def agg_zipf(spark, sf):
    return stats.zipf(read(spark, sf, "documents"))


@query("agg_log_fit", "WITH z AS (SELECT n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM (SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, token LIMIT 2000)), k AS (SELECT greatest(1, count(*) // 10) AS s FROM z) SELECT round(regr_slope(ln(n), ln(rank)), 6) AS slope, round(regr_intercept(ln(n), ln(rank)), 6) AS intercept, round(regr_r2(ln(n), ln(rank)), 6) AS r2 FROM z, k WHERE rank > s")
def agg_log_fit(spark, sf):
    out = stats.log_fit(stats.zipf(read(spark, sf, "documents")), "rank", "n", "rank")
    return out.select(*(num(F.col(c)).alias(c) for c in out.columns))


@query(
    "agg_hist_overlap",
    """WITH d AS (SELECT lang, n_chars AS x FROM documents WHERE lang IN ('en', 'fr')), e AS (SELECT min(x) AS lo, max(x) AS hi FROM d), b AS (SELECT lang, least(14, floor((x - lo) / ((hi - lo) / 15.0))) AS bin FROM d, e),
    p AS (SELECT bin, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM b GROUP BY bin) SELECT round(sum(least(a / (SELECT sum(a) FROM p), b / (SELECT sum(b) FROM p))), 6) AS overlap FROM p""",
)
def agg_hist_overlap(spark, sf):
    return stats.histogram_overlap(read(spark, sf, "documents"), "n_chars", "lang", "en", "fr").select(num(F.col("overlap")).alias("overlap"))


@query("agg_fit_errors", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(avg((l_quantity - l_extendedprice) ** 2), 3) AS mse FROM lineitem")
def agg_fit_errors(spark, sf):
    out = stats.fit_errors(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(num(F.col("pearson")).alias("pearson"), F.round("mse", 3).alias("mse"))


@query("agg_spearman_ordinal", f"SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY x, o_orderkey) AS rx, row_number() OVER (ORDER BY y, o_orderkey) AS ry FROM {_PAIR})")
def agg_spearman_ordinal(spark, sf):
    return stats.spearman_ordinal(_pair(spark, sf), "x", "y", "o_orderkey").withColumn("spearman", num(F.col("spearman")))


@query("agg_pair_accuracy", f"SELECT g, round(avg(CAST(x > y AS INT)), 6) AS accuracy FROM {_PAIR} GROUP BY g")
def agg_pair_accuracy(spark, sf):
    return _pair(spark, sf).groupBy("g").agg(num(stats.pair_accuracy("x", "y")).alias("accuracy"))


@query("agg_headroom", f"SELECT g, round(avg(x), 6) AS mean, max(x) AS best, max_by(o_orderkey, x * 1000000000 - o_orderkey) AS best_key FROM {_PAIR} GROUP BY g")
def agg_headroom(spark, sf):
    """AGG-27: mean and best over candidates, and the best one, the first of equals."""
    return _pair(spark, sf).groupBy("g").agg(num(F.avg("x")).alias("mean"), F.max("x").alias("best"), F.max_by("o_orderkey", F.struct("x", -F.col("o_orderkey"))).alias("best_key"))


@query("agg_upper_median", "SELECT lang, min(n_chars) AS least, max(n_chars) AS greatest, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY lang")
def agg_upper_median(spark, sf):
    return stats.upper_median(read(spark, sf, "documents"), "n_chars", "lang").withColumn("mean", num(F.col("mean")))


@query("agg_human_eval", "SELECT model, criterion, round(avg(TRY_CAST(value AS DOUBLE)), 6) AS mean FROM (UNPIVOT (SELECT o_orderstatus AS model, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS fluency, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey % 5 + 1 AS VARCHAR) END AS safety FROM orders) ON fluency, safety INTO NAME criterion VALUE value) GROUP BY ALL")
def agg_human_eval(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), (F.col("o_orderkey") % 5 + 1).cast("string").alias("fluency"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_custkey") % 5 + 1).cast("string")).alias("safety"))
    return stats.criteria_means(o, "model", ["fluency", "safety"]).withColumn("mean", num(F.col("mean")))


@query("agg_corpus_shares", f"WITH {STORIES} SELECT round(avg(CAST(contains(lower(story), 'license') AS INT)), 6) AS phrase_share, round(avg(CAST(contains(input, 'Teaching:') AS INT)), 6) AS teaching_share FROM stories")
def agg_corpus_shares(spark, sf):
    """AGG-30."""
    return stories(spark, sf).agg(num(stats.share(R.has_phrase(F.col("story"), "license"))).alias("phrase_share"), num(stats.share(F.contains("input", F.lit("Teaching:")))).alias("teaching_share"))


@query("agg_eval_means", "SELECT o_orderstatus AS model, round(avg(o_orderkey % 10), 6) AS ov, round(avg(o_custkey % 10), 6) AS adh FROM orders GROUP BY 1")
def agg_eval_means(spark, sf):
    """AGG-31."""
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(num(F.avg(F.col("o_orderkey") % 10)).alias("ov"), num(F.avg(F.col("o_custkey") % 10)).alias("adh"))


@query("agg_weighted_loss", "SELECT event_type, round(exp(sum(least(value, 10) / 10 * k) / sum(k)), 6) AS ppl FROM (SELECT event_type, value, user_id % 50 + 1 AS k FROM events) GROUP BY event_type")
def agg_weighted_loss(spark, sf):
    e = read(spark, sf, "events").withColumn("k", F.col("user_id") % 50 + 1).withColumn("w", F.least("value", F.lit(10.0)) / 10 * F.col("k"))
    return e.groupBy("event_type").agg(num(stats.perplexity("w", "k")).alias("ppl"))


@query("scr_advantage", f"SELECT o_orderkey, CASE WHEN count(*) OVER w < 2 THEN 0.0 ELSE round((x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-4), 6) END AS advantage FROM (SELECT o_orderkey, x, g || (o_orderkey % 50) AS g FROM {_PAIR}) WINDOW w AS (PARTITION BY g)")
def scr_advantage(spark, sf):
    p = _pair(spark, sf).withColumn("g", F.concat("g", (F.col("o_orderkey") % 50).cast("string")))
    return stats.advantage(p, "g", "x").select("o_orderkey", num(F.col("advantage")).alias("advantage"))


@query(
    "scr_verdict_table",
    """WITH v AS (SELECT l_returnflag AS model, avg(l_discount) * 30 AS loss, avg(l_quantity) AS flesch FROM lineitem GROUP BY 1)
    SELECT model, 'loss' AS metric, round(loss, 6) AS value, CASE WHEN loss < 1.5 THEN 'PASS' WHEN loss < 2.0 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM v UNION ALL
    SELECT model, 'flesch', round(flesch, 6), CASE WHEN flesch BETWEEN 80 AND 100 THEN 'PASS' WHEN flesch BETWEEN 20 AND 80 THEN 'WARN' ELSE 'FAIL' END FROM v""",
)
def scr_verdict_table(spark, sf):
    v = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg((F.avg("l_discount") * 30).alias("loss"), F.avg("l_quantity").alias("flesch"))
    long, x = v.unpivot(["model"], ["loss", "flesch"], "metric", "value"), F.col("value")
    is_loss = F.col("metric") == "loss"
    out = F.when(is_loss, R.verdict(x, x < 1.5, x < 2.0)).otherwise(R.verdict(x, x.between(80, 100), x.between(20, 80)))
    return long.select("model", "metric", num(x).alias("value"), out.alias("verdict"))


@query("series_training_log", "UNPIVOT (SELECT event_id AS step, value AS loss, value / 2 AS grad_norm FROM events) ON loss, grad_norm INTO NAME metric VALUE value")
def series_training_log(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("value") / 2).alias("grad_norm"))
    return stats.training_series(e, "step", ["loss", "grad_norm"])


@query(
    "agg_candidate_summary",
    """SELECT o_orderstatus AS candidate, round(avg(o_custkey % 11), 6) AS mean, round(quantile_cont(CAST(o_custkey % 11 AS DOUBLE), 0.5), 6) AS median, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS non_empty, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS with_actions, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS with_action FROM orders GROUP BY 1""",
)
def agg_candidate_summary(spark, sf):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    o = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("candidate"), (F.col("o_custkey") % 11).alias("score"), F.when(k % 5 == 0, " ").otherwise("x").alias("story"), F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("moral_postprocess"))).otherwise(F.array(F.lit("moral_postprocess"), F.lit("rewrite"))).alias("actions"))
    out = stats.candidate_summary(o, "candidate", "score", "story", "actions", "rewrite")
    return out.withColumn("mean", num(F.col("mean"))).withColumn("median", num(F.col("median")))


_ONE = "CASE WHEN len(g) > 0 THEN round(len(list_distinct(g)) / len(g), 4) ELSE 0 END"


@query(
    "scr_evaluate_rows",
    f"""WITH a AS (SELECT doc_id, {Q.tokens('text')} AS t, {Q.words2('text')} AS w, greatest(1, len({Q.sentences('text')})) AS s FROM documents),
    b AS (SELECT *, list_transform(list_zip(t, t[2:], true), lambda z: z[1] || ' ' || z[2]) AS g2 FROM a)
    SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id % 9 + 1 ELSE 0 END AS grammar, {_ONE.replace('g)', 't)')} AS distinct_1, {_ONE.replace('g)', 'g2)')} AS distinct_2,
      CASE WHEN len(w) > 0 THEN round(206.835 - 1.015 * len(w) / s - 84.6 * list_sum({_SYL}) / len(w), 1) ELSE 0 END AS flesch FROM b""",
)
def scr_evaluate_rows(spark, sf):
    from .judging import _raw

    d = read(spark, sf, "documents").select("doc_id", "text", _raw().alias("raw"))
    out = stats.evaluate_rows(d, "text", "raw")
    return out.select("doc_id", F.col("grammar").cast("long").alias("grammar"), "distinct_1", "distinct_2", "flesch")

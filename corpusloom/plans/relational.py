"""Queries over DED-*, JOI-*, SET-*, SMP-*, RNK-* and WIN-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import dedup, joins, ordered, ranking, sampling, sets

from .base import STORIES, Q, num, query, read, stories

_KEY = f"sha1(lower({Q.collapse('text')}))"


def docs(spark, sf):
    return read(spark, sf, "documents").withColumn("ord", F.col("doc_id"))


# DED ---------------------------------------------------------------------------------------------------------------


@query("ded_first_exact", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def ded_first_exact(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.story_key(F.col("text"))).select("doc_id", "lang")


@query("ded_pair_key", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1(lower({Q.collapse('lang || chr(10) || text')})) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def ded_pair_key(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.pair_key(F.col("lang"), F.col("text"))).select("doc_id")


_OK = "(length(text) BETWEEN 200 AND 5000 AND doc_id % 3 <> 0)"


@query(
    "ded_accepted_only",
    f"""WITH a AS (SELECT doc_id, {_KEY} AS k, {_OK} AS ok FROM documents), f AS (SELECT k, min(doc_id) AS first FROM a WHERE ok GROUP BY k)
    SELECT doc_id, ok, coalesce(first < doc_id, false) AS duplicate FROM a LEFT JOIN f USING (k)""",
)
def ded_accepted_only(spark, sf):
    d = docs(spark, sf).withColumn("ok", F.length("text").between(200, 5000) & (F.col("doc_id") % 3 != 0))
    return dedup.mark_accepted_only(d, dedup.story_key(F.col("text")), F.col("ok")).select("doc_id", "ok", "duplicate")


@query(
    "ded_refilter_policies",
    f"""WITH a AS (SELECT doc_id, CASE WHEN length(text) < 500 THEN 'too_short' ELSE '' END AS r, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) > 1 AS dup FROM documents)
    SELECT doc_id, CASE WHEN NOT dup THEN r WHEN r = '' THEN 'duplicate_story' ELSE r || ',duplicate_story' END AS appended, CASE WHEN dup AND r = '' THEN 'duplicate_story' ELSE r END AS only FROM a""",
)
def ded_refilter_policies(spark, sf):
    d = docs(spark, sf)
    first = dedup.first_by(d, dedup.story_key(F.col("text"))).select("ord", F.lit(False).alias("dup"))
    marked = d.join(first, "ord", "left").withColumn("dup", F.coalesce("dup", F.lit(True)))
    why = R.reasons({"too_short": F.length("text") < 500})
    join = lambda policy: F.array_join(dedup.refilter_reasons(why, F.col("dup"), policy), ",")
    return marked.select("doc_id", join("append").alias("appended"), join("only").alias("only"))


@query("ded_prefix500", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left(lower({Q.sub('nfc_normalize(text)', chr(92) + 's+')}), 500) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def ded_prefix500(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.prefix_key(F.col("text"))).select("doc_id")


@query("ded_null_is_a_key", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY CASE WHEN doc_id % 4 = 0 THEN NULL ELSE sha256(text) END ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def ded_null_is_a_key(spark, sf):
    key = F.when(F.col("doc_id") % 4 != 0, F.sha2("text", 256))
    return dedup.first_by(docs(spark, sf), key).select("doc_id")


@query("ded_latest_per_key", "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def ded_latest_per_key(spark, sf):
    e = read(spark, sf, "events")
    return dedup.first_by(e, F.struct("user_id", "event_type"), "event_id", last=True).select("user_id", "event_type", "event_id", "value")


@query(
    "ded_priority_union",
    f"""WITH u AS (SELECT doc_id AS ord, 'chosen' AS src, 0 AS src_rank, left({Q.strip('text')}, 200) AS k FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'other', 1, left({Q.strip('text')}, 200) FROM documents)
    SELECT ord, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src_rank, ord) AS n FROM u WHERE k <> '') WHERE n = 1""",
)
def ded_priority_union(spark, sf):
    d = docs(spark, sf).select("ord", "text")
    return dedup.by_priority([(d.where("ord % 2 = 0"), "chosen"), (d, "other")], F.substring(T.strip(F.col("text")), 1, 200)).select("ord", "src")


@query(
    "ded_harvest",
    """WITH b AS (SELECT doc_id AS ord, text AS prompt, md5(text) AS story, (doc_id % 10) + 0.5 AS score FROM documents WHERE doc_id % 2 = 0),
    p AS (SELECT doc_id AS ord, text AS prompt, md5(text) AS chosen, (doc_id % 11) + 0.0 AS score_chosen FROM documents),
    k AS (SELECT prompt, max_by(story, ord) AS story, max_by(score, ord) AS score, 'sft_best' AS src FROM b WHERE score >= 5 GROUP BY prompt)
    SELECT * FROM k UNION ALL SELECT prompt, min_by(chosen, ord), min_by(score_chosen, ord), 'dpo_chosen' FROM p WHERE score_chosen >= 5 AND prompt NOT IN (SELECT prompt FROM k) GROUP BY prompt""",
)
def ded_harvest(spark, sf):
    d = docs(spark, sf).withColumn("prompt", F.col("text")).withColumn("story", F.md5("text"))
    best = d.where("doc_id % 2 = 0").select("ord", "prompt", "story", (F.col("doc_id") % 10 + 0.5).alias("score"))
    pairs = d.select("ord", "prompt", F.col("story").alias("chosen"), (F.col("doc_id") % 11 + 0.0).alias("score_chosen"))
    return dedup.harvest(best, pairs, 5.0)


@query("ded_prompt_ids", f"WITH {STORIES} SELECT substr(sha1(character || '|' || setting || '|' || teaching), 1, 12) AS id, count(*) AS n FROM stories GROUP BY 1")
def ded_prompt_ids(spark, sf):
    return stories(spark, sf).groupBy(dedup.prompt_id(F.col("character"), F.col("setting"), F.col("teaching")).alias("id")).agg(F.count("*").alias("n"))


# JOI, SET ----------------------------------------------------------------------------------------------------------


@query(
    "joi_failure_rows",
    """WITH b AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, text AS story FROM documents),
    r AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END AS story FROM documents WHERE doc_id % 2 = 0)
    SELECT b.id, trim(b.story) <> trim(r.story) AS changed, quality = 0 AS has_reasons FROM b JOIN r USING (id) JOIN labels ON labels.doc_id = b.id WHERE b.status = 'success' AND r.status = 'success' AND (quality = 0 OR trim(b.story) <> trim(r.story))""",
)
def joi_failure_rows(spark, sf):
    d, i = docs(spark, sf), F.col("doc_id")
    base = d.select(i.alias("id"), F.when(i % 7 == 0, "error").otherwise("success").alias("status"), F.col("text").alias("story"))
    repair = d.where(i % 2 == 0).select(i.alias("id"), F.when(i % 5 == 0, "error").otherwise("success").alias("status"), F.concat("text", F.when(i % 3 == 0, "!").otherwise("")).alias("story"))
    metrics = read(spark, sf, "labels").select(i.alias("id"), R.reasons({"bad": F.col("quality") == 0}).alias("reasons"))
    return joins.failure_rows(base, repair, metrics).select("id", "changed", (F.size("reasons") > 0).alias("has_reasons"))


def _judged(spark, sf):
    """Judgments under blind ids, and the map to candidates and prompts."""
    j = read(spark, sf, "labels").select(F.concat(F.lit("B"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("blind_id"), F.col("doc_id"), (F.col("doc_id") * 7 % 10 + 1).alias("overall"))
    m = read(spark, sf, "documents").select(F.concat(F.lit("B"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("blind_id"), F.concat(F.lit("e"), (F.col("doc_id") % 5 + 1).cast("string")).alias("candidate_id"), F.floor(F.col("doc_id") / 5).alias("prompt_id"))
    return j, m


_JUDGED = "judged AS (SELECT l.doc_id, 'e' || (l.doc_id % 5 + 1) AS candidate_id, l.doc_id // 5 AS prompt_id, l.doc_id * 7 % 10 + 1 AS overall FROM labels l JOIN documents d USING (doc_id))"


@query("joi_unblind", f"WITH {_JUDGED} SELECT candidate_id, count(*) AS n, sum(overall) AS total FROM judged GROUP BY candidate_id")
def joi_unblind(spark, sf):
    j, m = _judged(spark, sf)
    return joins.unblind(j, m).groupBy("candidate_id").agg(F.count("*").alias("n"), F.sum("overall").alias("total"))


@query("joi_unmatched", "SELECT 'B' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS blind_id, 'not judged' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def joi_unmatched(spark, sf):
    return joins.unmatched(*_judged(spark, sf))


@query("joi_attach", f"WITH {_JUDGED} SELECT candidate_id, prompt_id, overall, n_chars FROM judged JOIN documents USING (doc_id)")
def joi_attach(spark, sf):
    j, m = _judged(spark, sf)
    generated = read(spark, sf, "documents").select(F.concat(F.lit("e"), (F.col("doc_id") % 5 + 1).cast("string")).alias("candidate_id"), F.floor(F.col("doc_id") / 5).alias("prompt_id"), "n_chars")
    return joins.attach(joins.unblind(j, m), generated).select("candidate_id", "prompt_id", "overall", "n_chars")


@query(
    "joi_paired_conditions",
    f"WITH {_JUDGED}, a AS (SELECT prompt_id, overall FROM judged WHERE candidate_id = 'e1'), b AS (SELECT prompt_id, overall AS o FROM judged WHERE candidate_id = 'e2') SELECT coalesce(a.prompt_id, b.prompt_id) AS prompt_id, overall AS left_value, o AS right_value, overall IS NOT NULL AND o IS NOT NULL AS complete FROM a FULL JOIN b ON a.prompt_id = b.prompt_id",
)
def joi_paired_conditions(spark, sf):
    return joins.paired_conditions(joins.unblind(*_judged(spark, sf)), "prompt_id", "candidate_id", "e1", "e2", "overall")


@query(
    "joi_pairwise_win_tie_loss",
    f"""WITH {_JUDGED} SELECT a.candidate_id AS "left", b.candidate_id AS "right", round(avg(a.overall - b.overall), 6) AS mean_difference, count(*) FILTER (WHERE a.overall > b.overall) AS wins, count(*) FILTER (WHERE a.overall = b.overall) AS ties, count(*) FILTER (WHERE a.overall < b.overall) AS losses
    FROM judged a JOIN judged b ON a.prompt_id = b.prompt_id AND a.candidate_id < b.candidate_id GROUP BY 1, 2""",
)
def joi_pairwise_win_tie_loss(spark, sf):
    from corpusloom.operators import stats

    pairs = joins.ranked_pairs(joins.unblind(*_judged(spark, sf)), "candidate_id", "prompt_id", "overall")
    return stats.paired_summary(pairs, "left_value", "right_value", "left", "right").withColumn("mean_difference", num(F.col("mean_difference")))


@query(
    "joi_gram_overlap",
    f"""WITH t AS (SELECT doc_id, lang, {Q.tokens('text')} AS t FROM documents),
    g AS (SELECT doc_id, lang, unnest(list_transform(list_zip(t, t[2:], true), lambda z: z[1] || ' ' || z[2])) AS gram FROM t WHERE len(t) > 1),
    c AS (SELECT doc_id, lang, gram, count(*) AS c FROM g GROUP BY ALL),
    p AS (SELECT a.doc_id, sum(least(a.c, b.c)) AS shared FROM c a JOIN c b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT lang, doc_id, CAST(coalesce(any_value(shared), 0) AS BIGINT) AS shared, CAST(sum(c) AS BIGINT) AS total FROM c LEFT JOIN p USING (doc_id) GROUP BY lang, doc_id""",
)
def joi_gram_overlap(spark, sf):
    """Bigrams that each document shares with all later ones of its language."""
    t = read(spark, sf, "documents").select("doc_id", "lang", T.tokens(F.col("text")).alias("t"))
    return joins.gram_overlap(t, "doc_id", 2, "lang")


@query("joi_paired_difference", f"WITH {_JUDGED} SELECT a.prompt_id, a.overall - b.overall AS difference FROM judged a JOIN judged b ON a.prompt_id = b.prompt_id AND a.candidate_id = 'e2' AND b.candidate_id = 'e5'")
def joi_paired_difference(spark, sf):
    return joins.paired_difference(joins.unblind(*_judged(spark, sf)), "prompt_id", "candidate_id", "e2", "e5", "overall")


@query("joi_lookup_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)")
def joi_lookup_default(spark, sf):
    return joins.lookup(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id", "quality", F.lit(-1))


@query("joi_resume_pending", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND (doc_id, lang) NOT IN (SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0)")
def joi_resume_pending(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang")
    return joins.pending(joins.pending(d, read(spark, sf, "labels"), keys=["doc_id"]), d.where("doc_id % 3 = 0"), keys=["doc_id", "lang"])


@query("joi_by_position", "SELECT l.doc_id, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id // 2")
def joi_by_position(spark, sf):
    rows = read(spark, sf, "labels").select("doc_id", F.floor(F.col("doc_id") / 2).alias("i"))
    table = read(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang")
    return joins.by_position(rows, table, "i").select("doc_id", "lang")


@query("joi_listed_tokens", f"SELECT doc_id FROM documents WHERE list_has_any({Q.tokens('lower(text)')}, ['idiot', 'und', 'license'])")
def joi_listed_tokens(spark, sf):
    return joins.with_listed_tokens(read(spark, sf, "documents"), T.tokens(F.lower("text")), ["idiot", "und", "license"]).select("doc_id")


@query("joi_grid", "SELECT item_id, r_name, use_case FROM benchmark CROSS JOIN region CROSS JOIN (VALUES ('full'), ('two_slot')) AS u(use_case)")
def joi_grid(spark, sf):
    uses = spark.createDataFrame([("full",), ("two_slot",)], "use_case string")
    return joins.grid(read(spark, sf, "benchmark").select("item_id"), read(spark, sf, "region").select("r_name"), uses)


@query("set_operations", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left, count(DISTINCT d.doc_id) AS shared FROM documents d JOIN labels l USING (doc_id)")
def set_operations(spark, sf):
    d, lab = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id")
    left = sets.difference(d, lab, ["doc_id"]).agg(F.count("*").alias("only_left"))
    return left.crossJoin(F.broadcast(sets.intersection(d, lab, ["doc_id"]).agg(F.count("*").alias("shared"))))  # single rows


@query("set_relation", "SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS left_n, (SELECT count(DISTINCT doc_id) FROM documents) AS right_n, (SELECT count(DISTINCT doc_id) FROM labels) AS shared_n, true AS is_subset, (SELECT count(DISTINCT doc_id) FROM labels) = (SELECT count(*) FROM documents) AS is_equal")
def set_relation(spark, sf):
    return sets.relation(read(spark, sf, "labels"), read(spark, sf, "documents"), ["doc_id"])


_BAG = lambda lang: f"(SELECT w, count(*) AS n FROM (SELECT unnest({Q.words('lower(text)')}) AS w FROM documents WHERE lang = '{lang}') GROUP BY w)"


@query("set_bag_intersection", f"SELECT a.w, least(a.n, b.n) AS n FROM {_BAG('fr')} a JOIN {_BAG('es')} b USING (w)")
def set_bag_intersection(spark, sf):
    d = read(spark, sf, "documents")
    bag = lambda lang: d.where(F.col("lang") == lang).select(F.explode(T.words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return sets.bag_intersection(bag("fr"), bag("es"), ["w"])


@query("set_first_mapping", "SELECT doc_id, lang AS a, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE source END AS b FROM documents")
def set_first_mapping(spark, sf):
    one = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.col("lang")))
    m = sets.first_mapping(one, F.create_map(F.lit("a"), F.lit("late"), F.lit("b"), F.col("source")))
    return read(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


# SMP ---------------------------------------------------------------------------------------------------------------

_ORDER = lambda seed: f"md5('{seed}|' || doc_id), doc_id"


@query("smp_train_valid", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_ORDER(42)}) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.1, 0)) THEN 'valid' ELSE 'train' END AS split FROM documents")
def smp_train_valid(spark, sf):
    return sampling.split_train_valid(read(spark, sf, "documents").select("doc_id"), "doc_id", 0.1)


@query("smp_small_split", "SELECT r_regionkey AS doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || r_regionkey), r_regionkey) <= 1 THEN 'valid' ELSE 'train' END AS split FROM region")
def smp_small_split(spark, sf):
    return sampling.split_small(read(spark, sf, "region").select(F.col("r_regionkey").alias("doc_id")), "doc_id", 0.1)


@query("smp_three_way", f"SELECT doc_id, CASE WHEN k <= n // 10 THEN 'val' WHEN k <= 2 * (n // 10) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER(42)}) AS k, count(*) OVER () AS n FROM documents)")
def smp_three_way(spark, sf):
    return sampling.split_three(read(spark, sf, "documents").select("doc_id"), "doc_id")


@query("smp_reward_split", f"SELECT doc_id, CASE WHEN k <= greatest(30, n // 10) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER(7)}) AS k, count(*) OVER () AS n FROM labels)")
def smp_reward_split(spark, sf):
    return sampling.split_reward(read(spark, sf, "labels").select("doc_id"), "doc_id", 7)


@query("smp_nested_sizes", f"SELECT doc_id, unnest(list_filter([10, 50, 200], lambda s: k <= s)) AS size FROM (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER(42)}) AS k FROM documents)")
def smp_nested_sizes(spark, sf):
    return sampling.nested_sizes(read(spark, sf, "documents").select("doc_id"), "doc_id", [10, 50, 200])


_BLANK = lambda slot, p: f"CASE WHEN {Q.uniform('42|all', 'doc_id')} < {int(0.05 * 2**32)} OR {Q.uniform('42|' + slot, 'doc_id')} < {int(p * 2**32)} THEN '' ELSE {slot} END AS {slot}"


@query("smp_slot_dropout", f"WITH {STORIES} SELECT doc_id, {_BLANK('character', 0.3)}, {_BLANK('setting', 0.3)}, {_BLANK('teaching', 0.15)} FROM stories")
def smp_slot_dropout(spark, sf):
    s = stories(spark, sf).select("doc_id", "character", "setting", "teaching")
    return sampling.slot_dropout(s, "doc_id", ["character", "setting", "teaching"], overrides={"teaching": 0.15})


@query(
    "smp_augment",
    f"""WITH s AS (SELECT doc_id FROM labels WHERE quality = 0), n AS (SELECT greatest(0, 120 - count(*)) AS need FROM s), p AS (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER(42)}) AS k FROM labels WHERE quality = 1)
    SELECT doc_id, CAST(NULL AS VARCHAR) AS label FROM s UNION ALL SELECT doc_id, ['a', 'b', 'c', 'd', 'e'][(k - 1) % 5 + 1] FROM p, n WHERE k <= need""",
)
def smp_augment(spark, sf):
    lab = read(spark, sf, "labels")
    return sampling.augment(lab.where("quality = 0").select("doc_id"), lab.where("quality = 1").select("doc_id"), "doc_id", 120, list("abcde"))


@query("smp_combinations", "SELECT r_name, n_name, seg FROM region CROSS JOIN nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) ORDER BY md5('5|' || r_name || '|' || n_name || '|' || seg), r_name, n_name, seg LIMIT 40")
def smp_combinations(spark, sf):
    dims = [read(spark, sf, "region").select("r_name"), read(spark, sf, "nation").select("n_name"), read(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()]
    return sampling.combinations(dims, 5, 40)


@query("smp_step_batches", "SELECT step, item_id, k FROM (SELECT step, item_id, row_number() OVER (PARTITION BY step ORDER BY md5('42|' || step || '|' || item_id), item_id) AS k FROM benchmark CROSS JOIN range(5) AS r(step)) WHERE k <= 8")
def smp_step_batches(spark, sf):
    steps = spark.range(5).withColumnRenamed("id", "step")
    return sampling.batches(read(spark, sf, "benchmark").select("item_id"), "item_id", steps, 8)


# RNK, WIN ----------------------------------------------------------------------------------------------------------


@query("rnk_sort_key", f"SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, {_KEY}, doc_id) AS rank FROM documents")
def rnk_sort_key(spark, sf):
    """RNK-01: by score, then key."""
    d = read(spark, sf, "documents").select("doc_id", "n_chars", dedup.story_key(F.col("text")).alias("key"))
    return ordered.ranked(d, [F.desc("n_chars"), F.col("key"), F.col("doc_id")]).select("doc_id", "rank")


@query("rnk_models", f"WITH {_JUDGED}, m AS (SELECT candidate_id AS model, avg(overall) AS overall, min(doc_id) AS ord FROM judged GROUP BY 1) SELECT model, round(overall, 6) AS overall, row_number() OVER (ORDER BY overall DESC, ord) AS rank FROM m")
def rnk_models(spark, sf):
    m = joins.unblind(*_judged(spark, sf)).groupBy(F.col("candidate_id").alias("model")).agg(F.avg("overall").alias("overall"), F.min("doc_id").alias("ord"))
    return ranking.rank_models(m).select("model", num(F.col("overall")).alias("overall"), "rank")


@query("rnk_conclusion", f"WITH {_JUDGED}, m AS (SELECT candidate_id AS model, avg(overall) AS overall, min(doc_id) AS ord FROM judged GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY overall DESC, ord) AS rank FROM m) SELECT min_by(model, rank) AS winner, 'By rank: ' || string_agg(model || ' (' || printf('%.2f', overall) || ')', ' > ' ORDER BY rank) AS by_rank FROM r")
def rnk_conclusion(spark, sf):
    m = joins.unblind(*_judged(spark, sf)).groupBy(F.col("candidate_id").alias("model")).agg(F.avg("overall").alias("overall"), F.min("doc_id").alias("ord"))
    return ranking.conclusion(ranking.rank_models(m))


@query("rnk_size_ladder", "SELECT l_returnflag AS model, CASE l_returnflag WHEN 'A' THEN 30.0 WHEN 'N' THEN 60.0 END AS params FROM (SELECT DISTINCT l_returnflag FROM lineitem) WHERE l_returnflag IN ('A', 'N')")
def rnk_size_ladder(spark, sf):
    return ranking.ladder(read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model")).distinct(), {"N": 60.0, "A": 30.0})


@query("rnk_best_of_n", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_shippriority_like DESC, o_orderkey) AS k FROM (SELECT *, floor(o_totalprice / 50000) AS o_shippriority_like FROM orders)) WHERE k = 1")
def rnk_best_of_n(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.floor(F.col("o_totalprice") / 50000).alias("score"))
    return ranking.best_of(o, "o_custkey", "score", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "rnk_early_accept",
    """WITH s AS (SELECT l_orderkey, l_linenumber AS k, l_quantity AS s FROM lineitem)
    SELECT l_orderkey, CAST(coalesce(min(k) FILTER (WHERE s >= 40), min(k) FILTER (WHERE s = m)) AS BIGINT) AS k, count(*) FILTER (WHERE s >= 40) > 0 AS accepted, max(s) AS best_score FROM (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS m FROM s) GROUP BY l_orderkey""",
)
def rnk_early_accept(spark, sf):
    return ranking.early_accept(read(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber", 40.0)


@query("rnk_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def rnk_head(spark, sf):
    return ranking.head(read(spark, sf, "documents").select("doc_id"), "doc_id", 25)


@query("rnk_head_per_group", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 10")
def rnk_head_per_group(spark, sf):
    return ranking.top_per_group(read(spark, sf, "documents"), "lang", ["doc_id"], 10).select("lang", "doc_id")


@query(
    "rnk_stop_after_accepted",
    """WITH a AS (SELECT doc_id, length(text) BETWEEN 500 AND 3000 AS ok FROM documents), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (ORDER BY doc_id) AS c FROM a)
    SELECT count(*) AS scanned, count(*) FILTER (WHERE ok) AS accepted, max(doc_id) AS last_doc FROM r WHERE c < 100 OR (c = 100 AND ok)""",
)
def rnk_stop_after_accepted(spark, sf):
    rows = ordered.first_accepted(read(spark, sf, "documents").withColumn("n", F.length("text")).select("doc_id", "n"), "doc_id", F.col("n").between(500, 3000), 100)
    return rows.agg(F.count("*").alias("scanned"), F.count(F.when(F.col("ok"), 1)).alias("accepted"), F.max("doc_id").alias("last_doc"))


@query("win_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def win_moving_average(spark, sf):
    return ordered.moving_average(read(spark, sf, "events"), "event_type", "event_id", "value").select("event_id", num(F.col("smooth")).alias("smooth"))


@query("win_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def win_forward_fill(spark, sf):
    c = read(spark, sf, "conversations")
    return ordered.forward_fill(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "asked").select("conv_id", "turn", "asked")


@query("win_marker_groups", "SELECT conv_id, grp, count(*) AS n FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations) GROUP BY ALL")
def win_marker_groups(spark, sf):
    return ordered.marker_groups(read(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user").groupBy("conv_id", "grp").agg(F.count("*").alias("n"))


_QUOTA = """WITH r AS (SELECT doc_id, contains(lower(text), 'the') AS has FROM documents),
  p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, (SELECT count(*) FROM r q WHERE NOT q.has AND q.doc_id < r.doc_id) AS n FROM r WHERE has),
  g AS (SELECT doc_id, i, CAST(ceil(3 * (n + 1) / 7.0) AS BIGINT) - i AS d FROM p),
  m AS (SELECT doc_id, i + least(0, min(d) OVER (ORDER BY doc_id)) AS p FROM g), k AS (SELECT doc_id, p > coalesce(lag(p) OVER (ORDER BY doc_id), 0) AS kept FROM m)
  SELECT doc_id, false AS has FROM r WHERE NOT has UNION ALL SELECT doc_id, true FROM k WHERE kept"""


@query("win_phrase_quota", _QUOTA)
def win_phrase_quota(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.lower("text").contains("the").alias("has"))
    return ordered.phrase_quota(d, "doc_id", F.col("has"), 3, 10)


@query("win_position_ids", f"SELECT doc_id, 'B' || lpad(CAST(row_number() OVER (ORDER BY {_ORDER(20260726)}) AS VARCHAR), 7, '0') AS position_id FROM documents")
def win_position_ids(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    return ranking.numbered(ordered.ranked(d, [sampling.digest(20260726, F.col("doc_id")), F.col("doc_id")]), "B", width=7).select("doc_id", "position_id")

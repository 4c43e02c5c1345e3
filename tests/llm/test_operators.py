"""Operators on small tables: edges with defined results, and brute-force versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.common import part_by_members
from corpusloom.llm import bpe, components, html_extract, langid, media, order_minhash, packing, quality, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, fp string, grp int, score string, s int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t), 7, "f", 1, "z", 3) for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", " ", "a", "the fox " * 3000, "same text here now", "same text here now", "été 日本 🙂", "\x00\t\n", "x" * 5000]


# 1, 2


def test_pack(spark):
    tokenizer = P.path("byte_bpe_50k.json")
    got = packing.pack(docs(spark, ODD, [0, 1, 2, 3, 4, 5, 5, 7, None, None]), tokenizer, 64, 4).collect()
    encode = packing.load_encoder(tokenizer)
    ids = [[*e, 0] for e in encode([t or "" for t in ODD])]
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    want = sorted((i, s, zlib.crc32(np.array(x[s : s + 64], "<u4")), len(x)) for i, x in zip([0, 1, 2, 3, 4, 5, 5, 7, -1, -1], ids) for s in range(0, len(x), 64))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(docs(spark, ODD).limit(0), tokenizer).count() == 0


def test_bpe_round_trip(spark):
    d, path = docs(spark, ODD), P.path("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.round_trip(d, path, P.PATTERN, keep=["doc_id"]).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(ODD))
    coded = bpe.encode(d, path, P.PATTERN)
    assert coded.columns == [*d.columns, "token_ids"]
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(coded, path, P.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(ODD))
    assert bpe.encode(d.limit(0), path, P.PATTERN).count() == 0


# 3


def test_extract(spark):
    field = html_extract.train(html_extract.labelled_pages(300))
    body = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>First one &amp; all.</p><p>Second one.</p></article><footer>&copy; us</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", body, "old"), (2, "u", None, "old"), (3, "u", "", "old"), (1, "u", body, "old")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, field).select("page_id", "text", "n_chars").collect()
    want = "Title here\n\nFirst one & all.\n\nSecond one."
    assert sorted(tuple(r) for r in got) == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0)]
    assert html_extract.extract(pages.limit(0), field).count() == 0


# 4, 6


def labelled(spark, n=60):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "ten"]) for _ in range(3)) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choice(["KA", "LO"]) for _ in range(2)) + "!!" for _ in range(60))
    texts = [good() if i % 2 else bad() for i in range(n)]
    insults = [good()[:150] + f" zorba{rng.choice(['ka', 'lo', 'mi'])} " + good() if i % 2 else good() for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)] + [(None, 1, 1), (3, None, None), (999999, 0, 0)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), docs(spark, insults), labels


def test_learning_from_odd_tables(spark):
    """Of several texts of an id the least is learned from, whatever the order of rows; names used inside do no harm."""
    d, insults, labels = labelled(spark)
    twice = d.unionByName(d.withColumn("text", F.concat(F.lit("~ another text of the same id, "), "text")))
    models = [quality.train(x, labels, excerpts=10, calibrated=20) for x in (twice, twice.orderBy(F.desc("text")).repartition(5))]
    assert models[0]["good"] == models[1]["good"] and all((a == b).all() for a, b in zip(models[0]["model"], models[1]["model"]))
    odd = d.withColumns({n: F.lit("mine") for n in ("__id", "__y", "__text", "__use", "good_size", "raw_size")})
    scored = quality.score(odd, models[0])
    assert scored.where("__id = 'mine' AND __text = 'mine' AND good_size = 'mine'").count() == d.count()
    twice = insults.unionByName(insults.withColumn("text", F.upper("text")))
    models = [toxicity.train(x, labels) for x in (twice, twice.orderBy(F.desc("text")).repartition(5))]
    assert models[0]["stems"] == models[1]["stems"] and all((a == b).all() for a, b in zip(models[0]["model"], models[1]["model"]))
    odd = odd.withColumn("e0", F.lit("mine"))
    assert toxicity.score(odd, toxicity.train(odd, labels)).where("__id = 'mine' AND e0 = 'mine'").count() == d.count()


def test_quality(spark):
    d, _, labels = labelled(spark)
    model = quality.train(d, labels, excerpts=10, calibrated=20)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in got) / len(got) > 0.95
    odd = quality.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.train(d, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(d, None).collect()} == {0.5}
    assert quality.score(d.limit(0), model).count() == 0


def test_toxicity(spark):
    _, d, labels = labelled(spark, 240)
    model = toxicity.train(d, labels)
    assert any(s.startswith("zorb") for s in model["stems"])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in got)
    odd = toxicity.score(docs(spark, [*ODD, "you stupid moron"]), model).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[-1]["score"] > 0.7 > odd[0]["score"]
    bare = toxicity.train(d.limit(0), labels.limit(0))
    assert [r["score"] > 0.5 for r in toxicity.score(docs(spark, ["you stupid moron", "hello"]), bare).orderBy("doc_id").collect()] == [True, False]


# 5


def brute_repeats(rows, length, keep):
    """rows: (id, text) in order of id; removed bytes of each row."""
    seen = {}
    for n, (_, t) in enumerate(rows):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((n, p))
    out = []
    for n, (_, t) in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            places = seen[t[p : p + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (n, p)):
                gone[p : p + length] = True
        out.append(gone)
    return out


def repeated_corpus(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    passages = [word(rng.randint(30, 120)) for _ in range(4)]
    texts = [None, "", word(39), word(40)]
    for _ in range(60):
        texts.append("".join(rng.choice([word(rng.randint(1, 60)), rng.choice(passages), rng.choice(passages)[:45]]) for _ in range(rng.randint(1, 4))))
    hot = word(90)
    texts += [word(rng.randint(5, 25)) + hot + word(rng.randint(5, 25)) for _ in range(60)]  # a passage of half the rows
    texts += [texts[10]] * 5 + ["ab" * 100, "a" * 130]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("group, ranges", [(4000, 4), (3, 4), (4000, 97)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup(spark, keep, group, ranges):
    """Small ranges put many anchors and stretches over their ends."""
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        check_suffix_dedup(spark, keep, group)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def check_suffix_dedup(spark, keep, group):
    texts = repeated_corpus(group)
    got = suffix_dedup.strip_repeats(docs(spark, texts), keep, length=40, digest=True, group=group, gram=15).collect()
    raw = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    want = brute_repeats(raw, 40, keep)
    assert len(got) == len(texts)
    for r in got:
        t, gone = np.frombuffer(raw[r["doc_id"]][1], np.uint8), want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(t[~gone].tobytes()).hexdigest()
        assert (r["n_bytes"], r["n_removed"]) == (len(t), int(gone.sum()))
        assert r["n_spans"] == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


def test_suffix_dedup_edges(spark):
    long = "abcdefghij" * 30
    same = docs(spark, [long, long, "short"], [4, 4, None])
    got = suffix_dedup.strip_repeats(same, "none", digest=True).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0, 300, 300]  # repeated rows are copies of one another
    out = suffix_dedup.strip_repeats(docs(spark, ODD), "first")
    assert sorted(out.columns) == sorted(docs(spark, ODD).columns) and out.count() == len(ODD)
    assert suffix_dedup.strip_repeats(same.limit(0), "first").count() == 0
    # of rows alike in id and text one keeps it; an earlier id goes first
    long = " ".join(str(i * i) for i in range(90))
    again = docs(spark, [long, long, long, "short", "short", None, None], [4, 4, 5, 6, 6, None, None])
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in suffix_dedup.strip_repeats(again, "first").collect()) == [(0, ""), (0, ""), (4, ""), (4, long), (5, ""), (6, "short"), (6, "short")]
    # names that the operator uses inside, in any case
    odd = same.withColumns({n: F.lit("mine") for n in ("__s", "__k1", "__ord", "K2", "at", "again", "number", "_text", "body")})
    for keep in ("none", "first"):
        out = suffix_dedup.strip_repeats(odd, keep)
        assert sorted(out.columns) == sorted(odd.columns) and out.where("__s = 'mine' AND K2 = 'mine' AND __ord = 'mine' AND number = 'mine'").count() == 3


def test_cut_characters_stay(spark):
    """Spans that start or end inside a character: its bytes stay, and no byte that stays is lost."""
    one, two = "é" * 30, "è" * 30  # é and è differ in their second byte
    body = "the same passage in both of them, " * 3
    texts = ["x" + one[:1] + body + one, "y" + two[:1] + body + two]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.strip_repeats(docs(spark, texts), "none", length=40, gram=15).collect()}
    raw = [(i, t.encode()) for i, t in enumerate(texts)]
    for (i, t), gone in zip(raw, brute_repeats(raw, 40, "none")):
        at, want = 0, []
        for ch in t.decode():
            n = len(ch.encode())
            want.append("" if gone[at : at + n].all() else ch)
            at += n
        assert got[i] == "".join(want)


# 7


def test_parting_by_members(spark):
    """No member is missed, nearly all others are told apart; nulls and repeated keys do no harm."""
    df = spark.range(20_000).select(F.when(F.col("id") < 19_990, F.xxhash64("id")).alias("k"), F.lit("x").alias("possible"))
    members = df.where("k % 9 = 0").select("k").union(spark.createDataFrame([(None,), (-5,), (-5,)], "k long"))
    maybe, others = part_by_members(df, F.col("k"), members)
    wanted = members.where("k IS NOT NULL").distinct().count() - 1  # without -5, which no row has
    assert maybe.columns == df.columns and maybe.join(members.distinct(), "k", "left_semi").count() == wanted
    assert maybe.count() + others.count() == 20_000 and maybe.count() < wanted + 800
    maybe, others = part_by_members(df, F.col("k"), members.limit(0))
    assert maybe.count() == 0 and others.count() == 20_000


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(0, i) for i in range(301, 400)] + [(i, i + 1) for i in range(500, 540)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    real = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in real}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile, count", [(2048, 0), (5, 0), (2048, 1 << 24), (5, 1 << 30)])
def test_links_against_all_pairs(spark, tile, count):
    rng = np.random.RandomState(tile)
    base = rng.randint(-(2**63), 2**63 - 1, 15, np.int64)
    values = {int(b) for b in base}
    for b in base:
        for k in range(9):
            values.add(int((np.array([b]).view(np.uint64) ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, False)))).view(np.int64)[0]))
    values = sorted(values)
    prints = spark.createDataFrame([(v, False, i) for i, v in enumerate(values)], "fp long, none boolean, least long")
    links = [(values[r["a_least"]], values[r["b_least"]]) for r in simhash.links(prints, tile=tile, blocks=simhash.blocks_of(count)).collect()]
    near = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1") <= 4
    root = {v: v for v in values}

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    def join(r, pairs):
        for a, b in pairs:
            a, b = find(r, a), find(r, b)
            r[max(a, b)] = min(a, b)
        return {v: find(r, v) for v in values}

    assert join(dict(root), links) == join(dict(root), [(x, y) for x in values for y in values if x < y and near(x, y)])


def test_simhash_edges(spark):
    got = simhash.components(docs(spark, ODD, [9, 8, 7, 6, 5, 4, 3, 2, None, 1])).collect()
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert len(got) == len(ODD) and by[9] == by[8] == by[7] == 7 and by[4] == by[3] == 3
    kept = simhash.deduplicate(docs(spark, ["a b c", "a b c", "other words entirely", None, None], [1, 1, 2, None, None]))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "a b c"), ("2", "other words entirely"), ("None", None)]
    plain = simhash.deduplicate(docs(spark, ["a b c", "a b c", "other"]))
    assert sorted(r["doc_id"] for r in plain.collect()) == [0, 2] and plain.columns == docs(spark, []).columns
    assert simhash.components(docs(spark, [])).count() == 0


def test_simhash_at_a_similarity(spark):
    """Texts of a Jaccard similarity of 0.8 or more over five-word shingles are grouped, others apart; ids may be null."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [[word() for _ in range(300)] for _ in range(20)]
    near = [[*b[:150], word(), *b[151:260], word(), *b[261:]] for b in base]  # similarity 0.93
    far = [[*b[:60], *(word() for _ in range(240))] for b in base]
    texts = [" ".join(w) for w in [*base, *near, *far]] + ["", None]
    d = docs(spark, texts, [*range(20), None, *range(101, 120), *range(200, 220), 500, None])
    got = {(r["doc_id"], r["text"]): r for r in d.join(simhash.components(d.select("doc_id", "text"), size=5, similarity=0.8).withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).collect()}
    assert all(got[i + 100, texts[20 + i]]["component_id"] == i for i in range(1, 20))
    assert all(got[200 + i, texts[40 + i]]["component_id"] == 200 + i for i in range(20)) and got[500, ""]["component_id"] == 500
    kept = simhash.deduplicate(d, size=5, similarity=0.8).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(20), *range(200, 220), 500]
    assert simhash.deduplicate(d.limit(0), size=5, similarity=0.8).count() == 0


# 8


def test_media(spark):
    rng = np.random.RandomState(0)
    vectors = spark.createDataFrame([(i, rng.normal(0, 0.15, 64).tolist()) for i in range(40)] + [(41, [0.0] * 64), (42, None), (None, [1.0])], "vec_id long, embedding array<double>")
    pictures = media.album(vectors)
    extra = spark.createDataFrame([(900, None), (901, b""), (902, b"no image"), (903, None)], "media_id long, image binary")
    one = media.encode_pgm(media.draw([0.3] * 64))
    more = spark.createDataFrame([(950, one), (None, one), (2**63 - 1, one), (960, one), (960, one), (None, media.encode_pgm(media.draw([0.4] * 64)))], "media_id long, image binary")
    found = media.copies(pictures.unionByName(extra).unionByName(more).withColumns({n: F.lit("mine") for n in ("digest", "spots", "rep", "n")})).collect()
    assert len(found) == pictures.count() + 10 and sorted(found[0].asDict()) == ["class_id", "media_id", "n_corners", "n_links"]
    rows = {r["media_id"]: r for r in found}
    assert [(r["class_id"], r["n_links"]) for r in found if r["media_id"] in (950, 960, 2**63 - 1)] == [(950, 4)] * 4
    none = sorted(((r["class_id"] or -1), r["n_links"]) for r in found if r["media_id"] is None)
    assert none[-1] == (950, 4) and len(none) == 3
    for i in (0, 10, 20, 30):  # cropped, brightened, turned, overprinted
        assert rows[2 * i + 1]["class_id"] == rows[2 * i]["class_id"] == 2 * i and rows[2 * i]["n_links"] == 1
    assert all(rows[2 * i]["class_id"] == 2 * i and rows[2 * i]["n_links"] == 0 for i in range(40) if i % 10)
    assert rows[900]["class_id"] == rows[901]["class_id"] == rows[903]["class_id"] == 900 and rows[902]["class_id"] == 902
    assert media.copies(extra.limit(0)).count() == 0


# 9


def test_language(spark):
    texts = {"en": "the quick fox and the lazy dog went there with them ", "de": "der schnelle fuchs und die faulen hunde gingen dorthin "}
    d = docs(spark, [texts["en"] * 3, texts["de"] * 3, None, "123"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "de"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(d, langid.train(d)).collect()}
    assert [got[i][0] for i in range(4)] == ["en", "de", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.train(d.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.predict(d, {}).collect()} == {"und"}
    profiles = langid.train(d)
    assert langid.predict(d.limit(0), profiles).count() == 0
    twice = langid.predict(d.unionByName(d).withColumn("lang_pred", F.lit("mine")), profiles).collect()
    assert len(twice) == 8 and {(r["doc_id"], r["lang_pred"], r["score"]) for r in twice} == {(i, *v) for i, v in got.items()}
    tie = langid.train(d.withColumn("text", F.lit("the same words")))
    assert langid.predict(d.limit(1), tie).first()["lang_pred"] == "de"  # the first in alphabetical order


# 10


def test_ranges_have_partitions_of_their_own(spark):
    for n in (1, 4, 37):
        seats = order_minhash.own_partitions(spark, n)
        at = spark.createDataFrame([(i, s) for i, s in enumerate(seats)], "part int, seat int").repartition(n, "seat").select("part", F.spark_partition_id().alias("at")).collect()
        assert len(at) == n and all(r["part"] == r["at"] for r in at)


_FAR = 2**63 - 1


@pytest.mark.parametrize("ids", [[3, 9, 4, 1, 7, 2, 8, 0, 6, 5], [5, 5, None, 2, 2, 1, 9, 9, None, 4], [_FAR, _FAR - 1, -_FAR, 0, _FAR - 2, -_FAR - 1, _FAR, None, 2**62, -5]])
def test_edit_sensitivity(spark, ids):
    got = order_minhash.edit_sensitivity(docs(spark, ODD, ids)).collect()
    rows = sorted(zip(ids, (t or "" for t in ODD)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = order_minhash.edited(t, after)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.likeness(order_minhash.sketch(t), order_minhash.sketch(after))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in got), key=key) == sorted(want, key=key)
    assert order_minhash.edit_sensitivity(docs(spark, [])).count() == 0
    assert order_minhash.edit_sensitivity(docs(spark, ["alone"])).first()["near_next"] == 1.0

"""The registered queries over the smallest tables against brute force or held-out labels, and the pipeline's stages."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, order_minhash, packing, queries, toxicity

from .test_local import direct_events, direct_print, direct_sketch
from .test_operators import brute_repeats

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_names_cover_all_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


def test_op1(spark, texts):
    got = queries.op1_packing(spark, SF).collect()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    covered = {i: np.zeros(len(x), int) for i, x in ids.items()}
    ends = {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    assert all((c == 1).all() for c in covered.values())
    for pieces in ends.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[-1][1] <= 1024
    total = sum(map(len, ids.values()))
    assert sum(1024 - max(e for _, e in p) for p in ends.values()) < 0.01 * total + 1024


def test_op2(spark, texts):
    codec = bpe.load(P.path(queries.BPE_RANKS), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for r in queries.op2_byte_bpe(spark, SF).collect():
        ids = np.array(own.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op3(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op3_html_extract(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name, label, rest, least", [("op4_quality", "quality", (5, 0), 0.9), ("op6_toxicity", "toxic", (3, 1), 0.9)])
def test_classifiers_on_held_out_labels(spark, name, label, rest, least):
    sf = SF.replace("0.001", "0.01")
    got = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % rest[0] == rest[1])
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= least


def test_op4_and_op6_by_hand(spark, texts):
    """The queries' scores, worked out again from the models for each text alone."""
    import zstandard

    model = queries.quality_model(spark, SF)
    made = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(model[k]), write_content_size=False, write_checksum=False, write_dict_id=False) for k in ("good", "bad")]
    mean, scale, w = model["model"]
    for r in queries.op4_quality(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        good, bad = (sum(len(c.compress(raw[i : i + 256])) for i in range(0, max(1, len(raw)), 256)) for c in made)
        length = np.log(len(raw) + 16)
        x = np.array([(bad - good) / (bad + good + 64), (bad - good) / (len(raw) + 64)])
        x = np.array([*x, *(x * length), length])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(w[0] + ((x - mean) / scale) @ w[1:]))), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.3)
    model = queries.toxicity_model(spark, SF)
    grammar = toxicity.Grammar(model["stems"])
    mean, scale, w = model["model"]
    hits = 0
    for r in queries.op6_toxicity(spark, SF).collect():
        total = np.zeros(len(toxicity.EVENTS))
        for clause in re.split(r"[.!?;\n]", texts[r["doc_id"]].lower()):
            words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]", clause)
            if words:
                kinds, weights = zip(*map(grammar.classify, words))
                total += direct_events(list(kinds), weights)
        hits += total.any()
        x = np.log1p(np.append(total, total.sum()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(w[0] + ((x - mean) / scale) @ w[1:]))), abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.7)
    assert hits


def test_op9(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97


def test_op5(spark, texts):
    rows = [(i, texts[i].encode()) for i in sorted(texts)]
    want = dict(zip((i for i, _ in rows), zip((t for _, t in rows), brute_repeats(rows, 200, "none"))))
    for r in queries.op5_suffix_dedup(spark, SF).collect():
        t, gone = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"]) == (len(t), int(gone.sum()))
        assert r["kept_sha256"] == hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def test_op7(spark, texts):
    prints = {i: direct_print(t) for i, t in texts.items()}
    want = components(prints)
    for r in queries.op7_simhash(spark, SF).collect():
        assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])


def test_op8(spark):
    rows = {r["media_id"]: r["class_id"] for r in queries.op8_media_copies(spark, SF).collect()}
    edited = [m for m in rows if m % 2]
    assert sum(rows[m] == rows[m - 1] for m in edited) / len(edited) >= 0.9
    assert len({c for m, c in rows.items() if m % 2 == 0}) > 0.95 * len(rows) * 10 / 11


def test_op10(spark, texts):
    order = sorted(texts, reverse=True)
    after = {i: texts[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    near = []
    for r in queries.op10_order_minhash(spark, SF).collect():
        t = texts[r["doc_id"]]
        e = t[: len(t) - len(t) // 3] + after[r["doc_id"]][: len(t) // 3]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        own, other, following = (order_minhash.sketch(x) for x in (t, e, after[r["doc_id"]]))
        if len(t) < 1500:
            assert own.tolist() == direct_sketch(t) and other.tolist() == direct_sketch(e)
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{v:08x}" for v in x.tolist()) for x in (own, other))
        assert (r["near_edited"], r["near_next"]) == ((own == other).mean(), (own == following).mean())
        near.append(r["near_edited"] > r["near_next"])
    assert sum(near) / len(near) > 0.9


def left_of(text, gone):
    """Characters with a byte that stays."""
    at, out = 0, []
    for ch in text:
        n = len(ch.encode())
        if not gone[at : at + n].all():
            out.append(ch)
        at += n
    return "".join(out)


def check_near_copies(was, kept):
    """Of texts with a similarity of 0.8 or more over five-word shingles one stays; texts that share little all stay."""
    shingles = {}
    for i, t in was.items():
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near, apart = [], set(was)
    for i in was:
        for k in was:
            if i < k and (both := len(shingles[i] & shingles[k])):
                j = both / len(shingles[i] | shingles[k])
                near += [(i, k)] * (j >= 0.8)
                apart -= {i, k} if j >= 0.3 else set()
    assert apart <= kept and near
    assert sum(not {i, k} <= kept for i, k in near) >= 0.95 * len(near)
    for i in set(was) - kept:
        assert any(shingles[i] & shingles[k] for k in kept)


def test_pipeline(spark, texts, tmp_path):
    """Each stage on what the one before kept, against brute force where a stage is exact."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name == "packing":
            continue
        assert docs.columns == columns and docs.count() <= before.count()
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        was = {r["doc_id"]: r["text"] for r in before.collect()}
        if name in ("quality", "toxicity"):
            assert all(was[i] == t for i, t in now.items())
        elif name == "simhash":
            check_near_copies(was, set(now))
        elif name == "suffix":
            rows = [(i, (was[i] or "").encode()) for i in sorted(was)]
            for (i, t), gone in zip(rows, brute_repeats(rows, 200, "first")):
                assert now[i] == left_of(t.decode(), gone)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = spark.read.parquet(f"{SF}/documents.parquet").join(kept["quality"], "doc_id", "left_anti").join(lab, "doc_id")
    good = lab.where("quality = 1").count()
    assert rejected.where("quality = 1").count() <= 0.05 * good + 1
    encode = packing.load_encoder(P.path("byte_bpe_50k.json"))
    assert docs.agg(F.sum("length")).first()[0] == sum(len(encode([r["text"]])[0]) + 1 for r in kept["suffix"].collect())
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with names used inside, and empty tables, through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.lit("mine") for n in ("score", "_score", "__score", "id", "fp", "k1", "again", "possible", "number")})
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    odd = [(9_000_001, None), (9_000_002, ""), (9_000_003, long), (9_000_003, long), (None, "one row without an id, of some words that no other has"), (None, None)]
    more = spark.createDataFrame([(i, t, "en", "odd", None if t is None else len(t)) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(*(F.col(c).cast(docs.schema[c].dataType) if c in more.columns else F.lit("mine").alias(c) for c in docs.columns)))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert docs.where(" OR ".join(f"{c} <> 'mine'" for c in columns if c not in more.columns)).count() == 0
        if name == "simhash":
            assert docs.where("doc_id = 9000003").count() <= 1 and docs.where("text IS NULL OR text = ''").count() <= 1
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.count() > 0 and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0

"""Parts that need no Spark, against direct computations."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from corpusloom.llm import bpe, html_extract, langid, media, order_minhash, packing, quality, simhash, suffix_dedup, toxicity


# 1


def first_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        i = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if i == len(rooms):
            rooms.append(capacity)
        out.append((i, capacity - rooms[i]))
        rooms[i] -= n
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 200))), reverse=True)
    bins, offsets = packing.first_fit_decreasing(lengths, 32)
    assert list(zip(bins.tolist(), offsets.tolist())) == first_fit(lengths, 32)


def test_no_pieces():
    assert packing.first_fit_decreasing([], 32)[0].tolist() == []


def test_encoder_is_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["", " ", "Hello  world\n\n\tx's 12345 été 日本 🙂", "<|endoftext|> a", "a <|endoftext|>  <|endoftext|><|endoftext|", "a" * 3000]
    for special in (True, False):
        own.encode_special_tokens = not special
        assert packing.load_encoder(path, special)(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


# 2


@pytest.fixture(scope="module")
def codec():
    return bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encodes_as_tiktoken(codec, reference):
    rng = random.Random(5)
    texts = ["", " ", "\n\n \t", "a" * 900, "ab" * 700, "!?" * 200, "it's  we'll\x1c\x85 y 　z", "日本語のテキスト" * 40, "".join(rng.choice("abcdefgh") for _ in range(800))]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1200), rng.randint(0x3000, 0xD7FF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(120)) for _ in range(60)]
    ids, ends = codec.encode_batch(texts)
    at = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode_batch(ids, ends) == [t.encode() for t in texts]


def test_long_matches(codec, reference):
    """Matches beyond the matrices: random, periodic, of one symbol, of scripts whose tokens also take part in lower ranks."""
    rng = random.Random(6)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "é", "entß", "".join(map(chr, range(0x4E00, 0x9FFF, 7))), "".join(map(chr, range(0x400, 0x4FF)))]
    texts = ["".join(rng.choices(kinds[i % 6], k=rng.randint(65, 600))) for i in range(240)] + ["".join(rng.choices(kinds[0], k=100_000)), " " * 50_000 + "x", "日本" * 20_000]
    ids, ends = codec.encode_batch(texts)
    at = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(codec, reference):
    codec.forget()
    ids, _ = codec.encode_batch(["the quick brown fox"])
    assert ids.tolist() == reference.encode_ordinary("the quick brown fox")


# 3


@pytest.fixture(scope="module")
def field():
    return html_extract.train(html_extract.labelled_pages(500))


def test_field_on_unseen_pages(field):
    right = total = 0
    for page, labels in html_extract.labelled_pages(150, seed=99):
        got = field.label(html_extract.describe(html_extract.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path(field):
    import itertools

    for page, _ in html_extract.labelled_pages(30, seed=5):
        fs = html_extract.describe(html_extract.leaf_blocks(page))[:9]
        leads = [sum(field.weights.get(f, 0.0) for f in x) for x in fs]
        value = lambda y: sum(lead for lead, b in zip(leads, y) if b) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(fs)), key=value)
        assert value([int(x) for x in field.label(fs)]) == pytest.approx(value(best))


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "plain", "<p>a</p></p></div>", "<a href='", "&amp", "<p>" * 2000])
def test_odd_pages_do_not_fail(field, page):
    assert isinstance(html_extract.extract_page(page, field), str)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>x</title><body><p>Hello world.</p></body></html>", ["Hello world."]),
        ("<head><meta charset=utf-8><p>One.<p>Two.", ["One.", "Two."]),
        ("<head><script>var p;</script>Words here<p>Two.", ["Words here", "Two."]),
        ("<p>bye <a href='x", ["bye"]),
        ("<p>bye <a href='x>y</a> and more", ["bye"]),
        ("<p>a</p><p cla", ["a"]),
        ("<p>it <a title=it's href=x>is</a> so", ["it is so"]),
        ("<!--><p>a<!-- b --!>c", ["ac"]),
        ("<script>a</scripture></script><p>b", ["b"]),
        ("<p>1 < 2 and 3 <4", ["1 < 2 and 3 <4"]),
    ],
)
def test_open_heads_and_cut_tags(page, want):
    assert [t for _, t, _ in html_extract.leaf_blocks(page)] == want


def test_pages_of_nothing_but_text():
    words = "the reader goes on to the next word and the one after"
    page = "<html><head><title>x</title><body>" + "".join(f"<p>{words.capitalize()} {i}. {words.capitalize()}.</p>" for i in range(4)) + "<p>cut <a href='x"
    got = html_extract.extract_page(page, html_extract.default_field())
    assert got.count("\n\n") >= 3 and "<a" not in got and got.startswith("The reader")


def test_blocks():
    got = html_extract.leaf_blocks("<body><nav><a href=x>Home</a></nav><article><h1>T &amp;lt;</h1><p>one<br>two<p>thr<b>ee</b><script>var a='<p>';</script></article>")
    assert [t for _, t, _ in got] == ["Home", "T &lt;", "one two", "three"]
    assert got[0][2] == 1.0 and "tag:nav" in got[0][0] and "in:article" in got[2][0]


# 4


def test_sizes_and_calibration():
    good, bad = b"the fox and the crow went home together. " * 50, b"WIN!! $$$ CLICK!! " * 100
    tools = quality.compressors(good, bad)
    texts = ["the fox went home.", "CLICK!! WIN!! $$$", "the crow and the fox", "$$$ $$$ CLICK!!"] * 10
    x = quality.features(np.array([quality.sizes(t, tools) for t in texts]))
    model = quality.fit_logistic(x, np.array([1, 0] * 20, float))
    s = quality.logistic(x, model)
    assert (s[::2] > 0.5).all() and (s[1::2] < 0.5).all()
    assert quality.sizes(None, tools) == quality.sizes("", tools)


def test_dictionaries():
    rng = random.Random(2)
    texts = [["".join(rng.choices("abcd ", k=400)) for _ in range(rng.randint(1, 6))] for _ in range(80)]
    made = quality.dictionary(texts, 4096, 1 << 15)
    assert made[:4] == bytes.fromhex("37a430ec") and len(made) <= 4096 and made == quality.dictionary(texts, 4096, 1 << 15)
    assert quality.dictionary([["too little"]]) == b"too little" and quality.dictionary([]) == b""


# 5


@pytest.mark.parametrize("alphabet", [1, 2, 4])
def test_factors(alphabet):
    rng = np.random.RandomState(alphabet)
    d, reach = rng.randint(1, alphabet + 1, 160), 40
    n = len(d)

    def common(i, j):
        k = 0
        while k < reach and max(i, j) + k < n and d[i + k] == d[j + k]:
            k += 1
        return k

    previous, following = suffix_dedup.factors(d, reach)
    assert previous.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
    assert following.tolist() == [max((common(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]
    for cut in (5, 12, reach):
        earlier, later = suffix_dedup.reaching(d, cut)
        assert (earlier == (previous >= cut)).all() and (later == (following >= cut)).all()


def test_anchor_runs_tile_all_windows():
    data = np.random.RandomState(1).randint(97, 100, 900).astype(np.uint8)
    h, w, at, first, last = suffix_dedup.anchor_runs(data, 60, 20)
    assert first[0] == 0 and last[-1] == len(data) - 60 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= last) & (at + 20 <= first + 60)).all()
    assert len(suffix_dedup.anchor_runs(data[:59], 60, 20)[0]) == 0


def test_merge_spans():
    a, b = suffix_dedup.merge_spans(np.array([5, 0, 9, 30]), np.array([9, 4, 12, 31]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 4), (5, 12), (30, 31)]


# 6


def test_grammar_events():
    g = toxicity.Grammar({})
    name = lambda text: [toxicity.EVENTS[i] for i in np.flatnonzero(g.features(text)[:-1])]
    assert name("what a moron") == [("insult", 0, 0, 0)]
    assert name("you are a moron") == [("insult", 1, 0, 0)]
    assert name("a moron like you") == [("insult", 1, 0, 0)]
    assert name("that is not a moron") == [("insult", 0, 1, 0)]
    assert name("the boy said moron") == [("insult", 0, 0, 1)]
    assert name("I will kill you") == [("threat", 1, 0, 0)]
    assert name("they kill you") == [("threat", 0, 0, 0)]
    assert name("he said I will not kill you") == [("threat", 1, 1, 1)]
    assert name("we kill time") == [] and name("") == [] and name(None) == []
    assert name("kill the process you started") == []
    assert name("not that. A moron!") == [("insult", 0, 0, 0)]  # a clause ends the negation


def test_prior_order():
    g = toxicity.Grammar({})
    model = (np.zeros(17), np.ones(17), toxicity.PRIOR)
    score = lambda t: float(quality.logistic(g.features(t)[None], model)[0])
    assert score("you are a moron") > score("what a moron") > score("he said not a moron") > score("hello")
    assert score("I will kill you") > score("kill you") > score("he said I will kill you") > score("kill the process you started")
    assert score("you will be beaten") < score("I will beat you") < score("I will murder you")  # threats weigh by word
    assert score("a moron. " * 40) > score("a moron. " * 8) > score("a moron. " * 2)  # no ceiling


def direct_events(kinds, weights):
    """The grammar's events by their definitions, looking both ways from each word."""
    T, total = toxicity, np.zeros(len(toxicity.EVENTS))
    before = lambda i, n, kind: kind in kinds[max(0, i - n) : i]

    def target_after(i, n, same):
        for j in range(i + 1, min(len(kinds), i + n + 1)):
            if kinds[j] in (T.TARGET, same):
                return kinds[j] == T.TARGET
        return False

    for i, kind in enumerate(kinds):
        marks = (int(before(i, T.REACH, T.NEGATION)), int(T.REPORT in kinds[:i]))
        if kind == T.INSULT:
            total[T.AT["insult", int(before(i, T.REACH, T.TARGET) or target_after(i, T.REACH, T.INSULT)), *marks]] += weights[i]
        elif kind == T.THREAT and target_after(i, T.THREAT_REACH, T.THREAT):
            total[T.AT["threat", int(before(i, T.VOW_REACH, T.VOW)), *marks]] += weights[i]
    return total


def test_transducers_against_definitions():
    rng = random.Random(12)
    g = toxicity.Grammar({"zorb": 1.7})
    vocabulary = ["moron", "scum", "zorbing", "kill", "beat", "you", "him", "not", "nie", "said", "will", "deserves", "tree", "of", "the", '"']
    for _ in range(3000):
        words = rng.choices(vocabulary, k=rng.randint(1, 14))
        kinds, weights = zip(*map(g.classify, words))
        assert g.walk(" ".join(words)) == pytest.approx(direct_events(list(kinds), weights)), words


# 7


def direct_print(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "a b", "A b C d", "a b c d e É ß x y", "x y " * 400])
def test_fingerprint(text):
    h = simhash.shingle_hashes(text)
    assert int(simhash.fold(h, np.array([len(h)]))[0]) == direct_print(text)


def test_bit_sliced_distances():
    rng = np.random.RandomState(2)
    base = rng.randint(0, 2**63, 12, np.int64).astype(np.uint64)
    values = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in range(8)])
    i, j = simhash.within(values, values)
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if int(np.bitwise_count(values[a] ^ values[b])) <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("count", [0, 1 << 24, 1 << 30])
def test_enough_blocks_agree(count):
    rng = random.Random(4)
    blocks = simhash.blocks_of(count)
    assert blocks[0][0] == 0 and blocks[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(blocks, blocks[1:]))
    for _ in range(300):
        bits = rng.sample(range(64), 4)
        assert sum(not any(a <= b < e for b in bits) for a, e in blocks) >= len(blocks) - 4


def test_wide_prints_follow_similarity():
    """Distances of texts of a known similarity lie within the radius, and nearly all of them meet under a key."""
    rng = random.Random(3)
    near = met = 0
    keys = simhash.sampled_bits(0.8, 100_000)
    for _ in range(60):
        a = [rng.getrandbits(64) for _ in range(360)]
        b = a[:320] + [rng.getrandbits(64) for _ in range(40)]  # 320 of 400
        one, other = (np.concatenate([simhash.fold(simhash.spread(np.array(x, np.uint64), k), np.array([len(x)])) for k in range(4)]) for x in (a, b))
        near += int(np.bitwise_count(one ^ other).sum()) <= simhash.radius_of(0.8)
        one, other = (np.unpackbits(x.view(np.uint8), bitorder="little") for x in (one, other))
        met += any((one[k] == other[k]).all() for k in keys)
    assert near >= 54 and met >= 54


def test_wide_bit_sliced_distances():
    rng = np.random.RandomState(5)
    base = rng.randint(0, 2**63, (9, 4), np.int64).astype(np.uint64)
    values = np.concatenate([base ^ np.packbits((rng.rand(9, 256) < share), axis=1).view(np.uint64) for share in (0, 0.05, 0.1, 0.15, 0.2)])
    i, j = simhash.within(values, values, 40)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(45) for b in range(45) if int(np.bitwise_count(values[a] ^ values[b]).sum()) <= 40}


# 8


@pytest.mark.parametrize("kind", range(4))
def test_edits_keep_descriptors(kind):
    rng = np.random.RandomState(3)
    image = media.draw(rng.normal(0, 0.15, 64).tolist())
    a, b = media.describe(image)[1], media.describe(media.edit(image, kind))[1]
    far = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2).min(axis=0)
    assert (far <= media.NEAR).mean() > 0.3


def test_png_and_broken_images():
    import struct

    image = np.arange(48, dtype=np.uint8).reshape(6, 8)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    for filtered in range(3):
        raw = b""
        for y, row in enumerate(image):
            up = image[y - 1] if y else np.zeros(8, np.uint8)
            left = np.concatenate([[0], row[:-1]]).astype(np.uint8)
            raw += bytes([filtered]) + (row - (0, left, up)[filtered]).astype(np.uint8).tobytes()
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        assert (media.decode(png) == image).all()
    assert (media.decode(media.encode_pgm(image.astype(float))) == image).all()
    for bad in (None, b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"P5\n9 9\n255\nxx"):
        assert media.decode(bad) is None and len(media.describe(media.decode(bad))[1]) == 0


# 9


def test_profiles():
    profiles = {k: langid.most_frequent(np.concatenate([langid.grams(t)] * 3)) for k, t in {"a": "the then them there", "b": "der die das und dem den"}.items()}
    tool = langid.Profiles(profiles)
    assert tool.predict("then there")[0] == "a" and tool.predict("und das")[0] == "b"
    assert tool.predict(None) == ("und", 0.0) and tool.predict("123 !?") == ("und", 0.0)
    assert langid.Profiles({}).predict("word") == ("und", 0.0)


def direct_language(text, profiles, top):
    """Out-of-place distances over plain dictionaries."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return "und", 0.0
    counts = {}
    line = " " + " ".join(words) + " "
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != " ":
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]
    far = {}
    for name, grams in profiles.items():
        place = {int(g): i for i, g in enumerate(grams)}
        far[name] = sum(abs(place[code(g)] - i) if code(g) in place else top for i, g in enumerate(own))
    best = min(sorted(far), key=far.get)
    second = sorted(far.values())[1]
    return best, 1 - far[best] / second if second else 0.0


def test_languages_against_plain_dictionaries():
    rng = random.Random(8)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(n))
    scripts = {"a": "abcdeé", "b": "abxyzß", "c": "абвгд", "d": "日本語aé"}
    profiles = {k: langid.most_frequent(langid.grams(make(v, 400))) for k, v in scripts.items()}
    tool = langid.Profiles(profiles)
    texts = [make(rng.choice(list(scripts.values())), rng.randint(1, 60)) for _ in range(60)] + ["", "1 2", "É", "a1b2 c!", "x" * 3000, "İ ǅ", "aé" * 900]
    for t in texts:
        name, score = tool.predict(t)
        want = direct_language(t, profiles, langid.TOP)
        assert (name, score) == (want[0], pytest.approx(want[1])), t


# 10


def direct_sketch(text):
    """Order MinHash over plain lists: numbered k-mers, the least of each bin, in the order of the text."""
    k, bins, size, mask = order_minhash.KMER, order_minhash.COMPONENTS, order_minhash.TUPLE, 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    points = [ord(c) for c in text]
    points += [0x110000] * (k - len(points))
    grams = []
    for at in range(len(points) - k + 1):
        gram = 0
        for p in points[at : at + k]:
            gram = (gram * 0x9E3779B97F4A7C15 + p + 1) & mask
        grams.append(gram)
    count, times, rows = Counter(grams), Counter(), [[] for _ in range(bins)]
    for at, gram in enumerate(grams):
        h = mixed((mixed(gram) + times[gram]) & mask) if count[gram] > 1 else mixed(gram)
        times[gram] += 1
        rows[h % bins].append((h, at))
    out = []
    for row in rows:
        least = sorted(sorted(row)[:size], key=lambda r: r[1])
        values = [0] * (size - len(least)) + [h for h, _ in least]
        total = 0
        for j, h in enumerate(values):
            total = mixed((total * 31 + h + j + 1) & mask)
        out.append(total if row else None)
    filled = [i for i, v in enumerate(out) if v is not None]
    for i, v in enumerate(list(out)):
        if v is None:
            source = next((j for j in filled if j > i), filled[0])
            out[i] = mixed((out[source] + i + 1) & mask)
    return [v >> 32 for v in out]


@pytest.mark.parametrize("text", ["", "a", "short one", "0123456789", "a" * 400, "ab " * 300, "The quick brown fox. " * 3, "été 日本 🙂 " * 30])
def test_sketch_against_plain_lists(text):
    assert order_minhash.sketch(text).tolist() == direct_sketch(text)


def test_long_sketch_against_plain_lists():
    text = "".join(random.Random(1).choices("abcdefghijklmnop ", k=30_000))  # over the bound below which all hashes are looked at
    assert order_minhash.sketch(text).tolist() == direct_sketch(text)


def test_sketch_follows_edits():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    like = lambda a, b: order_minhash.likeness(order_minhash.sketch(a), order_minhash.sketch(b))
    assert like(text, text) == 1.0
    assert like(text, text[:3900] + other[:100]) > like(text, order_minhash.edited(text, other)) > 0.1 > like(text, other)
    halves = text[2000:] + text[:2000]
    assert like(text, halves) < 0.8  # the same k-mers in another order
    for t in ("", "a", "aa", "a" * 500):
        assert like(t, t) == 1.0


def test_rolling_and_occurrences():
    points = np.arange(1, 40, dtype=np.uint64)
    for k in (1, 2, 3, 5, 8, 10):
        got = order_minhash.rolling(points, k)
        base = 0x9E3779B97F4A7C15
        want = [sum((int(p) + 1) * pow(base, k - 1 - i, 2**64) for i, p in enumerate(points[s : s + k])) % 2**64 for s in range(len(points) - k + 1)]
        assert got.tolist() == want

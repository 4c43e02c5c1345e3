"""Operator 8 on planted copies, against full comparison of every pair."""

import numpy as np

from corpusloom.llm import media


def drawn(n, seed):
    rng = np.random.RandomState(seed)
    return [media.draw(rng.normal(0, 0.15, 64).tolist()) for _ in range(n)]


def classes(spark, images):
    rows = [(i, media.encode_pgm(x)) for i, x in enumerate(images)]
    return {r["media_id"]: r for r in media.copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}


def spots(image):
    return media.pack_spots(*media.describe(media.decode(media.encode_pgm(image))))


def test_keys_reach_the_radius(spark):
    """Rescaled, noisy and turned copies that full comparison finds; few of their corners keep a quarter of the bits."""
    base = drawn(36, 5)
    hard = [lambda x: media.edit(x, 4), lambda x: media.edit(x, 5), lambda x: media.edit(x, 6), lambda x: media._turn(x, 33)]
    images = [y for i, x in enumerate(base) for y in (x, hard[i % 4](x))]
    rows = classes(spark, images)
    pairs = [(2 * i, 2 * i + 1) for i in range(len(base)) if media.agree_on_transform(spots(images[2 * i]), spots(images[2 * i + 1]))]
    assert len(pairs) >= 30
    assert sum(rows[a]["class_id"] == rows[b]["class_id"] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(rows[2 * i]["class_id"] == 2 * i for i in range(len(base)))


def test_many_edits_of_one_image(spark):
    """Every member of a group of edits that differ in bytes counts all copies that full comparison finds, tiles or not."""
    one, other = drawn(2, 8)
    group = [one, *(one + np.random.RandomState(k).normal(0, 3, one.shape) for k in range(5)), media.edit(one, 0), media.edit(one, 1), media.edit(one, 1)]
    images = [*group, other, media.edit(other, 5)]
    rows = classes(spark, images)
    known = [spots(x) for x in images]
    want = [sum(media.agree_on_transform(known[min(i, k)], known[max(i, k)]) for k in range(len(images)) if k != i) for i in range(len(images))]
    assert [rows[i]["n_links"] for i in range(len(images))] == want and min(want[: len(group)]) == len(group) - 1
    assert {rows[i]["class_id"] for i in range(len(group))} == {0}
    members = spark.createDataFrame([(0, i, 1, [int(v) for v in known[i].ravel()]) for i in range(len(group))], "root long, node long, copies long, spots array<long>")
    assert {r["node"]: r["n"] for r in media.links_within(members, tile=2).collect()} == dict(enumerate(want[: len(group)]))


def test_matches_beyond_leaders():
    """r matches q, but not the first image of the key, which q matches; and q and r match where both match the first."""
    bits = np.zeros((4, 256), np.uint8)
    bits[1, :30] = bits[2, :60] = bits[3, 100:120] = 1
    code = np.packbits(bits, axis=1).view(np.uint64)
    left, right = media._meet(np.zeros(4, np.int64), np.arange(4), code)
    assert sorted(zip(left.tolist(), right.tolist())) == [(0, 1), (0, 3), (1, 2)]
    code[2] = code[0]
    left, right = media._meet(np.zeros(4, np.int64), np.arange(4), code)
    assert sorted(zip(left.tolist(), right.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)]


def test_crop_of_a_weak_region(spark):
    """Crops of a larger picture, from a part whose corners are all weaker than the rest's."""
    rng = np.random.RandomState(4)
    large = media.draw(rng.normal(0, 0.15, 64).tolist(), 384)
    large[192:, 192:] = 110 + 0.4 * (large[192:, 192:] - 110)
    images = [large, *(large[y : y + 96, x : x + 96] for y, x in ((196, 200), (250, 220), (280, 285), (20, 30))), *drawn(4, 6)]
    rows = classes(spark, images)
    assert [rows[i]["class_id"] for i in range(len(images))] == [0] * 5 + [5, 6, 7, 8]
    assert rows[0]["n_links"] == 4


def scattered(codes, seed):
    """The descriptors at places and angles of their own."""
    rng = np.random.RandomState(seed)
    where = np.stack([rng.uniform(20, 400, len(codes)), rng.uniform(20, 400, len(codes)), np.ones(len(codes)), rng.uniform(0, 6.2, len(codes))], axis=1)
    return media.pack_spots(where, codes)


def test_copies_beyond_partners(spark):
    """An image and its copy, with more images between them that show the same corners elsewhere than a key emits at first."""
    codes = np.random.RandomState(3).randint(0, 256, (8, 32)).astype(np.uint8)
    images = [scattered(codes, 0), *(scattered(codes, 1 + i) for i in range(media.PARTNERS + 4)), scattered(codes, 0)]
    last = len(images) - 1
    assert media.agree_on_transform(images[0], images[last]) and not any(media.agree_on_transform(x, images[last]) for x in images[1:last])
    reps = spark.createDataFrame([(i, [int(v) for v in x.ravel()]) for i, x in enumerate(images)], "media_id long, spots array<long>")
    first = media.matches(reps).where("p IS NOT NULL").collect()
    assert first and not any((r["p"], r["q"]) == (0, last) for r in first)
    assert {r["node"]: r["root"] for r in media.joined(reps).collect()} == {0: 0, last: 0}


def test_lone_corners_alike_do_not_match(spark):
    """A corner that all images share, among corners of their own, yields no matches, whose number would be their square."""
    rng = np.random.RandomState(5)
    one = rng.randint(0, 256, (1, 32)).astype(np.uint8)
    images = [scattered(np.concatenate([one, rng.randint(0, 256, (12, 32)).astype(np.uint8)]), i) for i in range(30)]
    reps = spark.createDataFrame([(i, [int(v) for v in x.ravel()]) for i, x in enumerate(images)], "media_id long, spots array<long>")
    assert media.matches(reps).count() < 30


def test_tiles_give_each_match_once(spark):
    codes = np.random.RandomState(3).randint(0, 256, (3, 32)).astype(np.uint8)
    reps = spark.createDataFrame([(i, [int(v) for v in scattered(codes, i).ravel()]) for i in range(12)], "media_id long, spots array<long>")
    whole, tiled = (sorted(map(tuple, media.matches(reps, tile=n, tables=range(1)).collect())) for n in (100, 4))
    assert len(whole) == 3 * 66 and tiled == whole


def met(key, image, code, side, beside, root, ranks):
    """Every pair of a key by itself, in plain Python: what _meet gives and the keys with more."""
    shorts = [set(row.view(np.uint16).tolist()) - {0xFFFF} for row in beside]
    out, more = [], set()
    for b in range(len(key)):
        made = 0
        for a in range(b - 1, -1, -1):
            if key[a] != key[b]:
                break
            if image[a] == image[b] or np.bitwise_count(code[a] ^ code[b]).sum() > media.NEAR or not shorts[a] & shorts[b] or 0 <= side[a] == side[b]:
                continue
            made += 1
            if ranks[0] < made <= ranks[1] and root[a] != root[b]:
                out.append((a, b))
        if made > ranks[1]:
            more.add(int(key[b]))
    return sorted(out), sorted(more)


def test_meet_against_every_pair(monkeypatch):
    """Keys with neighbours of many kinds, of one kind and of none, held matches cut down often or never."""
    rng = np.random.RandomState(1)
    for kinds in (1, 3, 40, 3000):
        n = 240
        key = np.sort(rng.randint(0, 4, n)).astype(np.int64)
        image = np.concatenate([np.sort(rng.randint(0, 50, (key == k).sum())) for k in range(4)])
        code = np.packbits((rng.rand(n, 256) < 0.07).astype(np.uint8), axis=1).view(np.uint64)
        beside = np.where(rng.rand(n, media.BESIDE) < 0.1, 0xFFFF, rng.randint(0, kinds, (n, media.BESIDE))).astype(np.uint16).view(np.int64)
        side, root = np.where(key == 2, rng.randint(0, 2, n), -1), image % 7
        for ranks in ((0, 3), (3, 24), (0, 1000)):
            for held in (10, 1 << 20):
                monkeypatch.setattr(media, "HELD", held)
                left, right, more = media._meet(key, image, code, side=side, beside=beside, root=root, ranks=ranks)
                want = met(key, image, code, side, beside, root, ranks)
                assert (sorted(zip(left.tolist(), right.tolist())), more.tolist()) == want
        assert kinds > 40 or want[0]
    none = media._meet(key[:0], image[:0], code[:0], side=side[:0], beside=beside[:0], root=root[:0])
    assert [len(x) for x in none] == [0, 0, 0]


def test_only_rows_with_a_common_neighbour_are_compared():
    """The pairs compared in a key of unlike surroundings are few, and no more than the key's pairs where all are alike."""
    rng = np.random.RandomState(2)
    pairs = lambda run: sum(n * (n - 1) // 2 for n in np.unique(run, return_counts=True)[1].tolist())
    beside = rng.randint(0, 1 << media.ASIDE, (600, media.BESIDE)).astype(np.uint16).view(np.int64)
    every = 600 * 599 // 2
    assert pairs(media._runs(np.zeros(600, np.int64), beside)[1]) < every / 50
    assert pairs(media._runs(np.zeros(600, np.int64), np.repeat(beside[:1], 600, axis=0))[1]) == every


def test_further_rounds_meet_crowded_keys_alone(spark, monkeypatch):
    """A key that is met again takes no other key's rows along, and gives what it gave among all."""
    codes = np.random.RandomState(3).randint(0, 256, (3, 32)).astype(np.uint8)
    reps = spark.createDataFrame([(i, [int(v) for v in scattered(codes, i).ravel()]) for i in range(12)], "media_id long, spots array<long>")
    key = int(media.table_keys(codes.view(np.uint64).reshape(-1, 4))[0, 0])
    whole = sorted(map(tuple, media.matches(reps, tile=8, tables=range(1)).collect()))
    counted, settle = [], media.settle
    monkeypatch.setattr(media, "settle", lambda df, name: counted.append(settle(df, name)) or counted[-1])
    groups = [(key << 32 | i << 16 | j,) for i in range(2) for j in range(i, 2)]
    again = sorted(map(tuple, media.matches(reps, tile=8, tables=range(1), only=spark.createDataFrame(groups, "key long")).collect()))
    assert len(again) == 66 and set(again) < set(whole)
    assert [r["key"] for r in counted[0].collect()] == [key]

"""Operator 7, SimHash near-dedup with bit-sliced comparison.

Fingerprints: majority bits of hashes of word shingles. Fingerprints meet under keys, and within a key they are compared
bit-sliced: 64 fingerprints stand side by side in each word of the bit planes, a query's differing bits are added to
carry-save counters (ones, twos, fours, ...), and a block of words is abandoned once all its counters exceed the radius.
A key's members yield one link each at most (to the first member of their local component), so that links grow with the
members and not with their pairs; components over all keys give the result.

Two kinds of fingerprints:

* 64 bits, XXH64 of four-word shingles, linked at ``RADIUS`` = 4 bits, exactly: the bits are cut into six to eight blocks;
  fingerprints within four bits agree on all but four of them, so that each choice of so many blocks is a key under which
  all links show up. More blocks give longer keys, so their number follows the number of fingerprints.
* ``WIDE`` = 256 bits of five-word shingles, for a stated similarity (0.8): two texts of Jaccard similarity s differ in a
  share arccos(2 s / (1 + s)) / pi of the bits, ``radius_of`` adds ``SPARE`` standard deviations, and ``sampled_bits``
  takes as many random keys as let pairs of that similarity meet with a probability of ``MEET``, at any number of documents.

Only distinct fingerprints are compared. Keys with more than ``TILE`` of them are cut into tiles that are compared with
each other in separate groups of bounded size, each tile pair once.

Defined results: null and empty texts have fingerprint zero, which links like any other; repeated rows share a
component; rows with a null id take part and get a component by the others' smallest id; an empty table gives no rows. Of a
text of any length whole shingles are hashed in turn. Extra columns may have any names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from .common import append_columns, part_by_members, settle, unused
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints for a stated similarity: bits, words of a shingle, standard deviations added to the radius, and the
#: probability that two texts of that similarity meet under a key.
WIDE, WIDE_SHINGLE, SPARE, MEET = 256, 5, 1.7, 0.97
#: Distinct fingerprints of a key, about, and of a group that is compared at once at most.
SHARE, TILE = 512, 2048
#: Large keys that are sent to all executors (some bytes each); more are joined.
FEW = 50_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPREAD = np.random.RandomState(5).randint(1, 2**63 - 1, WIDE // 64, np.int64).astype(np.uint64)


def blocks_of(count: int) -> list[tuple[int, int]]:
    """Bits from .. to of six to eight blocks, so that keys of all but four of them part count fingerprints."""
    n = 6 if count < 1 << 24 else 7 if count < 1 << 30 else 8
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return list(itertools.pairwise(cuts))


def radius_of(similarity: float, bits: int = WIDE) -> int:
    """Differing bits of two texts of that Jaccard similarity, with SPARE standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + SPARE * math.sqrt(bits * p * (1 - p)))


def sampled_bits(similarity: float, count: int, bits: int = WIDE) -> np.ndarray:
    """Keys x places of their bits: so many bits that SHARE of count fingerprints share a key, and as many keys as it takes."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    size = min(40, max(8, round(math.log2(max(1, count) / SHARE))))
    keys = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - p) ** size))
    rng = np.random.RandomState(29)
    return np.stack([rng.permutation(bits)[:size] for _ in range(keys)])


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of size words (all words if fewer), joined by spaces; none for no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1)[min(size, len(words)) - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n], stops[:n], strict=True)), np.uint64, n)


def fold(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive runs of hashes; ends: where each run ends. An empty run gives zero."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in np.flatnonzero(ends > starts):
        run = hashes[starts[i] : ends[i]]
        counts = np.zeros(64, np.int64)
        for at in range(0, len(run), 1 << 14):
            bits = np.unpackbits(run[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint16 if len(run) < 65536 else np.int64)
        out[i] = weights[2 * counts > len(run)].sum(dtype=np.uint64)
    return out


def spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a wide fingerprint's hashes."""
    x = hashes + _SPREAD[k]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = SHINGLE, name: str = "fp", wide: bool = False) -> DataFrame:
    """Adds the fingerprint as a long (its bits as they are), or WIDE bits as binary."""

    def make():
        def compute(texts: list) -> list[pa.Array]:
            runs = [shingle_hashes(t, size) for t in texts]
            hashes, ends = np.concatenate([np.zeros(0, np.uint64), *runs]), np.cumsum([len(r) for r in runs], dtype=np.int64)
            if not wide:
                return [pa.array(fold(hashes, ends).view(np.int64), pa.int64())]
            words = np.stack([fold(spread(hashes, k), ends) for k in range(WIDE // 64)], axis=1)
            return [pa.array([w.tobytes() for w in words], pa.binary())]

        return compute

    return append_columns(docs, text_col, make, [StructField(name, BinaryType() if wide else LongType())], keep)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Bits x words: bit j of 64 values side by side in each word; the last word is filled up with the last value.
    values: rows of 64-bit words."""
    pad = -len(values) % 64
    values = np.concatenate([values, np.repeat(values[-1:], pad, axis=0)]).astype(np.uint64)
    bits = np.unpackbits(values.view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")  # value x bit
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64).reshape(bits.shape[1], -1)


def within(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, value) of all pairs that differ in radius bits at most. queries, values: rows of 64-bit words.

    Counters are kept as bit planes; every step planes, words whose 64 counters all exceed the radius are abandoned.
    """
    queries, values = (np.ascontiguousarray(v.astype(np.uint64)).reshape(len(v), -1) for v in (queries, values))
    planes, n = bit_planes(values), len(values)
    words = planes.shape[1]
    who = np.repeat(np.arange(len(queries)), words)  # live (query, word) blocks
    word = np.tile(np.arange(words), len(queries))
    depth = int(radius).bit_length()
    counters = [np.zeros(len(who), np.uint64) for _ in range(depth)]
    over = np.zeros(len(who), np.uint64)
    query_bits = np.unpackbits(queries.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    flips = np.where(query_bits.T > 0, np.uint64(2**64 - 1), np.uint64(0))  # bit x query
    full = np.uint64(2**64 - 1)
    for at in range(0, len(planes), step):
        for j in range(at, at + step):
            carry = planes[j][word] ^ flips[j][who]
            for k in range(depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        beyond = over.copy()
        greater, equal = np.zeros(len(who), np.uint64), np.full(len(who), full)
        for k in reversed(range(depth)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                greater |= equal & counters[k]
                equal &= ~counters[k]
        beyond |= greater
        live = beyond != full
        if not live.all():
            who, word, over, counters, beyond = who[live], word[live], over[live], [c[live] for c in counters], beyond[live]
        if not len(who):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(near)
    value = word[block] * 64 + lane
    real = value < n
    return who[block][real], value[real]


def local_links(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the pairs: (member, its component's first member)."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before, root)  # old roots follow their members
        root = root[root]
        if (root == before).all():
            break
    member = np.flatnonzero(root != np.arange(size))
    return member, root[member]


def compare(values: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between the distinct fingerprints of one group, as places: side 0 within itself, or side 0 against side 1."""
    crossed = (side == 1).any()
    a = np.flatnonzero(side == 0) if crossed else np.arange(len(values))
    b = np.flatnonzero(side == 1) if crossed else a
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), 256):
        i, j = within(values[a[at : at + 256]], values[b], radius)
        i, j = a[at : at + 256][i], b[j]
        left.append(i[i != j])
        right.append(j[i != j])
        if len(left) > 8:  # what is linked already needs no more pairs
            member, root = local_links(np.concatenate(left), np.concatenate(right), len(values))
            left, right = [member], [root]
    return local_links(np.concatenate(left), np.concatenate(right), len(values))


def _packed(fp: pd.Series) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    if fp.dtype == object:
        return np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), -1)
    return fp.to_numpy(np.int64).view(np.uint64).reshape(-1, 1)


def _met(dealt: DataFrame, tile: int, sparse: bool) -> DataFrame:
    """fp, none, least, key, i, j, side: the members of each key, of large keys for each pair of tiles. sparse: most keys
    have one member, which goes before the rows are dealt; otherwise only large keys are looked up."""
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"))
    if sparse:
        met = dealt.join(sizes.where("n > 1"), "key")
    else:
        large = settle(sizes.where(F.col("n") > tile), "large")
        met = dealt.join(F.broadcast(large) if large.count() <= FEW else large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # large keys: tiles by a hash of the fingerprint; tile pairs (i <= j) get the members of both
    tiles = F.ceil(F.col("n") / tile).cast("int")
    met = met.withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j"), F.when(o < F.col("t"), 1).otherwise(0).alias("side")))
    met = met.select("fp", "none", "least", "key", F.explode(pair).alias("p")).select("fp", "none", "least", "key", "p.*")
    # small groups share a call: a bucket holds whole groups, told apart by key and tile pair
    buckets = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(buckets, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _links(dealt: DataFrame, radius: int, tile: int, sparse: bool) -> DataFrame:
    """Links (a_none, a_least, b_none, b_least) within the keys of dealt (fp, none, least, key) that join all fingerprints
    within the radius; none and least name a fingerprint."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            end = int(((held["key"] != last["key"]) | (held["i"] != last["i"]) | (held["j"] != last["j"])).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if end:
                yield _compare_groups(held.iloc[:end], radius)
                held = held.iloc[end:]
        if held is not None and len(held):
            yield _compare_groups(held, radius)

    return _met(dealt, tile, sparse).mapInPandas(run, "a_none boolean, a_least long, b_none boolean, b_least long").distinct()


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: list[tuple[int, int]] | None = None) -> DataFrame:
    """prints: fp (long), distinct, with none and least, which go along. Links that join all fingerprints within the radius,
    directly or over others."""
    if radius != 4:
        raise ValueError("the blocks serve a radius of 4")
    blocks = blocks or blocks_of(prints.count())

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(number)
        for i in chosen:
            a, b = blocks[i]
            out = F.shiftleft(out, b - a).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return out

    choices = list(itertools.combinations(range(len(blocks)), len(blocks) - 4))
    keys = F.array(*(key(k, chosen).cast("long") for k, chosen in enumerate(choices)))
    return _links(prints.select("fp", "none", "least", F.explode(keys).alias("key")), radius, tile, True)


def wide_links(prints: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """prints: fp (WIDE bits), distinct, with none and least. Links of fingerprints as near as those of texts of that similarity."""
    keys = sampled_bits(similarity, prints.count())

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(keys.shape[1], dtype=np.int64)
        for batch in batches:
            fps = batch.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
            for k, places in enumerate(keys):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits[:, places] @ weights | k << 44)], names=["fp", "none", "least", "key"])

    return _links(prints.select("fp", "none", "least").mapInArrow(deal, "fp binary, none boolean, least long, key long"), radius_of(similarity), tile, False)


def _compare_groups(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Compares within each (key, i, j). Pairs of two, the bulk of exact keys, are compared all at once."""
    key = rows[["key", "i", "j"]].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
    size = np.diff(cut)
    words, side = _packed(rows["fp"]), rows["side"].to_numpy()
    two = cut[:-1][size == 2]
    near = two[np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1) <= radius]
    left, right = [near], [near + 1]
    for start, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        a, b = compare(words[start : start + n], side[start : start + n], radius)
        left.append(a + start)
        right.append(b + start)
    ends = {"a": rows.iloc[np.concatenate(left)], "b": rows.iloc[np.concatenate(right)]}
    return pd.DataFrame({f"{e}_{c}": part[c].to_numpy() for e, part in ends.items() for c in ("none", "least")})


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links), root (what names the component). Links: radius bits
    of 64 at most, or with similarity as near as texts of that Jaccard similarity."""
    wide = similarity is not None
    rows = settle(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"], size=size, wide=wide), "prints")
    # a fingerprint goes by the least id of its rows, which no other has, or, where all are null, by its hash
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    prints = prints.select("fp", F.col("least").isNull().alias("none"), F.coalesce(F.col("least").cast("long"), F.xxhash64("fp") if wide else F.col("fp")).alias("least"))
    found = wide_links(prints, similarity) if wide else links(prints, radius)
    # ordered so that a component's root holds the component's id
    node = lambda end="": F.struct(*(F.col(f"{end}{c}").alias(c) for c in ("none", "least")))
    roots = connected_components(found.select(node("a_").alias("a"), node("b_").alias("b")))
    named = prints.select("fp", node().alias("node")).join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    named = named.select("fp", F.when(~F.col("root.none"), F.col("root.least")).alias("component_id"), "root")
    return rows.join(settle(named, "roots"), "fp").select("doc_id", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (of equals that of the smallest fingerprint)."""
    key, print_, own = unused(docs.columns, "id", "fp", "own")
    found = settle(components(docs, id_col, text_col, size, similarity=similarity), "components")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "fp")).alias("m")).select(F.col("m.doc_id").alias(key), F.col("m.fp").alias(print_))
    twice = found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not twice:  # only texts that may go are shuffled
        gone = settle(found.select(F.col("doc_id").alias(key)).join(best, key, "left_anti"), "gone")
        maybe, stays = part_by_members(docs, F.col(id_col), gone)
        return maybe.join(gone, maybe[id_col] == gone[key], "left_anti").unionByName(stays)
    marked = fingerprints(docs, text_col, name=own, size=size, wide=similarity is not None)
    same = marked[id_col].eqNullSafe(best[key]) & (marked[own] == best[print_])
    return marked.join(best, same, "left_semi").dropDuplicates([id_col, own]).drop(own)

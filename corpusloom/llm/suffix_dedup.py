"""Operator 5, suffix-array dedup: longest-previous-factor arrays over the places where texts may repeat.

1. Anchors. Every window of ``LENGTH`` bytes names one of its ``GRAM``-byte substrings, the one with the least hash
   (the rightmost of equals). Equal windows name the same substring at the same offset, so texts can only repeat where
   an anchor's hash occurs twice. A run of windows with the same anchor is one row: the anchor's hash, a hash of the
   run's whole bytes (its stretch), the text's key, and where it lies. This is linear in the input, and only these rows
   (not the text) are shuffled.
2. The rows are sorted by anchor and stretch. Anchors whose hash occurs at one place only are done with. Runs with equal
   anchors and equal stretches are copies of one another as a whole; one of them, the first, stands for all.
3. Where an anchor has several different stretches, these (one of each) are read from the texts and put into a suffix
   array with separators. Its longest-previous-factor array comes from the previous and next smaller positions in
   suffix order, and likewise the longest next factor from the previous and next larger ones. Positions whose factor
   reaches ``LENGTH`` start a string that also starts earlier (or later).
4. Spans are merged per text and cut out of the texts they lie in.

An anchor of more than ``GROUP`` different stretches goes on to longer anchors: the offsets at which it stands in a window
are halved, each half has bytes of its own that all its windows share, and these take the anchor's place. Stretches cut to a
half are compared as bytes; those that are equal are copies, and one of each goes on, into suffix arrays or, where there are
still too many, into further halves. A half of one offset has one kind of window, so this ends after the logarithm of the
offsets, at any number of stretches.

keep="none" removes every copy, keep="first" all but the first in order of (document id, position).

Defined results: null text counts as empty; texts shorter than LENGTH stay whole; repeated rows are copies of one
another, and with keep="first" one row of those alike in id and text keeps its text; rows with null ids come first; an empty
table gives no rows; extra columns may have any names. Texts of any length are read one at a time. Where text is returned, a
character that only lies in part in a removed span stays.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bound_batches, part_by_members, release, settle, slices, unused

LENGTH, GRAM, GROUP = 200, 50, 4000
#: Stretches that share one suffix array, about.
TOGETHER = 1500
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_TABLE = np.random.RandomState(7).randint(1, 2**63 - 1, 256, np.int64).astype(np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end], whatever its place."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the place of its least one, the last of equals."""
    n = len(values)
    count = n - width + 1
    # the low bits hold the place, counted down, so that a plain minimum also finds it
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (values & ~low) | (low - np.arange(n, dtype=np.uint64))
    pad = -n % width
    grid = np.concatenate([packed, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:count], ahead[width - 1 : width - 1 + count])
    return (low - (least & low)).astype(np.int64)


def anchor_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, anchor place, first window, last window) of each run of windows with one anchor."""
    if len(data) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    sums = prefix_sums(data)
    places = np.arange(len(data) - gram + 1)
    hashes = span_hashes(sums, places, places + gram)
    anchor = sliding_argmin(hashes, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    at = anchor[first]
    return hashes[at], span_hashes(sums, first, last + length) ^ mix((at - first).astype(np.uint64)), at, first, last


def suffix_order(data: np.ndarray, reach: int, every: bool = True) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted by their first reach symbols, and ranks by fewer symbols, twice as many each time (or the last only)."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    base = int(data.max()) + 1
    levels: list[tuple[int, np.ndarray]] = []
    done = 1
    while base ** (done + 1) < 2**63 and done < min(8, reach):
        done += 1
    for k in range(done):
        key *= np.uint64(base)
        key[: n - k] += data[k:].astype(np.uint64)
    while True:
        order = np.argsort(key)
        key = key[order]
        fresh = np.zeros(n, np.int32)
        np.cumsum(key[1:] != key[:-1], out=fresh[1:])
        ranks = np.empty(n, np.int32)
        ranks[order] = fresh
        levels = [*(levels if every else []), (done, ranks)]
        if done >= reach or fresh[-1] == n - 1:
            return order, levels
        step = min(done, reach - done)
        key = ranks.astype(np.uint64) * np.uint64(n + 1)
        key[: n - step] += ranks[step:].astype(np.uint64) + np.uint64(1)
        done += step


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value of each, -1 for none, by jumping over found ones."""
    at = np.arange(len(values), dtype=np.int32) - np.int32(1)
    todo = np.flatnonzero((at >= 0) & (values[np.maximum(at, 0)] > values))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (values[np.maximum(at[todo], 0)] > values[todo])]
    return at


def reaching(data: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest previous and the longest next factor reach so many symbols: ``factors`` cut at reach, in a
    quarter of the memory, as only ranks by reach symbols are kept and compared."""
    n = len(data)
    order, [(done, ranks)] = suffix_order(data, reach, False)
    if done < reach:  # all suffixes differ sooner
        return np.zeros(n, bool), np.zeros(n, bool)
    place, ranked = order.astype(np.int32), ranks[order]
    out = []
    for values in (place, -place):  # smaller positions come earlier in the text, larger ones later
        found = np.zeros(n, bool)
        for turn in (slice(None), slice(None, None, -1)):  # the previous and the next one in suffix order
            near = nearest_smaller(values[turn])
            equal = ranked[turn]
            found[turn] |= (near >= 0) & (equal[np.maximum(near, 0)] == equal)
        mark = np.zeros(n, bool)
        mark[order] = found
        out.append(mark)
    return out[0], out[1]


def factors(data: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of every place, counted up to reach."""
    n = len(data)
    order, levels = suffix_order(data, reach)

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total, alive = np.zeros(len(i), np.int64), j >= 0
        i, j = i.copy(), np.where(alive, j, 0)
        whole = dict(levels)
        for size in sorted(whole, reverse=True):
            ranks = whole[size]
            while True:
                inside = alive & (i < n) & (j < n) & (total + size <= reach)
                same = np.zeros(len(i), bool)
                same[inside] = ranks[i[inside]] == ranks[j[inside]]
                if not same.any():
                    break
                total[same] += size
                i[same] += size
                j[same] += size
        for _ in range(min(whole) - 1):
            inside = alive & (i < n) & (j < n) & (total < reach)
            same = np.zeros(len(i), bool)
            same[inside] = data[i[inside]] == data[j[inside]]
            if not same.any():
                break
            total[same] += 1
            i[same] += 1
            j[same] += 1
            alive = same
        return total

    def longest(values: np.ndarray) -> np.ndarray:
        before = nearest_smaller(values)
        after = nearest_smaller(values[::-1])[::-1]
        after = np.where(after >= 0, n - 1 - after, -1)
        best = np.zeros(n, np.int64)
        for near in (before, after):
            best[order] = np.maximum(best[order], common(order, np.where(near >= 0, order[np.maximum(near, 0)], -1)))
        return best

    return longest(order), longest(-order)


def repeated_starts(stretches: list[bytes], ranks: list[int], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For stretches in order of ranks: at which of their places a length-byte string starts that starts elsewhere among
    them too: earlier ones, and any."""
    order = np.argsort(np.array(ranks), kind="stable")
    parts, starts, at = [], {}, 0
    for k, i in enumerate(order):
        starts[int(i)] = at
        parts += [np.frombuffer(stretches[i], np.uint8).astype(np.int32) + np.int32(len(stretches) + 1), np.array([k + 1], np.int32)]  # a separator of its own
        at += len(stretches[i]) + 1
    data = np.concatenate(parts)
    earlier, later = reaching(data, length)
    other = earlier | later
    cut = [slice(starts[i], starts[i] + len(stretches[i])) for i in range(len(stretches))]
    return [earlier[c] for c in cut], [other[c] for c in cut]


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(ends) - 1]])]


_KEYS = ["k1", "k2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """docs with the text (null: empty), two hashes of it and the id's place in the order, under the given names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(dict(zip(names, (text, F.xxhash64(text), F.xxhash64(F.lit(11), text, F.length(text)), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))), strict=True)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, ord, text."""
    return _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")), "id", "raw", ["text", "k1", "k2", "ord"]).select("k1", "k2", "ord", "text")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per run: h, w (stretch), k1, k2, ord, pack (the anchor's place, and how far before it the run starts and ends)."""
    bound_batches(docs.sparkSession)
    rows = _texts(docs, id_col, text_col).where(F.octet_length("text") >= length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3)
            for at, n in slices(text):
                found = [anchor_runs(np.frombuffer(t.encode(), np.uint8), length, gram) for t in text.slice(at, n).to_pylist()]
                owner = pa.array(np.repeat(np.arange(n), np.array([len(f[0]) for f in found])))
                h, w, place, first, last = (np.concatenate([f[k] for f in found]) for k in range(5))
                ids = [batch.column(c).slice(at, n).take(owner) for c in range(3)]
                pack = place << 20 | (place - first) << 10 | (place - last)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), *ids, pa.array(pack)], names=["h", "w", "k1", "k2", "ord", "pack"])

    return rows.mapInArrow(run, "h long, w long, k1 long, k2 long, ord long, pack long")


def _place():
    return F.shiftright("pack", 20)


def _first():
    return _place() - F.shiftright("pack", 10).bitwiseAND(F.lit(1023))


def _last():
    return _place() - F.col("pack").bitwiseAND(F.lit(1023))


def spans(docs: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, gram: int = GRAM) -> DataFrame:
    """k1, k2, (ord, where keep is "first",) s: spans to remove, one row per text (and document id)."""
    spark, first = docs.sparkSession, keep == "first"
    told = settle(_sorted_marks(settle(anchors(docs, id_col, text_col, length, gram), "anchors"), first), "marks")
    release(spark)
    marks = _mended(told, first)
    # copies of a whole stretch: all of them, or all but the first
    whole = marks.where("gone").select("k1", "k2", "ord", _first().alias("a"), (_last() + length).alias("b"))
    # the first of each of several stretches of an anchor: read, and compared by suffix arrays
    asked = marks.where("mixed").select("h", "w", "k1", "k2", "ord", "pack", F.col("kind").alias("kinds"))
    buckets = max(1, -(-asked.where(F.col("kinds") <= group).count() // TOGETHER))
    wanted = settle(asked.groupBy("k1", "k2", "ord").agg(F.collect_list(F.struct("h", "w", "kinds", _place().alias("place"), _first().alias("first"), _last().alias("last"))).alias("runs")), "wanted")  # of one text
    texts, _ = part_by_members(_texts(docs, id_col, text_col), F.col("k1"), wanted.select("k1"))  # no others are shuffled
    read = settle(_read_runs(wanted.join(texts, ["k1", "k2", "ord"]), length), "runs")
    crowded = settle(read.groupBy("h").agg(F.max("kinds").alias("most")).where(F.col("most") > group).select("h"), "crowded")
    some, marked = read, None
    if crowded.limit(1).count():
        some = read.join(crowded, "h", "left_anti")
        marked, further = _longer_anchors(read.join(crowded, "h", "left_semi"), length, gram, group)
        some = some.select(*_RUN).unionByName(further)
        buckets += max(1, -(-further.count() // TOGETHER))
    per = some.select(*_RUN).withColumn("g", F.pmod("h", F.lit(buckets))).groupBy("g").applyInPandas(lambda rows: _compare_strips(rows, length), "k1 long, k2 long, ord long, a long, b long, earlier boolean")
    marked = per if marked is None else per.unionByName(marked)
    everything = whole.unionByName((marked.where("earlier") if first else marked).drop("earlier"))
    by = ["k1", "k2", "ord"] if first else _KEYS
    merged = settle(everything.groupBy(*by).agg(F.collect_set(F.struct("a", "b")).alias("s")), "spans")  # of one text
    release(spark)
    return merged


def _sorted_marks(found: DataFrame, first: bool) -> DataFrame:
    """found with gone (a copy of a whole stretch that is to go), mixed (the first of a stretch whose anchor has several),
    kind (the stretch's number within its anchor) and part.

    Rows are dealt into ranges of the whole order, so that an anchor or a stretch with very many rows fills several
    ranges, sorted, and marked in one pass that remembers two rows. ``lead`` marks the first row of each stretch.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound_batches(found.sparkSession)
    dealt = found.repartitionByRange(parts, "h", "w", "ord", "k1", "k2", "pack").sortWithinPartitions("h", "w", "ord", "k1", "k2", "pack")
    names = ["h", "w", "k1", "k2", "ord", "pack"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = np.zeros((0, 6), np.int64)  # the last row, which waits for the one after it
        before = None  # the row before, its stretch's number, and whether it equals its stretch's first
        waiting = None  # the first row of an anchor's first stretch, until a second stretch shows up

        def mark(rows: np.ndarray, after: np.ndarray | None):
            nonlocal before, waiting
            n = len(rows)
            previous = np.concatenate([rows[:1] if before is None else before[0][None], rows[:-1]])
            following = np.concatenate([rows[1:], rows[-1:] if after is None else after[None]])
            new_h = rows[:, 0] != previous[:, 0]
            new_w = new_h | (rows[:, 1] != previous[:, 1])
            if before is None:
                new_h[0] = new_w[0] = True
            same_next = (rows[:, :2] == following[:, :2]).all(axis=1)
            if after is None:
                same_next[-1] = False
            changed = ~new_w & (rows != previous).any(axis=1)
            # running numbers that start afresh at each anchor, and at each stretch
            stretch, at_h = np.cumsum(new_w), np.maximum.accumulate(np.where(new_h, np.arange(n), -1))
            kind = np.where(at_h >= 0, stretch - stretch[np.maximum(at_h, 0)] + 1, stretch + (0 if before is None else before[1]))
            changes, at_w = np.cumsum(changed), np.maximum.accumulate(np.where(new_w, np.arange(n), -1))
            equal = np.where(at_w >= 0, changes == changes[np.maximum(at_w, 0)], (changes == 0) & (before is not None and before[2]))
            copies = ~new_w | same_next
            gone = copies & ~equal if first else copies
            mixed = new_w & (kind > 1)
            # first stretches: a second one follows within these rows, or the row waits
            starts = np.flatnonzero(new_h)
            if len(starts):
                reach = np.maximum.reduceat(kind, starts)
                mixed[starts[reach > 1]] = True
            out = [np.column_stack([rows, gone, mixed, kind, new_w])]
            lead = kind[: starts[0]] if len(starts) else kind
            if waiting is not None and (len(lead) and lead.max() > 1):
                waiting[7] = 1
                out.append(waiting[None])
                waiting = None
            elif waiting is not None and len(starts):
                out.append(waiting[None])
                waiting = None
            if len(starts) and reach[-1] == 1:  # of the last anchor only one stretch was seen so far
                last = out[0][starts[-1]].copy()
                out[0] = np.delete(out[0], starts[-1], axis=0)
                waiting = last
            before = (rows[-1], int(kind[-1]), bool(equal[-1]))
            return np.concatenate(out)

        def batch_of(table: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(table[:, i]) for i in range(6)] + [pa.array(table[:, 6] != 0), pa.array(table[:, 7] != 0), pa.array(table[:, 8]), pa.array(table[:, 9] != 0), pa.array(np.full(len(table), part, np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "gone", "mixed", "kind", "lead", "part"])

        for batch in batches:
            rows = np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
            held = rows[-1:]
            if len(rows) > 1:
                yield batch_of(mark(rows[:-1], rows[-1]))
        if len(held):
            yield batch_of(mark(held, None))
        if waiting is not None:
            yield batch_of(waiting[None])

    return dealt.select(*names).mapInArrow(run, "h long, w long, k1 long, k2 long, ord long, pack long, gone boolean, mixed boolean, kind long, lead boolean, part long")


def _mended(told: DataFrame, first: bool) -> DataFrame:
    """Marks of anchors and stretches that reach over a range's end, which each range saw in part.

    There are fewer of them than ranges. What holds for them as a whole is aggregated (combined before the shuffle) and
    sent along with a row each; all rows stay.
    """
    spark, key = told.sparkSession, F.struct("h", "w")
    ends = told.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("part").collect()  # a row a range
    near = list(zip(ends, ends[1:], strict=False))
    anchors_over = sorted({b["lo"]["h"] for a, b in near if a["hi"]["h"] == b["lo"]["h"]})
    stretches_over = {tuple(b["lo"]) for a, b in near if a["hi"] == b["lo"]}
    if not anchors_over:
        return told
    seen = told.where(F.col("h").isin(anchors_over)).groupBy("h").agg((F.min("w") != F.max("w")).alias("several"), F.count(F.when(F.col("lead"), 1)).alias("leads")).collect()
    of_anchor = spark.createDataFrame([tuple(r) for r in seen], "h long, several boolean, leads long")
    me = F.struct("ord", "k1", "k2", "pack")
    firsts = told.where(F.col("h").isin(sorted({h for h, _ in stretches_over}) or [None]) & F.col("w").isin(sorted({w for _, w in stretches_over}) or [None])).groupBy("h", "w").agg(F.min(me).alias("lo")).collect()
    of_stretch = spark.createDataFrame([(r["h"], r["w"], tuple(r["lo"])) for r in firsts if (r["h"], r["w"]) in stretches_over], "h long, w long, lo struct<ord:long,k1:long,k2:long,pack:long>")
    rows = told.join(F.broadcast(of_anchor), "h", "left").join(F.broadcast(of_stretch), ["h", "w"], "left")
    apart = F.col("lo").isNotNull()
    lead = F.col("lead") & (~apart | F.coalesce(me == F.col("lo"), F.lit(False)))
    return rows.select(
        "h", "w", "k1", "k2", "ord", "pack",
        F.when(apart, F.coalesce(me != F.col("lo"), F.lit(False)) if first else F.lit(True)).otherwise(F.col("gone")).alias("gone"),
        F.when(F.col("several").isNotNull(), lead & F.col("several")).otherwise(F.col("mixed")).alias("mixed"),
        F.coalesce("leads", "kind").alias("kind"),
    )


#: A run to be compared: its anchor, its text, where it starts in it, how far after that the anchor stands, and its bytes.
_RUN = ["h", "k1", "k2", "ord", "at", "lead", "body"]
_RUN_SCHEMA = "h long, k1 long, k2 long, ord long, at long, lead int, body binary"
_RUN_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.binary()]


def _read_runs(joined: DataFrame, length: int) -> DataFrame:
    """The asked runs' bytes, with kinds."""
    bound_batches(joined.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*_RUN_TYPES, pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                data = row["text"].encode()
                out: list[list] = [[] for _ in types]
                for r in row["runs"]:
                    for column, value in zip(out, (r["h"], row["k1"], row["k2"], row["ord"], r["first"], r["place"] - r["first"], data[r["first"] : r["last"] + length], r["kinds"]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*_RUN, "kinds"])

    return joined.select("k1", "k2", "ord", "runs", "text").mapInArrow(run, f"{_RUN_SCHEMA}, kinds long")


def halved(lead: int, body: bytes, lo: int, hi: int, length: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """A run's windows with the anchor at offsets lo .. hi - 1, cut in two halves of offsets: for each half that has any,
    its bounds, how far into the run it starts, its bytes, and the bytes that all windows of the half hold there."""
    out, least, middle = [], lead - (len(body) - length), (lo + hi + 1) // 2
    for x, y in ((lo, middle), (middle, hi)):
        top, bottom = min(lead, y - 1), max(least, x)
        if x < y and bottom <= top:
            out.append((x, y, lead - top, body[lead - top : lead - bottom + length], body[lead - x : lead - (y - 1) + length]))
    return out


def _longer_anchors(rows: DataFrame, length: int, gram: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Runs of anchors with over group different stretches: spans of copies among their halves (k1, k2, ord, a, b, earlier),
    and one run of each kind that is left to be compared, no more than group of an anchor."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        types = [*_RUN_TYPES, pa.int32(), pa.int32()]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for r in batch.to_pylist():
                for x, y, start, body, common in halved(r["lead"], r["body"], r["lo"], r["hi"], length):
                    h = xxh64_intdigest(common, (r["h"] + (x << 32 | y)) & (2**64 - 1)) - 2**63
                    for column, value in zip(out, (h, r["k1"], r["k2"], r["ord"], r["at"] + start, r["lead"] - start, body, x, y), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*_RUN, "lo", "hi"])

    rows = rows.select(*_RUN).withColumns({"lo": F.lit(0), "hi": F.lit(length - gram + 1)})
    spot, copies, settled = F.struct("ord", "k1", "k2", "at"), [], []
    while True:
        parts = settle(rows.mapInArrow(split, f"{_RUN_SCHEMA}, lo int, hi int"), "halves")
        kinds = settle(parts.groupBy("h", "body").agg(F.min(spot).alias("first"), F.min("lead").alias("lead"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.count("*").alias("n")), "kinds")
        alike = parts.join(kinds.where("n > 1").select("h", "body", "first"), ["h", "body"])
        copies.append(alike.select("k1", "k2", "ord", F.col("at").alias("a"), (F.col("at") + F.octet_length("body")).alias("b"), (spot != F.col("first")).alias("earlier")))
        crowded = settle(kinds.groupBy("h").agg(F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("width")).where((F.col("n") > group) & (F.col("width") > 1)).select("h"), "crowded")
        one = kinds.select("h", "first.*", "lead", "body", "lo", "hi")
        settled.append(one.join(crowded, "h", "left_anti").select(*_RUN))
        if not crowded.limit(1).count():
            break
        rows = settle(one.join(crowded, "h", "left_semi"), "crowd")
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    return union(copies), union(settled)


def _compare_strips(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the places whose string starts elsewhere among the rows; earlier: among the rows before, by (ord, key, place).

    Stretches of different anchors have no window in common, so whole anchors are taken together only as far as one
    suffix array stays small.
    """
    rows = rows.drop_duplicates(["k1", "k2", "ord", "at", "h"]).sort_values(["h", "ord", "k1", "k2", "at"], kind="stable")
    sizes = rows.groupby("h", sort=True).size().to_numpy()
    out, start, held = [], 0, 0
    for n in sizes.tolist():
        if held and held + n > TOGETHER:
            out.append(_compare_some(rows.iloc[start : start + held], length))
            start, held = start + held, 0
        held += n
    out.append(_compare_some(rows.iloc[start:], length))
    return pd.concat(out, ignore_index=True)


def _compare_some(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    rows = rows.sort_values(["ord", "k1", "k2", "at"], kind="stable")
    earlier, other = repeated_starts(rows["body"].tolist(), list(range(len(rows))), length)
    who, start, end, flags = [], [], [], []
    for i, (first, any_) in enumerate(zip(earlier, other, strict=True)):
        for flag, mask in ((True, first), (False, any_ & ~first)):
            at = np.flatnonzero(mask)
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                a, b = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
                who.append(np.full(len(a), i))
                start.append(a)
                end.append(b + length)
                flags.append(np.full(len(a), flag))
    none = np.zeros(0, np.int64)
    who, start, end = (np.concatenate([none, *x]) for x in (who, start, end))
    out = rows.iloc[who][["k1", "k2", "ord"]].reset_index(drop=True)
    at = rows["at"].to_numpy()[who]
    return out.assign(a=at + start, b=at + end, earlier=np.concatenate([none.astype(bool), *flags]))


def _whole_characters(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Spans less the characters that they cut."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    starts, ends = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while inside(x):
            x += 1
        while inside(y):
            y -= 1
        if x < y:
            starts.append(x)
            ends.append(y)
    return starts, ends


def strip_repeats(docs: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False, columns: list[str] | None = None, group: int = GROUP, gram: int = GRAM) -> DataFrame:
    """docs with the text that is left (characters that a span cuts stay); with digest instead: n_bytes, n_removed, n_spans
    and kept_sha256 of the bytes left."""
    own = docs.columns
    text, k1, k2, ord_, s, number, again = unused(own, "text", "k1", "k2", "ord", "s", "number", "again")
    inner = [text, k1, k2, ord_]
    alike = None
    if keep == "first":
        several = _keyed(docs, id_col, text_col, inner).groupBy(k1, k2, ord_).agg(F.count("*").alias("n")).where("n > 1")
        if several.limit(1).count():  # of rows alike in id and text one keeps its text
            docs = settle(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
            alike = _keyed(docs, id_col, text_col, inner).groupBy(k1, k2, ord_).agg(F.min(number).alias(again), F.count("*").alias("n")).where("n > 1").drop("n")
    found = spans(docs, keep, id_col, text_col, length, group, gram)
    by = ["k1", "k2", "ord"] if keep == "first" else _KEYS
    own_names = dict(zip(["k1", "k2", "ord", "s"], [k1, k2, ord_, s], strict=True))
    maybe, untouched = _keyed(docs, id_col, text_col, inner), None
    if alike is None:  # only texts that may lose a span are shuffled
        maybe, untouched = part_by_members(maybe, F.col(k1), found.select("k1"))
    joined = maybe.join(found.select(*(F.col(c).alias(own_names[c]) for c in [*by, "s"])), [own_names[c] for c in by], "left")
    copy = F.lit(False)
    if alike is not None:
        joined = joined.join(alike, [k1, k2, ord_], "left")
        copy = F.coalesce(F.col(number) != F.col(again), F.lit(False)) & (F.octet_length(text) >= length)
    fields = [f for f in docs.schema.fields if f.name in own and f.name != text_col and (columns is None or f.name in columns)]
    new = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())] if digest else [StructField(text_col, StringType())]
    taken = {f.name.lower() for f in new}
    fields = [f for f in fields if f.name.lower() not in taken]
    names = [f.name for f in fields]
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in new]
            for body, found, whole in zip(*(batch.column(len(names) + i).to_pylist() for i in range(3)), strict=True):
                raw = body.encode()
                cut = [(0, len(raw))] if whole else [(x["a"], x["b"]) for x in found or []]
                a, b = merge_spans(*np.array(cut, np.int64).reshape(-1, 2).T)
                if not digest:
                    a, b = _whole_characters(raw, a, b)
                edges = [0, *(e for span in zip(a, b, strict=True) for e in span), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                values = (len(raw), len(raw) - len(left), len(a), hashlib.sha256(left).hexdigest()) if digest else (left.decode(),)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] if digest else [pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=names + [f.name for f in new])

    cut = joined.select(*names, text, s, copy.alias(again)).mapInArrow(run, StructType(fields + new))
    if untouched is None:
        return cut
    zero, whole = F.lit(0).cast("long"), F.col(text)
    values = (F.octet_length(whole).cast("long"), zero, zero, F.sha2(whole, 256)) if digest else (whole,)
    return cut.unionByName(untouched.select(*names, *(v.alias(f.name) for v, f in zip(values, new, strict=True))))

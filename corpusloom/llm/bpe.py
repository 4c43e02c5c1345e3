"""Operator 2, byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

Every distinct match of the splitting pattern is one matrix row of byte ids. Each round looks all neighbouring pairs up
in a hash table, merges every row's leftmost pair of least rank, and moves finished rows out (compaction). A match over
``WIDEST`` bytes is no matrix row, as rounds over it would grow with the square of its length: it is merged in the same
order over a linked list whose pairs wait in buckets by rank.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded alike; of pairs with the same rank
the leftmost merges first; any valid text decodes to its own UTF-8 bytes; a match of any length takes time in proportion
to it; an empty table gives no rows; an input column with a result's name gives way to the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .common import append_columns

WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64)
WIDEST = WIDTHS[-1]
#: Distinct matches that a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 300_000
NONE = np.int32(2**31 - 1)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lens[i]] of all i, end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class PairTable:
    """Rank of a pair of ids by open addressing in arrays, looked up many at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(8, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes, todo, slot = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.ranks[slot[won]] = rank[todo[won]]
            todo, slot = todo[~won], slot[~won] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair has no rank; ids below zero are padding."""
        shape = left.shape
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64) & np.uint64(2**32 - 1)).ravel()
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at = slot[todo] + 1 & (1 << self.bits) - 1
            slot[todo] = at
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (seen != np.uint64(2**64 - 1))]
        return np.where((left.ravel() < 0) | (right.ravel() < 0), NONE, out).reshape(shape)


class RankBPE:
    """Encoder and decoder for a rank file in tiktoken's format."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_lens = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get, pairs = self.ranks.get, []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    pairs.append((a, b, rank))
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.table = PairTable(table[:, 0], table[:, 1], table[:, 2].astype(np.int32))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a matrix padded with -1 on the right. Returns the merged matrix and its row lengths."""
        out, lens = np.full_like(ids, -1), (ids >= 0).sum(axis=1)
        rows, cols = np.arange(len(ids)), np.arange(ids.shape[1])
        ranks = self.table.find(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NONE)
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, ranks, at, least = rows[~done], ids[~done], ranks[~done], at[~done], least[~done]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            shift = cols[None, :] + (cols[None, :] > at[:, None])
            np.minimum(shift, ids.shape[1] - 1, out=shift)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            ids[each, at] = least
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], ranks.shape[1] - 1), 1)
            ranks[:, -1] = NONE
            lens[rows] -= 1
            right = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[each, np.minimum(at, ranks.shape[1] - 1)] = np.where(at + 1 < ids.shape[1], self.table.find(ids[each, at], ids[each, right]), NONE)
            has = at > 0
            ranks[each[has], at[has] - 1] = self.table.find(ids[each[has], at[has] - 1], ids[each[has], at[has]])
        return out, lens

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges over a linked list of tokens, for matches too long for a matrix row.

        Pairs wait in a bucket for each rank. The least rank's bucket is emptied from left to right; a merge that brings up
        a lower rank puts the rest of the bucket back first. Every pair enters a bucket once, so time grows with length.
        """
        n, absent, get = len(ids), int(NONE), self.ranks.get
        ranks = self.table.find(ids[:-1], ids[1:])
        order = np.argsort(ranks, kind="stable")
        order = order[ranks[order] != NONE]
        edge = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        buckets = {int(ranks[p[0]]): p.tolist() for p in np.split(order, edge[1:])} if len(order) else {}
        waiting = sorted(buckets)
        words = [self.token(i) for i in ids.tolist()]
        pair, after, before = [*ranks.tolist(), absent], list(range(1, n + 1)), list(range(-1, n - 1))
        while waiting:
            rank = heapq.heappop(waiting)
            places = buckets.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                if pair[i] != rank:
                    continue  # one of its tokens went into another merge
                j = after[i]
                end, word = after[j], words[i] + words[j]
                words[i], pair[j], after[i] = word, -1, end
                lower = False
                pair[i] = absent
                if end < n:
                    before[end] = i
                    found = get(word + words[end], absent)
                    if found != absent:
                        pair[i] = found
                        lower = found < rank
                        if found in buckets:
                            buckets[found].append(i)
                        else:
                            buckets[found] = [i]
                            heapq.heappush(waiting, found)
                start = before[i]
                if start >= 0:
                    found = pair[start] = get(words[start] + word, absent)
                    if found != absent:
                        lower |= found < rank
                        if found in buckets:
                            buckets[found].append(start)
                        else:
                            buckets[found] = [start]
                            heapq.heappush(waiting, found)
                if lower:
                    buckets[rank] = places[k + 1 :] + buckets.get(rank, [])
                    heapq.heappush(waiting, rank)
                    break
        left, i = [], 0
        while i < n:
            left.append(self.ranks[words[i]])
            i = after[i]
        return np.array(left, np.int32)

    def token(self, i: int) -> bytes:
        a = int(self.token_starts[i])
        return self.token_bytes[a : a + int(self.token_lens[i])].tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not yet remembered."""
        raw = [w.encode() for w in words]
        order, found = [], []
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                order.append(i)
                found.append(np.array([whole], np.int32))
            elif len(b) > WIDEST:
                order.append(i)
                found.append(self.merge_long(self.byte_ids[np.frombuffer(b, np.uint8)]))
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(b)), []).append(i)
        lens, flats = [np.array([len(f) for f in found], np.int64)], found
        for width, chosen in by_width.items():
            sizes = np.array([len(raw[i]) for i in chosen])
            grid = np.full((len(chosen), width), -1, np.int32)
            mask = np.arange(width)[None, :] < sizes[:, None]
            grid[mask] = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in chosen), np.uint8)]
            merged, n = self.merge_rows(grid)
            order += chosen
            lens.append(n)
            flats.append(merged[np.arange(width)[None, :] < n[:, None]])
        size = np.concatenate(lens)
        self.memo.update(zip((words[i] for i in order), range(len(self.lens), len(self.lens) + len(order)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.lens = np.concatenate([self.lens, size])
        self.flat = np.concatenate([self.flat, *flats]).astype(np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's ids end."""
        per_text = [self.split(t) for t in texts]
        words = [w for ws in per_text for w in ws]
        if len(self.memo) > REMEMBERED:
            self.forget()
        fresh = list(set(words).difference(self.memo))
        if fresh:
            self.learn(fresh)
        codes = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        lens = self.lens[codes]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([len(ws) for ws in per_text], dtype=np.int64)] if texts else np.zeros(0, np.int64)
        return ragged(self.flat, self.starts[codes], lens), ends

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        lens = self.token_lens[ids]
        data = ragged(self.token_bytes, self.token_starts[ids], lens)
        cuts = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], ends])]
        return [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_loaded: dict[tuple[str, str], RankBPE] = {}


def load(path: str, pattern: str) -> RankBPE:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = RankBPE(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds token_ids (array of int)."""
    from pyspark.sql.types import ArrayType, IntegerType

    def make():
        bpe = load(ranks, pattern)

        def compute(texts: list) -> list[pa.Array]:
            ids, ends = bpe.encode_batch([t or "" for t in texts])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))]

        return compute

    return append_columns(docs, text_col, make, [StructField("token_ids", ArrayType(IntegerType()))])


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds decoded (binary) to rows that hold ids; null ids decode to no bytes."""
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([f for f in encoded.schema.fields if f.name != "decoded"] + [StructField("decoded", BinaryType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = load(ranks, pattern)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int64), *ids])
            out = bpe.decode_batch(flat, np.cumsum([len(x) for x in ids], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes, then decodes the ids: n_tokens, ids_sha256, decoded_sha256, in one pass without shipping ids."""

    def make():
        bpe = load(ranks, pattern)

        def compute(texts: list) -> list[pa.Array]:
            ids, ends = bpe.encode_batch([t or "" for t in texts])
            raw, at = ids.astype("<u4"), np.concatenate([[0], ends])
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            decoded = [hashlib.sha256(b).hexdigest() for b in bpe.decode_batch(ids, ends)]
            return [pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]

        return compute

    return append_columns(docs, text_col, make, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())], keep)

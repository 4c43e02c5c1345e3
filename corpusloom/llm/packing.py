"""Operator 1, packing: first-fit decreasing over a tournament tree of bin capacities.

Documents become pieces of at most ``capacity`` tokens (whole sequences as far as they go, then the rest). The pieces,
a few integers each, are dealt into randomised groups and every group is packed on its own: no text is shuffled, a
group's size does not grow with the corpus, and a document of any length spreads over several groups.

Defined results: a null text counts as empty and yields one piece that holds only the end id; repeated rows are packed
once each; an empty table gives no rows; ties in length go by document id, then start.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

CAPACITY = 1024
#: Documents of a group, about; larger groups waste less at their last sequences.
GROUP_DOCS = 2048
END_ID = 0
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, deal long"
_encoders: dict[tuple[str, bool], object] = {}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(path: str, special: bool = True):
    """texts -> lists of ids, as the tokenizers library gives them with add_special_tokens=False.

    special: an added token's string in a text is that token, which is the library's own behaviour; otherwise it is
    ordinary text (``encode_special_tokens``). A byte-level BPE whose ids follow its merges is run by tiktoken, which is
    several times faster and gives the same ids; any other vocabulary is run by tokenizers.
    """
    if (path, special) in _encoders:
        return _encoders[path, special]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    model, alphabet = spec["model"], byte_alphabet()
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec.get("normalizer") is None
    added = spec.get("added_tokens", [])
    bare = all(t.get("special") and not (t.get("single_word") or t.get("lstrip") or t.get("rstrip")) for t in added)
    if ordered and plain and bare:
        marks = {t["content"]: t["id"] for t in added}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in marks}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        encode = functools.partial(own.encode, allowed_special="all", disallowed_special=()) if special else own.encode_ordinary
        _encoders[path, special] = lambda texts: [encode(t) for t in texts]
    else:
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = not special
        _encoders[path, special] = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    return _encoders[path, special]


def first_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given, which must be decreasing.

    The tree's leaves hold what is left in each bin, its inner nodes the larger child; the leftmost leaf with room is
    found and updated in log2(bins) steps.
    """
    lengths = list(lengths)
    full = sum(1 for n in lengths if n == capacity)
    rest = lengths[full:]
    width = 1
    while width < max(1, len(rest)):
        width *= 2
    tree = [capacity] * (2 * width)
    bins, offsets = list(range(full)), [0] * full
    for n in rest:
        i = 1
        while i < width:
            i *= 2
            if tree[i] < n:
                i += 1
        bins.append(full + i - width)
        offsets.append(capacity - tree[i])
        tree[i] -= n
        while i > 1:
            i //= 2
            left, right = tree[2 * i], tree[2 * i + 1]
            most = left if left >= right else right
            if tree[i] == most:
                break
            tree[i] = most
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its checksum; deal: a digest of the document's own ids, for grouping."""
    bound_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_PIECES}"
    span = capacity * 4096  # tokens of one document that stay in one group

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                rows: list[list] = [[] for _ in range(6)]
                for i, ids in enumerate(encode([t or "" for t in batch.column(1).slice(at, n).to_pylist()])):
                    ids = np.array([*ids, END_ID], "<u4")
                    whole = zlib.crc32(ids[:capacity])
                    for start in range(0, len(ids), capacity):
                        cut = ids[start : start + capacity]
                        for column, value in zip(rows, (i, start, len(cut), zlib.crc32(cut), len(ids), whole << 20 ^ start // span), strict=True):
                            column.append(value)
                key = batch.column(0).slice(at, n).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(c, pa.int64()) for c in rows[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset: sequences of at most capacity tokens, filled first-fit decreasing."""
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer, capacity, id_col, text_col)
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "deal", "doc_tokens"), F.lit(groups))).drop("deal")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in dealt.schema.fields if f.name != 'grp')}, sequence_id long, offset long"

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), capacity)
        out = group.drop(columns="grp")
        out["sequence_id"], out["offset"] = (int(group["grp"].iloc[0]) << 32) + bins, offsets
        return out

    return dealt.groupBy("grp").applyInPandas(fill, schema)

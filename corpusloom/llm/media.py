"""Operator 8, media columns: cropped or edited copies of images by local descriptors.

Corners are found at several scales (Harris response, local maxima), each gets an orientation from its intensity
centroid and 256 binary tests in a patch turned by it. Descriptors meet in Hamming tables (``TABLES`` keys of ``BITS``
bits each) and are compared in full there; they match where they are near and one of the ``BESIDE`` corners next to each
has its key's first ``ASIDE`` bits in common too, for drawings are full of corners that look alike. Two images with two matches that turn and grow alike are candidates; all their descriptors are
then compared with each other, and they are copies where ``AGREE`` corners lie on one similarity transform that two
matches span. Images that are equal byte for byte are one image before any of this.

Within a key every two descriptors are compared, and a descriptor emits its matches with the ``PARTNERS`` images next
before it, so that a group of m copies yields about m matches and not their pairs. Where a descriptor has more, its key
is met again once classes are known, for all further matches with images of other classes, until none is left; matches
within a class need no vote, for all pairs of a class are compared in full and counted, in tiles of bounded size. Keys of more than ``TILE``
descriptors are dealt over tiles, whose pairs are compared in groups of their own.

Images: binary PNG (8 bits, not interlaced), PGM or PPM. The test tables hold no images; the query draws one from every
row of ``embeddings`` and edited copies of a tenth of them (``draw``), and looks for copies among all.

Defined results: null, empty or unreadable images have no corners and are alone in their class, except that equal bytes
share one; an image without an id takes the class of equal bytes that have one, else null, and is compared with no other;
repeated rows are equal bytes; different images under one id count as parts of one; an empty table gives no rows; extra
columns are left out, whatever their names; ties in response go to the upper left corner among the strongest, and are all kept by the spacing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release, settle
from .components import connected_components

SCALES, CORNERS, MARGIN, PATCH = (1.0, 1.5, 2.25), 16, 11, 7
#: Beside an image's CORNERS strongest, all are kept that are the strongest within so many pixels (of each scale) to all
#: sides: they grow with the image's area, and those of a picture that lie inside a crop are corners of the crop.
SPACING = (9, 6, 3)
TABLES, BITS, NEAR, AGREE, TILE = 6, 18, 40, 5, 2048
#: Nearest corners of the same scale that stand beside one, and the bits of their keys of which one's must be equal.
BESIDE, ASIDE = 8, 14
#: Matches of a descriptor that a key emits at first (the rest follows, see copies); so many that agree make an image pair a candidate; pixels by which a transform may miss.
PARTNERS, VOTES, MISS = 32, 2, 4.0
#: How many times as many matches each further round reaches.
FURTHER = 8
#: Matches that a task holds, about, before it leaves out those beyond the ranks.
HELD = 1 << 20
#: Images of a class that are compared with as many others at once.
GROUP = 64
#: The tests whose outcomes are a table's key.
KEYS = np.random.RandomState(7).permutation(256)[: TABLES * BITS].reshape(TABLES, BITS)
_tests: list[np.ndarray] = []
_GRID = np.stack(np.meshgrid(np.arange(-PATCH, PATCH + 1), np.arange(-PATCH, PATCH + 1)), axis=-1).reshape(-1, 2)
_GRID = _GRID[(_GRID**2).sum(axis=1) <= PATCH**2]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values as floats; None where the image cannot be read."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body, width = 8, b"", None
            while at + 8 <= len(data):
                n, kind = struct.unpack(">I4s", data[at : at + 8])
                part = data[at + 8 : at + 8 + n]
                if kind == b"IHDR":
                    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
                    if depth != 8 or laced or colour not in (0, 2, 4, 6):
                        return None
                elif kind == b"IDAT":
                    body += part
                at += 12 + n
            channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
            image = np.zeros((height, width * channels), np.uint8)
            for y in range(height):
                image[y] = _unfilter(rows[y, 0], rows[y, 1:], image[y - 1] if y else np.zeros(width * channels, np.uint8), channels)
            image = image.reshape(height, width, channels)
            return image[:, :, : channels if channels in (1, 3) else channels - 1].mean(axis=2)
        if data and data[:2] in (b"P5", b"P6"):
            head = data.split(None, 4)
            width, height, channels = int(head[1]), int(head[2]), 1 if data[:2] == b"P5" else 3
            start = len(data) - width * height * channels
            return np.frombuffer(data, np.uint8, offset=start).reshape(height, width, channels).mean(axis=2)
    except (ValueError, struct.error, zlib.error, TypeError, KeyError, UnboundLocalError):
        pass
    return None


def _unfilter(kind: int, row: np.ndarray, up: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + up
    if kind == 1:
        return np.cumsum(row.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(row), np.int64)
    for i in range(len(row)):
        a, b = (int(out[i - bpp]) if i >= bpp else 0), int(up[i])
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = int(up[i - bpp]) if i >= bpp else 0
            p = a + b - c
            guess = min((a, b, c), key=lambda v: abs(p - v))
        out[i] = (int(row[i]) + guess) & 255
    return out.astype(np.uint8)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + np.clip(np.round(image), 0, 255).astype(np.uint8).tobytes()


def _box(image: np.ndarray, r: int) -> np.ndarray:
    padded = np.pad(image, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    return (padded[n:, n:] - padded[:-n, n:] - padded[n:, :-n] + padded[:-n, :-n]) / n**2


def _shrink(image: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1:
        return image
    smooth = _box(image, 1)
    h, w = int(image.shape[0] / factor), int(image.shape[1] / factor)
    y, x = np.arange(h) * factor, np.arange(w) * factor
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    return (smooth[y0][:, x0] * (1 - fy) + smooth[y1][:, x0] * fy) * (1 - fx) + (smooth[y0][:, x1] * (1 - fy) + smooth[y1][:, x1] * fy) * fx


def _highest(values: np.ndarray, r: int) -> np.ndarray:
    """The largest value of the square of r to all sides of each place."""
    for axis in (0, 1):
        n = values.shape[axis]
        wide = np.pad(values, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        values = np.max([np.take(wide, range(k, k + n), axis=axis) for k in range(2 * r + 1)], axis=0)
    return values


def tests() -> np.ndarray:
    """256 pairs of points whose comparison says most: of random pairs, on corners of drawn pictures, those that come out
    either way about as often and agree least with each other. Found once a worker, always the same."""
    if not _tests:
        rng = np.random.RandomState(42)
        pairs = np.clip(np.round(rng.normal(0, 3.2, (1600, 2, 2))), -PATCH, PATCH)
        pairs = pairs[(pairs[:, 0] != pairs[:, 1]).any(axis=1)]
        seen = np.concatenate([_look(draw(rng.normal(0, 0.15, 64).tolist()), pairs)[1] for _ in range(60)]).astype(np.float32)
        share, spread = seen.mean(axis=0), seen.std(axis=0) + 1e-6
        alike = np.abs((seen - share).T @ (seen - share)) / len(seen) / np.outer(spread, spread)
        chosen: list[int] = []
        for limit in (0.2, 0.3, 0.4, 0.5, 0.7, 1.1):
            for i in np.argsort(np.abs(share - 0.5), kind="stable").tolist():
                if len(chosen) < 256 and i not in chosen and (not chosen or alike[i, chosen].max() < limit):
                    chosen.append(i)
        _tests.append(pairs[chosen])
    return _tests[0]


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) of the corners, and their 32-byte descriptors."""
    spots, bits = _look(image, tests())
    return spots, np.packbits(bits, axis=1)


def _look(image: np.ndarray | None, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners, and for each the outcome of the pairs' comparisons in a patch turned by its angle."""
    spots, bits = [np.zeros((0, 4))], [np.zeros((0, len(pairs)), bool)]
    for scale, spacing in zip(SCALES, SPACING, strict=True) if image is not None else ():
        small = _shrink(image, scale)
        if min(small.shape) < 2 * MARGIN + 3:
            continue
        smooth = _box(small, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[MARGIN:-MARGIN, MARGIN:-MARGIN]
        around = np.full(inner.shape, -np.inf)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    around = np.maximum(around, response[MARGIN + dy : response.shape[0] - MARGIN + dy, MARGIN + dx : response.shape[1] - MARGIN + dx])
        ys, xs = np.nonzero((inner > around) & (inner > 1.0))
        if not len(ys):
            continue
        best = np.argsort(-inner[ys, xs], kind="stable")
        best = best[(np.arange(len(best)) < CORNERS) | (inner >= _highest(inner, spacing))[ys[best], xs[best]]]
        ys, xs = ys[best] + MARGIN, xs[best] + MARGIN
        patch = smooth[ys[:, None] + _GRID[:, 1], xs[:, None] + _GRID[:, 0]]
        angle = np.arctan2((patch * _GRID[:, 1]).sum(axis=1), (patch * _GRID[:, 0]).sum(axis=1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.round(pairs[None, :, :, 0] * cos - pairs[None, :, :, 1] * sin).astype(int)
        py = np.round(pairs[None, :, :, 0] * sin + pairs[None, :, :, 1] * cos).astype(int)
        limit = MARGIN - 1
        px, py = np.clip(px, -limit, limit), np.clip(py, -limit, limit)
        seen = smooth[ys[:, None, None] + py, xs[:, None, None] + px]
        bits.append(seen[:, :, 0] < seen[:, :, 1])
        spots.append(np.stack([xs * scale, ys * scale, np.full(len(xs), scale), angle], axis=1))
    return np.concatenate(spots), np.concatenate(bits)


#: A spot is five longs: its packed place, scale and angle, and the descriptor's four words.
SPOT = 5


def pack_spots(where: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Quarter pixels, the scale's number, and 1024ths of a turn in one long, before the descriptor's words."""
    x, y = (np.round(where[:, i] * 4).astype(np.int64) for i in (0, 1))
    scale = np.searchsorted(SCALES, where[:, 2])
    angle = np.round(where[:, 3] / (2 * np.pi) * 1024).astype(np.int64) % 1024
    return np.concatenate([(x << 32 | y << 12 | scale << 10 | angle)[:, None], codes.view(np.int64).reshape(-1, 4)], axis=1)


def unpack_spots(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, scale, angle."""
    return (packed >> 32) / 4, (packed >> 12 & 0xFFFFF) / 4, np.array(SCALES)[packed >> 10 & 3], (packed & 1023) / 1024 * 2 * np.pi


def corners(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """media_id, digest of the bytes, spots (SPOT longs each)."""
    bound_batches(media.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [pack_spots(*describe(decode(data))).ravel() for data in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, spots)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *spots]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["media_id", "digest", "spots"])

    rows = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(image_col).alias("image"), F.sha2(F.coalesce(F.col(image_col), F.lit(b"")), 256).alias("digest"))
    return rows.mapInArrow(run, "media_id long, digest string, spots array<long>")


def _meet(key: np.ndarray, image: np.ndarray, code: np.ndarray, near: int = NEAR, side: np.ndarray | None = None, beside: np.ndarray | None = None, root: np.ndarray | None = None, ranks: tuple[int, int] = (0, PARTNERS)) -> tuple[np.ndarray, ...]:
    """Rows (earlier, later) of different images that match, where rows of equal keys are neighbours in order of image.

    Of a row's matches with earlier rows, counted from the nearest, those beyond ranks[0] and up to ranks[1] are given if
    the roots differ; with roots, the keys that hold rows with more matches are a third result.
    """
    n = len(image)
    row, run, short = _runs(np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64), beside)
    last = np.flatnonzero(np.concatenate([run[1:] != run[:-1], [True]]))
    end = last[np.searchsorted(last, np.arange(len(row)))]
    made, left, right, held = np.zeros(n, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    w0, w1 = code[:, 0].copy(), code[:, 1].copy()
    at, off = np.arange(len(row)), 1
    while True:
        at = at[at + off <= end[at]]
        if not len(at):
            break
        a, b = row[at], row[at + off]
        # two words rule most pairs out
        hit = np.flatnonzero(np.bitwise_count(w0[a] ^ w0[b]) + np.bitwise_count(w1[a] ^ w1[b]) <= near)
        hit = hit[(np.bitwise_count(code[a[hit]] ^ code[b[hit]]).sum(axis=1) <= near) & (image[a[hit]] != image[b[hit]])]
        if side is not None:
            hit = hit[(side[a[hit]] < 0) | (side[a[hit]] != side[b[hit]])]
        if beside is not None:
            # rows that meet in several runs match in the first of them
            common, own = _shared(beside[a[hit]], beside[b[hit]]), short[at[hit]]
            hit = hit[(common != 0xFFFF) & ((own < 0) | (own == common))]
        np.add.at(made, b[hit], 1)
        left.append(a[hit])
        right.append(b[hit])
        held += len(hit)
        if held > HELD:
            kept = _nearest(left, right, ranks[1])
            left, right, held = [kept[0]], [kept[1]], 0
        off += 1
    left, right, rank = _nearest(left, right, ranks[1])
    given = rank > ranks[0]
    if root is not None:
        given &= root[left] != root[right]
    out = left[given], right[given]
    return out if root is None else (*out, np.unique(key[made > ranks[1]]))


def _runs(number: np.ndarray, beside: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """row, run, short: runs of rows with one key (by its number) and one of their neighbours' short keys in common, in
    order of rows, so that only rows that may match are compared; a key's rows make one run, with a short of -1, where
    its runs would hold more pairs than that, or where there are no neighbours."""
    every = np.arange(len(number))
    if beside is None or not len(number):
        return every, number, np.full(len(number), -1)
    shorts = np.sort(_shorts(beside), axis=1).astype(np.int64)
    use = shorts != 0xFFFF
    use[:, 1:] &= shorts[:, 1:] != shorts[:, :-1]
    row, short = np.nonzero(use)[0], shorts[use]
    run = number[row] << 16 | short
    order = np.argsort(run, kind="stable")
    row, run, short = row[order], run[order], short[order]
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(run)))
    size = np.bincount(number)
    pairs = np.bincount(number[row[start]], weights=length * (length - 1), minlength=len(size))
    whole = pairs > size * (size - 1)
    keep, own = np.repeat(length > 1, length) & ~whole[number[row]], every[whole[number]]
    return np.concatenate([row[keep], own]), np.concatenate([run[keep], number[own] << 16 | 0xFFFF]), np.concatenate([short[keep], np.full(len(own), -1)])


def _nearest(left: list[np.ndarray], right: list[np.ndarray], most: int) -> tuple[np.ndarray, ...]:
    """left, right, rank: of each right row's pairs so many with the nearest left rows, which come before it."""
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((-a, b))
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b) + 1
    return a[rank <= most], b[rank <= most], rank[rank <= most]


def _beside(spots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spot x BESIDE: rows of the nearest spots of the same image and scale; -1 where there are fewer."""
    x, y, scale, _ = unpack_spots(spots[:, 0])
    where, out, at = x + 1j * y, np.full((len(spots), BESIDE), -1), 0
    for n in sizes.tolist():
        z, s = where[at : at + n], scale[at : at + n]
        far = np.where(s[:, None] == s, np.abs(z[:, None] - z), np.inf)
        np.fill_diagonal(far, np.inf)
        near = np.argsort(far, axis=1, kind="stable")[:, :BESIDE]
        out[at : at + n, : near.shape[1]] = np.where(np.isfinite(np.take_along_axis(far, near, axis=1)), near + at, -1)
        at += n
    return out


def _shorts(beside: np.ndarray) -> np.ndarray:
    """The short numbers in each row's longs."""
    return np.ascontiguousarray(beside).view(np.uint16).reshape(-1, BESIDE)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the short numbers in a row's longs that is among those of the other's; ones alone stand for none."""
    a, b = _shorts(a), _shorts(b)
    return np.where((a[:, :, None] == b[:, None]).any(axis=2), a, 0xFFFF).min(axis=1, initial=0xFFFF)


def table_keys(code: np.ndarray) -> np.ndarray:
    """Descriptor x table: the table's number before its tests' outcomes. code: rows of four words."""
    bits = np.unpackbits(np.ascontiguousarray(code).view(np.uint8).reshape(len(code), 32), axis=1)
    return (bits[:, KEYS] @ (1 << np.arange(BITS))).astype(np.int32) | (np.arange(TABLES, dtype=np.int32) << BITS)


def _keyed(reps: DataFrame, tables: range) -> DataFrame:
    """key, media_id, place, w0 .. w3, b0 and b1 (the neighbours' short keys): each spot under its key of each of the tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = np.array([len(x) // SPOT for x in part.column(1)], np.int64)
                spots = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SPOT)
                owner = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
                keys, next_to = table_keys(spots[:, 1:])[:, tables], _beside(spots, sizes)
                short = np.where(next_to[:, :, None] < 0, 0xFFFF, keys[next_to] & ((1 << ASIDE) - 1)).astype(np.uint16)
                beside = np.ascontiguousarray(short.transpose(0, 2, 1)).view(np.int64).reshape(-1, BESIDE // 4)
                cols = [keys.ravel(), np.repeat(owner, len(tables)), *(np.repeat(spots[:, k], len(tables)) for k in range(SPOT)), *np.ascontiguousarray(beside.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "media_id", "place", "w0", "w1", "w2", "w3", "b0", "b1"])

    return reps.select("media_id", "spots").mapInArrow(run, "key int, media_id long, place long, w0 long, w1 long, w2 long, w3 long, b0 long, b1 long")


def matches(reps: DataFrame, tile: int = TILE, tables: range = range(TABLES), ranks: tuple[int, int] = (0, PARTNERS), only: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """p, q, at, to: places of corners of p that match one of q, another image, in the Hamming tables; and rows without p
    whose at is a key that has matches beyond the ranks. reps: media_id, spots. only: key, those to meet. roots: node,
    root; images of one root are not matched.
    """
    rows = _keyed(reps, tables)
    if only is not None:
        # the other keys' rows go no further
        rows = rows.join(only.select(F.shiftright("key", 32).cast("int").alias("key")).distinct(), "key", "left_semi")
    # at most one key for each tile descriptors of a table is large
    large = settle(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile), "keys")
    met = rows.join(F.broadcast(large), "key", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("media_id"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    # one long tells groups apart, so that shuffled rows stay small
    group = F.shiftleft(F.col("key").cast("long"), 32).bitwiseOR(F.shiftleft("ij.i", 16)).bitwiseOR(F.col("ij.j")).alias("key")
    # the second of two tiles has the place's sign
    place = F.when((F.col("ij.i") < F.col("ij.j")) & (F.col("mine") == F.col("ij.j")), F.col("place").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("place")).alias("place")
    met = met.withColumn("ij", F.explode(pair)).select(group, "media_id", place, "w0", "w1", "w2", "w3", "b0", "b1")
    if only is not None:
        met = met.join(only, "key", "left_semi")
    if roots is not None:
        met = met.join(roots.withColumnRenamed("node", "media_id"), "media_id", "left").withColumn("root", F.coalesce("root", "media_id"))
    buckets = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(buckets, "key").sortWithinPartitions("key", "media_id", "place")

    def found(rows: pa.Table) -> pa.RecordBatch:
        key, image, place = (rows.column(c).to_numpy() for c in ("key", "media_id", "place"))
        code = np.stack([rows.column(f"w{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
        root = rows.column("root").to_numpy() if "root" in rows.column_names else image
        # a tile's own pairs belong to the group of that tile alone
        side, place = np.where(key >> 16 & 0xFFFF != key & 0xFFFF, place < 0, -1), place & (2**63 - 1)
        left, right, more = _meet(key, image, code, side=side, beside=np.stack([rows.column(c).to_numpy() for c in ("b0", "b1")], axis=1), root=root, ranks=ranks)
        none = pa.nulls(len(more), pa.int64())
        columns = [pa.chunked_array([pa.array(v), w]).combine_chunks() for v, w in ((image[left], none), (image[right], none), (place[left], pa.array(more)), (place[right], none))]
        return pa.RecordBatch.from_arrays(columns, names=["p", "q", "at", "to"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = held.column("key").to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield found(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield found(held)

    return met.mapInArrow(run, "p long, q long, at long, to long")


def agree_on_transform(a: np.ndarray, b: np.ndarray, agree: int = AGREE, near: int = NEAR) -> bool:
    """Whether so many corners match that lie on one similarity transform. a, b: spots of two images."""
    a, b = a.reshape(-1, SPOT), b.reshape(-1, SPOT)
    if min(len(a), len(b)) < agree:
        return False
    ca, cb = (np.ascontiguousarray(v[:, 1:]).view(np.uint64) for v in (a, b))
    step = max(1, (1 << 20) // len(cb))
    met = [np.nonzero(np.bitwise_count(ca[at : at + step, None] ^ cb[None]).sum(axis=2) <= near) for at in range(0, len(ca), step)]
    i = np.concatenate([m[0] + at * step for at, m in enumerate(met)])
    j = np.concatenate([m[1] for m in met])
    if len(i) < agree:
        return False
    (px, py, ps, pt), (qx, qy, qs, qt) = unpack_spots(a[i, 0]), unpack_spots(b[j, 0])
    p, q, grow, turn = px + 1j * py, qx + 1j * qy, qs / ps, qt - pt
    lone = lambda v: len(np.unique(np.round(v)))
    for m in range(len(i)):
        # companions: what the match's own turn and growth, which are coarse, do not rule out
        dp, dq = p - p[m], q - q[m]
        far = np.abs(dp)
        own = grow[m] * np.exp(1j * turn[m])
        fits = (np.abs(np.angle(np.exp(1j * (turn - turn[m])))) < 0.6) & (np.abs(np.log(grow / grow[m])) < 0.9) & (np.abs(dq - own * dp) <= 0.8 * grow[m] * far + 2 * MISS)
        near_m = np.flatnonzero(fits)
        if len(near_m) < agree or lone(p[near_m]) < agree:
            continue
        for n in near_m[(far[near_m] >= 8) & (np.abs(dq[near_m]) >= 4)].tolist():
            on = np.abs(dq - dq[n] / dp[n] * dp) <= MISS
            on &= fits
            if on.sum() >= agree and min(lone(p[on]), lone(q[on])) >= agree:
                return True
    return False


def verified(pairs: DataFrame, reps: DataFrame, agree: int = AGREE) -> DataFrame:
    """The pairs p, q that agree_on_transform, by full comparison of their descriptors."""
    spots = lambda c: reps.select(F.col("media_id").alias(c), F.col("spots").alias(f"{c}_spots"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [agree_on_transform(np.asarray(a.values), np.asarray(b.values), agree) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(spots("p"), "p").join(spots("q"), "q").select("p", "q", "p_spots", "q_spots").mapInArrow(run, "p long, q long")


def links_within(members: DataFrame, agree: int = AGREE, tile: int = GROUP) -> DataFrame:
    """node, n: images found to be copies of each member of a class. members: root, node, copies (images of equal bytes), spots.

    All pairs of a class are compared in full, in groups of two tiles of about so many members; only sums leave a group.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    met = members.join(sizes, "root").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j")))
    met = met.withColumn("ij", F.explode(pair)).select("root", "ij.*", "t", "node", "copies", "spots")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        node, copies, side = (group.column(c).to_numpy() for c in ("node", "copies", "t"))
        spots = [np.asarray(x.values) for x in group.column("spots")]
        n, order = np.zeros(len(node), np.int64), np.argsort(node)
        for at, a in enumerate(order):
            for b in order[at + 1 :]:
                # a tile's own pairs belong to the group of that tile alone
                if (i == j or side[a] != side[b]) and agree_on_transform(spots[a], spots[b], agree):
                    n[a] += copies[b]
                    n[b] += copies[a]
        return pa.table({"node": node, "n": n})

    return met.groupBy("root", "i", "j").applyInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _agree(a: Column, b: Column) -> Column:
    """Whether two matches of an image pair, from different corners, turn by about the same angle (60 degrees) and grow alike."""
    part = lambda v, at, mask: F.shiftright(v, at).bitwiseAND(F.lit(mask))
    turn = F.pmod(part(a["to"], 0, 1023) - part(a["at"], 0, 1023) - part(b["to"], 0, 1023) + part(b["at"], 0, 1023), F.lit(1024))
    grow = part(a["to"], 10, 3) - part(a["at"], 10, 3) - part(b["to"], 10, 3) + part(b["at"], 10, 3)
    return (a["at"] != b["at"]) & (a["to"] != b["to"]) & ((turn <= 171) | (turn >= 853)) & (F.abs(grow) <= 1)


def joined(reps: DataFrame, agree: int = AGREE) -> DataFrame:
    """node, root: the smallest image that each image with a link reaches. reps: media_id, spots."""
    cornered, ranks, rest, roots, votes, tried, links = reps.where(F.size("spots") > 0), (0, PARTNERS), None, None, [], [], []
    crowded = range(TABLES)
    while True:
        met = []
        # a table at a time, so that only its shuffle takes disk
        for at in crowded:
            met.append(settle(matches(cornered, tables=range(at, at + 1), ranks=ranks, only=rest, roots=roots), "votes"))
            release(reps.sparkSession)
        found_now = reduce(DataFrame.unionByName, met)
        votes.append(found_now.where("p IS NOT NULL"))
        seen = reduce(DataFrame.unionByName, votes).groupBy("p", "q").agg(F.collect_set(F.struct("at", "to")).alias("v")).where(F.size("v") >= VOTES)
        candidates = seen.where(F.exists("v", lambda a: F.exists("v", lambda b: _agree(a, b)))).select("p", "q")
        if tried:
            candidates = candidates.join(reduce(DataFrame.unionByName, tried), ["p", "q"], "left_anti")
        tried.append(settle(candidates, "candidates"))
        links.append(settle(verified(tried[-1], reps, agree), "links"))
        roots = settle(connected_components(reduce(DataFrame.unionByName, links).select(F.col("p").alias("a"), F.col("q").alias("b"))), "roots")
        rest = settle(found_now.where("p IS NULL").select(F.col("at").alias("key")).distinct(), "rest")
        crowded = sorted(r["t"] for r in rest.select(F.shiftright("key", 32 + BITS).alias("t")).distinct().collect())
        if not crowded:
            return roots
        # what the ranks left, between classes that are still apart
        ranks = (ranks[1], ranks[1] * FURTHER)


def copies(media: DataFrame, id_col: str = "media_id", image_col: str = "image", agree: int = AGREE) -> DataFrame:
    """media_id, n_corners, class_id (the smallest id among an image's copies), n_links (images found to be its copies)."""
    found = settle(corners(media, id_col, image_col), "corners")
    images = found.select("media_id", "digest", F.floor(F.size("spots") / SPOT).cast("int").alias("n_corners"))
    same = images.groupBy("digest").agg(F.min("media_id").alias("rep"), F.count("*").alias("copies"))
    reps = found.join(same.select(F.col("rep").alias("media_id"), "digest"), ["media_id", "digest"], "left_semi").groupBy("media_id", "digest").agg(F.first("spots").alias("spots")).select("media_id", "spots")
    roots = joined(reps, agree)
    members = roots.join(same.select(F.col("rep").alias("node"), "copies"), "node").join(reps.withColumnRenamed("media_id", "node"), "node")
    degree = links_within(members, agree)
    reps = same.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("node", "rep"), "rep", "left")
    named = reps.select("digest", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return images.join(named, "digest").select("media_id", "n_corners", "class_id", "n_links")


def draw(values: list[float], size: int = 96) -> np.ndarray:
    """A picture that shows a vector: translucent boxes at places and of greys that follow its values, over a grain of its own."""
    v = np.nan_to_num(np.resize(np.array(values or [0.0], float), 64), nan=0.0, posinf=0.0, neginf=0.0)
    part = lambda x: np.mod(np.abs(x), 1.0)
    seed = zlib.crc32(v.tobytes())
    rng = np.random.RandomState(seed)
    image = np.kron(rng.uniform(40, 210, (size // 3, size // 3)), np.ones((3, 3)))
    for i in range(20):
        x, y, w, h = (part(v[(3 * i + k) % 64] * (17 + 5 * k)) for k in range(4))
        x, y, w, h = int(x * size), int(y * size), 4 + int(w * 18), 4 + int(h * 18)
        image[y : y + h, x : x + w] = 0.45 * (20 + 230 * part(v[i] * 31)) + 0.55 * image[y : y + h, x : x + w]
    return _box(image, 1)


#: Kinds of edits.
EDITS = 7


def _turn(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle within its frame; what comes from outside repeats the edge."""
    h, w = image.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    x, y = np.clip(x * c - y * s + (w - 1) / 2, 0, w - 1.001), np.clip(x * s + y * c + (h - 1) / 2, 0, h - 1.001)
    x0, y0 = x.astype(int), y.astype(int)
    fx, fy = x - x0, y - y0
    return (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy


def edit(image: np.ndarray, kind: int) -> np.ndarray:
    """A copy: cropped, brighter with less contrast, turned by a right angle, overprinted in a corner, rescaled to two
    thirds, noisy, or turned by 17 degrees."""
    if kind == 0:
        return image[9:, 7:-5].copy()
    if kind == 1:
        return np.clip(image * 0.8 + 35, 0, 255)
    if kind == 2:
        return np.rot90(image).copy()
    if kind == 4:
        return _shrink(image, 1.5)
    if kind == 5:
        return image + np.random.RandomState(zlib.crc32(image.tobytes())).normal(0, 4, image.shape)
    if kind == 6:
        return _turn(image, 17)
    out = image.copy()
    out[:24, :30] = 128
    return out


#: Vectors that a task draws, about.
DRAWN = 500


def album(vectors: DataFrame, id_col: str = "vec_id", values_col: str = "embedding") -> DataFrame:
    """media_id, image: a picture of every row (2 * id), and edited copies (2 * id + 1) of the ids divisible by 10.

    Numbers beyond 64 bits wrap around; a row without an id gives a picture without one.
    """
    bound_batches(vectors.sparkSession)
    wrapped = lambda n: (n + 2**63) % 2**64 - 2**63

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, images = [], []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = draw(values)
                ids.append(None if key is None else wrapped(2 * key))
                images.append(encode_pgm(image))
                if key is not None and key % 10 == 0:
                    ids.append(wrapped(2 * key + 1))
                    images.append(encode_pgm(edit(image, key // 10 % EDITS)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["media_id", "image"])

    # vectors are small and drawing is slow: few files are dealt over many tasks
    dealt = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(values_col).alias("v")).repartition(max(1, -(-vectors.count() // DRAWN)))
    return dealt.mapInArrow(run, "media_id long, image binary")

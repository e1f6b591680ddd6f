"""Copies among images by local descriptors.

An image is a grey raster in a binary column (netpbm P5). At scales down to the smallest usable one its corners are
found (Harris), each gets an orientation from the intensity centroid of its disc, and 256 fixed binary tests on the
turned disc give its descriptor. The number of corners grows with the area.

Hamming tables: a descriptor has eight parts of 32 bits; table t lists part t. Descriptors that differ in at most seven
bits agree in one part at least. Smooth pictures have many like corners, so an entry holds two of them: part t of a
corner and of one of its ``NEIGHBOURS`` nearest of the same scale, with the turn and distance between them in coarse
steps, which a change of size or angle leaves as they are. Images that share an entry are held against each other as
``lists`` says: all descriptors are matched, and the matches must agree on one similarity transform in ``AGREE`` places.
Cropped, turned, brightened or resized copies pass; corners that happen to look alike do not.

Skew: images of equal pixels are one image until the end, lists are held against a pivot and dealt into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratigraph.llm.lists import list_classes
from stratigraph.session import ship
from stratigraph.storage import materialize

#: Pyramid factor, pixels of a level for each of its corners, least and most corners of a level, radius of a disc, tests, seed of the tests.
FACTOR, AREA, FEWEST, MOST, RADIUS, TESTS, SEED = 1.13, 512, 8, 512, 9, 256, 20
#: Most differing bits of matching descriptors, places that must agree, pixels they may miss by.
BITS, AGREE, MISS = 28, 5, 3.0
#: Parts of a descriptor, neighbours that a corner is listed with, least distance between them in pixels of the level.
PARTS, NEIGHBOURS, APART = 8, 6, 10
#: Steps of a whole turn, steps of a doubled distance, places from the first corner's part to the other's.
TURNS, STEPS, OTHER = 8, 3, 3
DESCRIBED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("spots", T.BinaryType()), T.StructField("bits", T.BinaryType())])


def encode(pixels: np.ndarray) -> bytes:
    """Netpbm P5 bytes of a grey raster."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey raster of P5 bytes; None for null, empty or other bytes."""
    parts = bytes(image or b"").split(maxsplit=3)
    if len(parts) < 4 or parts[0] != b"P5" or not (parts[1].isdigit() and parts[2].isdigit()):
        return None
    wide, high = int(parts[1]), int(parts[2])
    start = len(image) - wide * high
    return np.frombuffer(image, np.uint8, wide * high, start).reshape(high, wide) if wide and high and start > 0 else None


def render(vector: list[float] | None, size: int = 64) -> bytes | None:
    """A vector as an image: its values fill the least square grid, stretched to 0..255, enlarged smoothly."""
    if vector is None or len(vector) == 0:
        return None
    side = int(np.ceil(np.sqrt(len(vector))))
    grid = np.zeros(side * side)
    grid[: len(vector)] = np.nan_to_num(np.asarray(vector, float))
    low, high = grid.min(), grid.max()
    return encode(_resize(((grid - low) / (high - low or 1) * 255).reshape(side, side), size, size).round())


def _resize(a: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Bilinear resampling of a raster."""
    y, x = np.linspace(0, a.shape[0] - 1, high), np.linspace(0, a.shape[1] - 1, wide)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    v, u = (y - y0)[:, None], x - x0
    return (a[y0][:, x0] * (1 - u) + a[y0][:, x1] * u) * (1 - v) + (a[y1][:, x0] * (1 - u) + a[y1][:, x1] * u) * v


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r+1, edges repeated."""
    s = np.cumsum(np.cumsum(np.pad(a, ((r + 1, r), (r + 1, r)), "edge"), 0), 1)
    n = 2 * r + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


@lru_cache(1)
def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Test points [TESTS, 2 ends, (y, x)] and the points of the disc."""
    rng = np.random.default_rng(SEED)
    ends = np.clip(rng.normal(0, RADIUS / 2, (TESTS, 2, 2)), -RADIUS / np.sqrt(2), RADIUS / np.sqrt(2))
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    return ends, np.stack([y, x], -1)[y * y + x * x <= RADIUS * RADIUS]


def describe(pixels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Spots [n, (y, x, scale, angle)] in pixels of the whole image, and descriptors [n, 4] of 64 bits each."""
    spots, bits = [np.zeros((0, 4))], [np.zeros((0, 4), np.uint64)]
    if pixels is None:
        return spots[0], bits[0]
    ends, disc = _tests()
    for level in count():
        scale = FACTOR**level
        high, wide = round(pixels.shape[0] / scale), round(pixels.shape[1] / scale)
        if min(high, wide) < 2 * RADIUS + 5:
            break
        a = pixels.astype(float) if not level else _resize(_box(pixels.astype(float), max(1, round(scale / 2))), high, wide)
        gy, gx = np.gradient(_box(a, 1))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = RADIUS + 1
        inner = strength[edge:-edge, edge:-edge]
        around = np.max([strength[edge + dy : high - edge + dy, edge + dx : wide - edge + dx] for dy in range(-2, 3) for dx in range(-2, 3)], 0)
        at = np.argwhere((inner >= around) & (inner > max(1.0, 0.01 * strength.max())))
        if not len(at):
            continue
        order = np.lexsort((at[:, 1], at[:, 0], -inner[at[:, 0], at[:, 1]]))[: min(MOST, max(FEWEST, high * wide // AREA))]
        at = at[order] + edge
        soft = _box(a, 2)
        patch = soft[at[:, :1] + disc[:, 0], at[:, 1:] + disc[:, 1]]
        angle = np.arctan2(patch @ disc[:, 0], patch @ disc[:, 1])
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        y = np.rint(ends[None, :, :, 0] * cos + ends[None, :, :, 1] * sin).astype(int) + at[:, 0, None, None]
        x = np.rint(ends[None, :, :, 1] * cos - ends[None, :, :, 0] * sin).astype(int) + at[:, 1, None, None]
        # what every turned disc has in common, its slope, is taken off before the tests
        weight = (disc**2).sum(0)
        slope_y, slope_x = ((patch @ disc[:, k] / weight[k])[:, None, None] for k in range(2))
        seen = soft[np.clip(y, 0, high - 1), np.clip(x, 0, wide - 1)] - slope_y * (y - at[:, 0, None, None]) - slope_x * (x - at[:, 1, None, None])
        bits.append(np.packbits(seen[:, :, 0] < seen[:, :, 1], axis=1, bitorder="little").view("<u8"))
        spots.append(np.c_[at * scale, np.full(len(at), scale), angle])
    return np.concatenate(spots), np.concatenate(bits)


def agreeing(spots_a: np.ndarray, bits_a: np.ndarray, spots_b: np.ndarray, bits_b: np.ndarray) -> int:
    """Most places of two images that one similarity transform explains; the order of the two does not matter.

    Candidates are the transforms that one match gives by itself, and those it gives with up to 16 others.
    """
    if min(len(bits_a), len(bits_b)) < AGREE:
        return 0
    if (len(bits_a), bits_a.tobytes(), spots_a.tobytes()) > (len(bits_b), bits_b.tobytes(), spots_b.tobytes()):
        spots_a, bits_a, spots_b, bits_b = spots_b, bits_b, spots_a, bits_a
    gap = np.bitwise_count(bits_a[:, None] ^ bits_b[None]).sum(2, dtype=np.int16)
    i, j = np.nonzero((gap <= BITS) & (gap == gap.min(1, keepdims=True)) & (gap == gap.min(0, keepdims=True)))
    if len(i) < AGREE:
        return 0
    a, b = spots_a[i], spots_b[j]
    za, zb = a[:, 1] + 1j * a[:, 0], b[:, 1] + 1j * b[:, 0]
    # places that several levels found count once, in either image
    cell = lambda z: np.unique(np.round(z / 4), return_inverse=True)[1]
    places = [np.eye(c.max() + 1, dtype=np.float32)[c] for c in (cell(za), cell(zb))]
    if min(p.shape[1] for p in places) < AGREE:
        return 0
    least = MISS * np.maximum(b[:, 2], 1)

    def explained(at: np.ndarray, turn: np.ndarray) -> int:
        sane = (np.abs(turn) > 0.2) & (np.abs(turn) < 5)
        best = 0
        for some in np.array_split(np.flatnonzero(sane), 1 + len(turn) * len(i) // 2_000_000):
            k, t = at[some], turn[some]
            inside = (np.abs(zb - zb[k][:, None] - t[:, None] * (za - za[k][:, None])) <= least).astype(np.float32)
            if len(inside):
                best = max(best, int(np.minimum(*[((inside @ p) > 0).sum(1) for p in places]).max()))
        return best

    own = np.arange(len(i))
    best = explained(own, (b[:, 2] / a[:, 2]) * np.exp(1j * (b[:, 3] - a[:, 3])))
    if best < AGREE:
        for step in np.unique(np.linspace(1, len(i) - 1, min(16, len(i) - 1)).astype(int)):
            with_ = (own + step) % len(i)
            far = np.flatnonzero(np.abs(za[with_] - za) > 8)
            best = max(best, explained(far, (zb[with_] - zb)[far] / (za[with_] - za)[far]))
    return best


def entries(spots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Keys of an image in the tables, each once: parts of two neighbouring corners with the turn and distance between.

    Of the two, the one with the lesser part t comes first: its part t is taken and of the other the part ``OTHER``
    places on, as the discs of neighbours overlap. Turns are measured from the first one's orientation.
    """
    met = [np.zeros((0, 2), np.int64)]
    place, angle = (spots[:, 1] + 1j * spots[:, 0]) / spots[:, 2], spots[:, 3]
    for scale in np.unique(spots[:, 2]):
        own = np.flatnonzero(spots[:, 2] == scale)
        far = np.abs(place[own][:, None] - place[own])
        far[far < APART] = np.inf
        close = np.argsort(far, 1, kind="stable")[:, :NEIGHBOURS]
        i, j = np.repeat(np.arange(len(own)), close.shape[1]), close.ravel()
        there = np.isfinite(far[i, j])
        met.append(own[np.c_[i, j][there]])
    i, j = np.unique(np.sort(np.concatenate(met), 1), axis=0).T[:, :, None]
    parts, table = bits.view("<u4").reshape(-1, PARTS).astype(np.uint64), np.arange(PARTS)
    swap = parts[i, table] > parts[j, table]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    gap = place[b] - place[a]
    steps = lambda turn: (np.floor(turn / (2 * np.pi) * TURNS) % TURNS).astype(np.uint64)
    where = (np.floor(np.log2(np.abs(gap)) * STEPS).astype(np.uint64) * np.uint64(TURNS) + steps(np.angle(gap) - angle[a])) * np.uint64(TURNS) + steps(angle[b] - angle[a])
    columns = (np.broadcast_to(table.astype(np.uint64), a.shape), parts[a, table], parts[b, (table + OTHER) % PARTS], where)
    return np.unique(_mixed(*[c.ravel() for c in columns])).view(np.int64)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@F.pandas_udf(DESCRIBED)
def _describe_udf(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from hashlib import sha256

    for batch in images:
        rows = []
        for image in batch:
            pixels = decode(image)
            spots, bits = describe(pixels)
            rows.append((None if pixels is None else sha256(repr(pixels.shape).encode() + pixels.tobytes()).digest(), spots.astype(np.float32).tobytes(), bits.tobytes()))
        yield pd.DataFrame(rows, columns=["digest", "spots", "bits"])


@F.pandas_udf(T.BinaryType())
def _render_udf(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in vectors:
        yield pd.Series([render(v) for v in batch], dtype=object)


def rendered(vectors: str | Column) -> Column:
    """Image column of an array column."""
    return _render_udf(vectors)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, node) of the entries of images."""
    for batch in batches:
        keys = [entries(_spots(s), _bits(b)) for s, b in zip(batch["spots"], batch["bits"], strict=True)]
        yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.int64), *keys]), "node": np.repeat(batch["node"].to_numpy(np.int64), [len(k) for k in keys])})


def _spots(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32).reshape(-1, 4).astype(float)


def _bits(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)


def match(group: dict[str, np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which images show the same picture as one of a group."""
    spots, bits = [_spots(s) for s in group["spots"]], [_bits(b) for b in group["bits"]]
    return lambda one, others: np.array([agreeing(spots[one], bits[one], spots[k], bits[k]) >= AGREE for k in others], bool)


def image_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """Classes of images that show the same picture: (image_id, class_id, n_spots), one row per input row.

    class_id is the least image_id that can be reached over links. Images of equal pixels share it. Null, empty and
    other bytes, and images without corners, are linked to nothing but equal pixels; undecodable ones are each a class
    of their own id. Repeated rows are returned each. A null image_id is below all others and shown as null. An empty
    table gives an empty result; other columns are not looked at.
    """
    ship(images.sparkSession)
    lowest = F.lit(-(2**63)).cast("long")
    told = materialize(images.select(F.col(id_col).cast("long").alias("image_id"), _describe_udf(F.col(image_col)).alias("d")).select("image_id", "d.*"), "media")
    reps = materialize(told.where("digest is not null").groupBy("digest").agg(F.min(F.coalesce("image_id", lowest)).alias("rep"), F.first("spots").alias("spots"), F.first("bits").alias("bits")), "media")
    # images of equal pixels are one node, named by their digest, as ids may be null or repeated
    nodes = reps.select(F.xxhash64("digest").alias("node"), "spots", "bits")
    parts = list_classes(nodes.mapInPandas(_listed, "key long, node long"), lambda wanted: nodes.join(wanted, "node"), match)
    own = reps.select("digest", "rep").join(parts, F.xxhash64("digest") == F.col("node"), "left").select("digest", "rep", F.coalesce("component", F.xxhash64("digest")).alias("class"))
    own = materialize(own, "media")
    least = materialize(own.groupBy("class").agg(F.min("rep").alias("component")), "media")
    classes = materialize(own.join(least, "class").select(F.col("digest").alias("d"), "component"), "media")
    out = told.join(classes, F.col("digest") == F.col("d"), "left")
    known = F.coalesce("component", "image_id")
    return out.select("image_id", F.when(known != lowest, known).alias("class_id"), (F.octet_length("spots") / 16).cast("long").alias("n_spots"))

"""Copies among images by local descriptors.

Corners are found at five scales, oriented by their intensity centroid, and described by 128 binary
tests of a smoothed disc that is turned to that orientation. A word is 32 of the bits. A corner and each
of its nearest neighbours give a key a word: that word of both, so that a flat or repeated patch, whose
words many images have, is told apart by what is beside it. A join on keys gives candidate pairs of
images; their descriptors are compared, and pairs of corners DISTANCE or fewer bits apart each give a
rotation, a scale and a shift; where several agree on one, the images show the same thing: one is a crop
or an edited copy of the other. Equal images are one class with one set of descriptors.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, release, table, written

#: From full size down to about half; steps of a fifth or less, so that any size between is near one.
SCALES = (1.0, 0.84, 0.71, 0.59, 0.5)
#: Those of an image that asks: it can be of any size between, and there are few.
FINE = (1.0, 0.92, 0.84, 0.77, 0.71, 0.65, 0.59, 0.54, 0.5)
RADIUS = 15
MARGIN = RADIUS + 2
#: Bits of 128 in which two descriptors of one corner may differ.
DISTANCE = 16
_gap = rb"(?:\s|#[^\n]*\n)+"
PNM = re.compile(rb"P([56])" + _gap + rb"(\d+)" + _gap + rb"(\d+)" + _gap + rb"(\d+)\s")
AGREE = 12
#: Keys that a pair of images must share to be compared, and neighbours of a corner that make its keys.
SHARED = 2
NEIGHBOURS = 2
#: Widths of the cells in which votes meet: of the shift in pixels, of rotation in degrees, of log2 scale.
CELL = (8.0, 30.0, 0.5)
#: Rows of a batch, pixels and corners worked on at once.
STACK, PIXELS, POINTS = 128, 1 << 18, 2048
_grid = np.arange(-RADIUS, RADIUS + 1)
_disc = (_grid[:, None] ** 2 + _grid[None] ** 2 <= RADIUS**2).astype(np.float32)
_random = np.random.default_rng(5)
_spread = _random.normal(0, RADIUS / 2.2, (128, 2, 2))
TESTS = _spread * np.minimum(1, RADIUS / np.maximum(1e-9, np.hypot(_spread[..., :1], _spread[..., 1:])))


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or an 8-bit PNG without interlace; None if it is neither."""
    try:
        if data and (m := PNM.match(data)):
            n, w, h, top = 3 if m[1] == b"6" else 1, *map(int, m.groups()[1:])
            if not 0 < top < 256:  # two bytes a value are not read
                return None
            a = np.frombuffer(data, np.uint8, w * h * n, m.end()).reshape(h, w, n)
            return a.mean(2, dtype=np.float32) * (255 / top) if w and h else None
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error, ZeroDivisionError):
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        packed += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head and head[2] == 8 and not head[6] else None
    if channels is None:
        return None
    w, h = head[:2]
    raw, line = zlib.decompress(packed), w * channels
    out, above = np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(h):
        kind, row = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1).copy()
        if kind == 2:
            row += above
        elif kind:
            for x in range(line):
                a, b, c = (int(row[x - channels]) if x >= channels else 0), int(above[x]), (int(above[x - channels]) if x >= channels else 0)
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[x] = (int(row[x]) + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
        out[y] = above = row
    return out.reshape(h, w, channels)[:, :, : min(channels, 3) if channels != 2 else 1].mean(2, dtype=np.float32)


def encode(a: np.ndarray) -> bytes:
    """A binary PGM."""
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()


def _smooth(a: np.ndarray) -> np.ndarray:
    """A stack of images (n, h, w), smoothed by five binomial weights along both axes."""
    for axis in (1, 2):
        p = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in range(3)], "edge")
        at = lambda k: p[:, k : k + a.shape[1]] if axis == 1 else p[:, :, k : k + a.shape[2]]  # noqa: B023, E731
        a = (at(0) + at(4) + 4 * (at(1) + at(3)) + 6 * at(2)) / 16
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = (max(1, int(n * scale)) for n in a.shape[1:])
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, max(0, a.shape[1] - 2)), np.clip(x.astype(int), 0, max(0, a.shape[2] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[1] - 1), np.minimum(x0 + 1, a.shape[2] - 1)
    fy, fx = np.clip(y - y0, 0, 1).astype(np.float32)[:, None], np.clip(x - x0, 0, 1).astype(np.float32)
    rows = a[:, y0] * (1 - fy) + a[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _peaks(r: np.ndarray, radius: int = 2) -> np.ndarray:
    most = r
    for axis in (1, 2):
        most = np.maximum.reduce([np.roll(most, k, axis) for k in range(-radius, radius + 1)])
    return r >= most


def describe(stack: np.ndarray, scales: tuple[float, ...] = SCALES) -> dict[str, np.ndarray]:
    """All corners at each scale of a stack of images (n, h, w): the image's number, x, y, scale, angle
    and the descriptor's two halves, by image and then by scale."""
    found = []
    for scale in scales:
        s = _smooth(_resized(stack, scale))
        n, h, w = s.shape
        if min(h, w) <= 2 * MARGIN + 2:
            continue
        gy, gx = np.gradient(s, axis=(1, 2))
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        strong = _peaks(r) & (r > 1.0)
        strong[:, :MARGIN] = strong[:, h - MARGIN :] = False
        strong[:, :, :MARGIN] = strong[:, :, w - MARGIN :] = False
        every = np.column_stack(np.nonzero(strong))
        for at in range(0, len(every), POINTS):  # patches of so many corners at once: bounded memory
            i, y, x = every[at : at + POINTS].T
            patch = s[i[:, None, None], y[:, None, None] + _grid[None, :, None], x[:, None, None] + _grid[None, None, :]] * _disc
            angle = np.arctan2((patch * _grid[None, :, None]).sum((1, 2)), (patch * _grid[None, None, :]).sum((1, 2)))
            # the same corner turned a little must give the same tests: angles are not rounded
            c, sn = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px, py = TESTS[None, :, :, 0], TESTS[None, :, :, 1]
            qx, qy = np.rint(x[:, None, None] + px * c - py * sn).astype(int), np.rint(y[:, None, None] + px * sn + py * c).astype(int)
            v = s[i[:, None, None], qy, qx]
            halves = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view(">u8").astype(np.uint64)
            found.append((i, (x + 0.5) / scale, (y + 0.5) / scale, np.full(len(y), scale), np.degrees(angle), halves[:, 0], halves[:, 1]))
    names = ("image", "x", "y", "scale", "angle", "d0", "d1")
    if not found:
        return {k: np.empty(0, np.int64 if k in ("image", "d0", "d1") else np.float32) for k in names}
    out = dict(zip(names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))
    order = np.lexsort((-out["scale"], out["image"]))
    return {k: v[order] for k, v in out.items()}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def keys(points: dict[str, np.ndarray]) -> np.ndarray:
    """The index keys of one image's corners: for each of the NEIGHBOURS nearest corners of a corner at
    its scale, and each of the four words of 32 bits, that word of both, the greater first."""
    out = []
    for scale in np.unique(points["scale"]):
        mine = np.flatnonzero(points["scale"] == scale)
        x, y = points["x"][mine], points["y"][mine]
        words = np.stack([points[d][mine] >> np.uint64(k) & np.uint64(0xFFFFFFFF) for d in ("d0", "d1") for k in (32, 0)])
        for at in range(0, len(mine), 512):
            far = (x[at : at + 512, None] - x) ** 2 + (y[at : at + 512, None] - y) ** 2
            far[np.arange(far.shape[0]), np.arange(at, at + far.shape[0])] = np.inf
            k = min(NEIGHBOURS, len(mine) - 1)
            near = np.argpartition(far, k - 1, axis=1)[:, :k] if k > 0 else np.empty((far.shape[0], 0), int)
            own, other = words[:, at : at + 512, None], words[:, near]
            both = np.maximum(own, other) << np.uint64(32) | np.minimum(own, other)
            out.append(_mixed(both + np.arange(1, 5, dtype=np.uint64)[:, None, None] * np.uint64(0x9E3779B97F4A7C15)).ravel())
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


POINT = ("x", "y", "scale", "angle", "d0", "d1")
_kinds = [("x", pa.float32()), ("y", pa.float32()), ("scale", pa.float32()), ("angle", pa.float32()), ("d0", pa.int64()), ("d1", pa.int64())]
COLUMNS = "x array<float>, y array<float>, scale array<float>, angle array<float>, d0 array<bigint>, d1 array<bigint>, keys array<bigint>"


def described(images: DataFrame, kind: str, draw: Callable[[object], bytes | None] | None = None, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """Rows (id, digest, x, y, scale, angle, d0, d1, keys) from rows (id, media), arrays with a value for
    each corner: digest is the SHA-256 of the bytes, null where there are none or they cannot be read.
    `draw` turns the second column into bytes where it is not."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STACK):
                b = whole.slice(start, STACK)
                digests: list[str | None] = []
                shapes: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}
                for k, v in enumerate(b.column(1)):
                    data = draw(v.as_py()) if draw else v.as_py()
                    a = decode(data)
                    digests.append(None if a is None else hashlib.sha256(data).hexdigest())
                    if a is not None:
                        shapes.setdefault(a.shape, []).append((k, a))
                of: list[dict | None] = [None] * b.num_rows
                for shape, own in shapes.items():  # images of one shape at once, large ones alone
                    step = max(1, PIXELS // (shape[0] * shape[1]))
                    for at in range(0, len(own), step):
                        part = own[at : at + step]
                        points = describe(np.stack([a for _, a in part]).astype(np.float32), scales)
                        ends = np.searchsorted(points["image"], np.arange(len(part) + 1))
                        for (k, _), low, high in zip(part, ends, ends[1:], strict=False):
                            of[k] = {c: points[c][low:high] for c in POINT}
                empty = {c: np.empty(0, np.uint64 if c in ("d0", "d1") else np.float32) for c in POINT}
                all_ = [x or empty for x in of]
                marks = [keys(x) for x in all_]
                offsets = lambda xs: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]), pa.int32())
                at_points = offsets([x["x"] for x in all_])
                as_kind = lambda v, t: pa.array(np.ascontiguousarray(v).view(np.int64) if t == pa.int64() else v.astype(np.float32), t)
                lists = [pa.ListArray.from_arrays(at_points, as_kind(np.concatenate([x[c] for x in all_]), t)) for c, t in _kinds]
                lists.append(pa.ListArray.from_arrays(offsets(marks), as_kind(np.concatenate(marks), pa.int64())))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), *lists], ["id", "digest", *POINT, "keys"])

    return images.mapInArrow(run, f"id {kind}, digest string, {COLUMNS}")


def agreement(q: dict[str, np.ndarray], i: dict[str, np.ndarray]) -> int:
    """How many corners of q have a partner in i, DISTANCE or fewer bits apart, that agrees with the
    others on one rotation, scale and shift."""
    pairs = []
    for at in range(0, len(q["d0"]), 256):
        apart = np.bitwise_count(q["d0"][at : at + 256, None] ^ i["d0"]) + np.bitwise_count(q["d1"][at : at + 256, None] ^ i["d1"])
        a, b = np.nonzero(apart <= DISTANCE)
        pairs.append((a + at, b))
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 2
    if not len(a):
        return 0
    turn = (i["angle"][b] - q["angle"][a]) % 360
    grow = q["scale"][a] / i["scale"][b]
    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    tx = i["x"][b] - grow * (c * q["x"][a] - s * q["y"][a])
    ty = i["y"][b] - grow * (s * q["x"][a] + c * q["y"][a])
    # each match votes in the two nearest cells of every axis, so that no border parts a group
    cells = []
    size = np.log2(grow) / CELL[2]
    for dx in (-0.5, 0.5):
        for dy in (-0.5, 0.5):
            for dt in (-0.5, 0.5):
                for dg in (-0.5, 0.5):
                    cells.append(np.column_stack([np.floor(tx / CELL[0] + dx), np.floor(ty / CELL[0] + dy), np.floor(turn / CELL[1] + dt) % (360 / CELL[1]), np.floor(size + dg), a]))
    votes = np.unique(np.concatenate(cells).astype(np.int64), axis=0)
    return int(np.unique(votes[:, :4], axis=0, return_counts=True)[1].max())


def _values(x: pa.ListScalar) -> np.ndarray:
    v = x.values.to_numpy(zero_copy_only=False)
    return v.view(np.uint64) if v.dtype == np.int64 else v


def matches(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (query, image, agree) from rows (id, x, ..., keys), distinct by id: how many matched corners
    agree on one rotation, scale and shift; pairs with fewer than AGREE are left out.

    Pairs of images that share SHARED keys are candidates; what a pair shares is counted before it is
    shuffled by pair. Both sides' corners are then brought to each candidate and compared."""
    kind = queries.schema["id"].dataType.simpleString()
    q, i = (d.select(F.col("id").alias(n), F.explode("keys").alias("key")) for d, n in ((queries, "q"), (images, "i")))
    near = written(q.join(i, "key").groupBy("q", "i").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("q", "i"), "candidates")
    own = queries.select(F.col("id").alias("q"), *[F.col(c).alias(f"q_{c}") for c in POINT])
    other = images.select(F.col("id").alias("i"), *[F.col(c).alias(f"i_{c}") for c in POINT])
    both = near.join(own, "q").join(other, "i").select("q", "i", *[f"q_{c}" for c in POINT], *[f"i_{c}" for c in POINT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k) for k in range(2, 2 + 2 * len(POINT))]
            sides = [[_values(c[k]) for c in columns] for k in range(b.num_rows)]
            agree = [agreement(dict(zip(POINT, x[: len(POINT)], strict=True)), dict(zip(POINT, x[len(POINT) :], strict=True))) for x in sides]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(agree, pa.int64())], ["query", "image", "agree"])

    return both.mapInArrow(run, f"query {kind}, image {kind}, agree bigint").where(F.col("agree") >= AGREE)


def drawn(vector: list[float] | None, side: int = 96) -> bytes | None:
    """A picture of a vector: its values as grey squares, eight in a row. The tables have no image
    column; this gives them one whose content follows the row."""
    if not vector:
        return None
    v = np.asarray(vector, np.float32)
    v = np.nan_to_num((v - v.mean()) / (v.std() + 1e-9))
    rows = -(-len(v) // 8)
    cells = np.zeros(rows * 8, np.float32)
    cells[: len(v)] = v
    a = np.kron(cells.reshape(rows, 8), np.ones((max(1, side // rows), side // 8), np.float32))
    return encode(127 + 60 * a)


def edited(data: bytes | None, turn: bool) -> bytes | None:
    """A copy that is cropped, darker and flatter, and perhaps turned by a right angle."""
    a = decode(data)
    if a is None:
        return None
    h, w = a.shape
    part = 18 + 0.8 * a[h // 10 : h - h // 12, w // 12 : w - w // 10]
    return encode(np.rot90(part) if turn else part)


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pictures; each vec_id that 50 divides asks, with an edited copy, for its source.

    One row a vec_id: class_id is the smallest vec_id with an equal picture (its own where there is
    none to draw); for those that ask, n_links is the number of classes whose picture agrees with the
    edited copy, found_id the class with the most agreement (ties: the smallest), agree that number.
    Rows of one class ask as one. Other rows have nulls there. Null and empty vectors have no picture
    and link to nothing; an empty table gives no rows; repeated rows come out as often as they stand.
    """
    rows = own_columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    kind = rows.schema["vec_id"].dataType.simpleString()
    all_ = written(described(rows, kind, drawn), "described")
    classes = written(all_.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"), F.max(F.col("id") % 50 == 0).alias("asks")), "classes")
    images = all_.join(classes.select(F.col("class_id").alias("id")), "id", "left_semi").drop("digest").dropDuplicates(["id"])
    asking = rows.join(classes.where("asks").select(F.col("class_id").alias("vec_id")), "vec_id", "left_semi").dropDuplicates(["vec_id"])

    def draw(v: list[float] | None) -> bytes | None:
        data = drawn(v)
        return edited(data, zlib.crc32(data or b"") % 2 == 1)

    edits = written(described(asking, kind, draw, FINE).drop("digest"), "edits")
    found = written(matches(edits, images), "matches")
    release(spark)
    best = found.groupBy(F.col("query").alias("class_id")).agg(F.count("*").alias("n_links"), F.max(F.struct("agree", (-F.col("image")).alias("least"))).alias("b"))
    best = best.select("class_id", "n_links", (-F.col("b.least")).alias("found_id"), F.col("b.agree").alias("agree"))
    of_class = classes.join(best, "class_id", "left").select("digest", "class_id", "n_links", "found_id", "agree")
    ask = F.col("id") % 50 == 0
    return all_.select("id", "digest").join(of_class, "digest", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"),
        F.when(ask, F.coalesce("n_links", F.lit(0))).alias("n_links"), F.when(ask, F.col("found_id")).alias("found_id"), F.when(ask, F.col("agree")).alias("agree"),
    )

"""Operator 8: cropped or edited copies of images by local descriptors, Hamming tables and geometric consensus."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_written, slices, written

#: Corners that describe an image at each scale, the strongest ones; scales shrink by this factor down to this least side.
CORNERS, SHRINK, LEAST_SIDE = 40, 1.25, 30
#: Half a patch's side; pairs of points whose brightness is compared; bits of a Hamming table's key.
RADIUS, TESTS, KEY_BITS = 9, 256, 32
#: Pixels whose corners are sought at once, over several images of one shape.
STACK = 1 << 18
#: Keypoints that an image's are compared with at once; pairs of keypoints and pairs of matches that are counted at once, which stay in a core's cache.
WIDTH, CACHED, MATCHES = 4096, 1 << 16, 1 << 13
#: Images of a block, and bytes of their keypoints; blocks that a task holds at once. Every two blocks meet.
SMALL, BLOCK_BYTES, BLOCKS = 256, 8 << 20, 64
#: Most differing bits of a match; least matches that agree on one similarity transform, in pixels of the coarser point.
MOST_BITS, LEAST_AGREEING, TOLERANCE = 60, 10, 3.5

_rng = np.random.default_rng(8)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2, (TESTS, 4)), -RADIUS * 0.7, RADIUS * 0.7)
_DISC = [(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS]
#: A keypoint: place in the full image, scale, angle, and its 256 bits.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "<u8", 4)])


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head, palette = 8, b"", None, None
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    way, given = rows[:, 0], rows[:, 1:].reshape(height, width, channels).astype(np.int32)
    # a pixel needs its left, upper and upper left neighbours: along diagonals, all rows at once; the margins are the zeros before the first ones
    out = np.zeros((height + 1, width + 1, channels), np.int32)
    for t in range(height + width - 1):
        i = np.arange(max(0, t - width + 1), min(height, t + 1))
        c = t - i
        a, b, d = out[i + 1, c], out[i, c + 1], out[i, c]
        e = a + b - d
        da, db, dd = abs(e - a), abs(e - b), abs(e - d)
        nearest = np.where((da <= db) & (da <= dd), a, np.where(db <= dd, b, d))
        guess = np.choose(way[i][:, None], [np.zeros_like(a), a, b, (a + b) // 2, nearest])
        out[i + 1, c + 1] = given[i, c] + guess & 255
    out = out[1:, 1:].astype(np.uint8)
    return palette[out[:, :, 0]] if palette is not None and head[3] == 3 else out


def _portable(raw: bytes) -> np.ndarray | None:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    (width, height, most), channels = fields, 1 if raw[:2] == b"P5" else 3
    if most > 255:
        return None
    return np.frombuffer(raw, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)


#: First bytes of formats that are known but not read.
OTHER_FORMATS = {b"\xff\xd8\xff": "JPEG", b"GIF8": "GIF", b"RIFF": "WebP", b"BM": "BMP", b"II*\0": "TIFF", b"MM\0*": "TIFF"}


def grey(raw: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(brightness from 0 to 1, None) of an 8-bit PNG (not interlaced), PGM or PPM; (None, what is wrong) of anything else."""
    if not raw:
        return None, "no image"
    try:
        image = _png(raw) if raw[:8] == b"\x89PNG\r\n\x1a\n" else _portable(raw) if raw[:2] in (b"P5", b"P6") else None
    except (ValueError, IndexError, struct.error, zlib.error):
        return None, "damaged"
    if image is None or not image.size:
        return None, next((f"{name} is not read" for start, name in OTHER_FORMATS.items() if raw.startswith(start)), "not an 8-bit PNG, PGM or PPM")
    color = image.astype(np.float32) / 255
    return (color[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32) if color.shape[2] >= 3 else color[:, :, 0]), None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1 of the last two axes, edges repeated."""
    n = 2 * r + 1
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(r + 1, r), (r + 1, r)], "edge").cumsum(-2).cumsum(-1)
    return (p[..., n:, n:] - p[..., :-n, n:] - p[..., n:, :-n] + p[..., :-n, :-n]) / (n * n)


def _resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    y, z = (np.arange(height) + 0.5) * x.shape[-2] / height - 0.5, (np.arange(width) + 0.5) * x.shape[-1] / width - 0.5
    y, z = y.clip(0, x.shape[-2] - 1), z.clip(0, x.shape[-1] - 1)
    i, j = y.astype(int).clip(max=max(0, x.shape[-2] - 2)), z.astype(int).clip(max=max(0, x.shape[-1] - 2))
    a, b = (y - i)[:, None], (z - j)[None, :]
    k, m = np.minimum(i + 1, x.shape[-2] - 1), np.minimum(j + 1, x.shape[-1] - 1)
    up, down = x[..., i, :], x[..., k, :]
    return (up[..., j] * (1 - b) + up[..., m] * b) * (1 - a) + (down[..., j] * (1 - b) + down[..., m] * b) * a


def _largest(x: np.ndarray, r: int) -> np.ndarray:
    """The greatest value within r rows and columns of the last two axes; values at the margin are of no use."""
    for axis in (-2, -1):
        out = x
        for d in range(1, r + 1):
            out = np.maximum(out, np.maximum(np.roll(x, d, axis), np.roll(x, -d, axis)))
        x = out
    return x


def keypoints(images: np.ndarray) -> list[np.ndarray]:
    """Of each image in a stack of one shape: its corners at several scales, each with an orientation and 256 binary tests turned by it."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    scale, height, width = 1.0, *images.shape[1:]
    while min(height, width) >= scale * LEAST_SIDE:
        x = images if scale == 1 else _resized(_box(images, int(scale / 2)) if scale >= 2 else images, round(height / scale), round(width / scale))
        smooth = _box(_box(x.astype(np.float64), 1), 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = (a + b) / 2 - np.sqrt(((a - b) / 2) ** 2 + c * c)  # the weaker of two directions
        m = RADIUS + 1
        inner = np.zeros(x.shape, bool)
        inner[:, m:-m, m:-m] = True
        at, y, z = np.nonzero(inner & (response == _largest(response, 2)) & (response > 1e-5))
        order = np.lexsort((z, y, -response[at, y, z], at))
        at, y, z = at[order], y[order], z[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, y, z = at[rank < CORNERS], y[rank < CORNERS], z[rank < CORNERS]
        if len(at):
            dy, dx = np.array(_DISC).T
            patch = smooth[at[:, None], y[:, None] + dy, z[:, None] + dx]
            angle = np.arctan2(patch @ dy, patch @ dx)
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

            def value(px: np.ndarray, py: np.ndarray) -> np.ndarray:
                return smooth[at[:, None], np.rint(y[:, None] + sin * px + cos * py).astype(int), np.rint(z[:, None] + cos * px - sin * py).astype(int)]  # noqa: B023

            bits = value(_PAIRS[:, 0], _PAIRS[:, 1]) < value(_PAIRS[:, 2], _PAIRS[:, 3])
            out = np.zeros(len(at), POINT)
            out["x"], out["y"], out["scale"], out["angle"] = (z + 0.5) * scale, (y + 0.5) * scale, scale, angle
            out["bits"] = np.packbits(bits, axis=1).view("<u8")
            for k, lo, hi in zip(range(len(images)), *(np.searchsorted(at, np.arange(len(images)), side).tolist() for side in ("left", "right"))):
                found[k].append(out[lo:hi])
        scale *= SHRINK
    return [np.concatenate(f) if f else np.zeros(0, POINT) for f in found]


def described(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """Keypoints of each image (none of a missing one), images of one shape together."""
    out = [np.zeros(0, POINT)] * len(images)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(images):
        if x is not None:
            shapes.setdefault(x.shape, []).append(i)
    for (height, width), at in shapes.items():
        step = max(1, STACK // (height * width))
        for k in range(0, len(at), step):
            for i, points in zip(at[k : k + step], keypoints(np.stack([images[i] for i in at[k : k + step]]))):
                out[i] = points
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many matches of two images' keypoints agree on one similarity transform."""
    return int(agreements(a, [b], np.array([False]))[0])


def agreements(a: np.ndarray, many: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """agreements_of() of images whose keypoints are given one by one."""
    lengths = np.array([len(b) for b in many], int)
    return agreements_of(a, np.concatenate([a[:0], *many]), np.cumsum(lengths) - lengths, lengths, first)


def agreements_of(a: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, least: int = 0) -> np.ndarray:
    """How many matches of a's keypoints with each other image's agree on one similarity transform: each match proposes one, the best counts.

    The other images' keypoints are so many of points from their starts. A match is two keypoints that are each other's likest, the first
    among equals. Transforms lead from a to the other image, or to a where `first` says that the other one comes first. Images
    are compared many at a time, those of about one length together, up to WIDTH of their keypoints. A count that a cheaper bound
    shows to be below `least` is not taken: 0 then.
    """
    out = np.zeros(len(lengths), int)
    order = np.argsort(lengths, kind="stable")
    end, none = len(order), int((lengths == 0).sum()) if len(a) else len(order)
    while end > none:
        k = order[max(none, end - max(1, WIDTH // int(lengths[order[end - 1]]))) : end]
        out[k] = _agreements(a, points, starts[k], lengths[k], first[k], least)
        end -= len(k)
    return out


def _plain(points: np.ndarray) -> np.ndarray:
    """Keypoints as rows of six 64-bit numbers, the last four their bits: copied faster than records."""
    return np.ascontiguousarray(points).view("<u8").reshape(-1, POINT.itemsize // 8)


def _agreements(a: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """agreements_of() of images whose lengths don't fall. Their bits lie by place, then by image, so that reductions run along images."""
    rows, places, images = len(a), int(lengths[-1]), len(lengths)
    ends = np.cumsum(lengths)
    owner, place = np.repeat(np.arange(images), lengths), np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    a, b = _plain(a), _plain(points)[starts[owner] + place]
    theirs = np.zeros((TESTS // 64, places, images), np.uint64)
    theirs[:, place, owner] = b[:, 2:].T
    # distance and place in one number, so that the least one is the first among equals
    kind, shift = (np.uint16, 7) if max(rows, places) <= 1 << 7 else (np.uint32, 22)
    keys = np.empty((rows, places, images), kind)
    mine, step = np.ascontiguousarray(a[:, 2:].T), max(1, CACHED // (places * images))
    for r in range(0, rows, step):
        apart = np.zeros(keys[r : r + step].shape, np.uint8)
        differ, n_differ = np.empty(apart.shape, np.uint64), np.empty(apart.shape, np.uint8)
        for x, y in zip(mine[:-1], theirs):  # up to 192 fit in a byte
            apart += np.bitwise_count(np.bitwise_xor(x[r : r + step, None, None], y[None], out=differ), out=n_differ)
        np.bitwise_count(np.bitwise_xor(mine[-1][r : r + step, None, None], theirs[-1][None], out=differ), out=n_differ)
        np.add(apart, n_differ, out=keys[r : r + step], dtype=kind)
    keys <<= shift
    back = (keys | np.arange(rows, dtype=kind)[:, None, None]).min(0)
    # where an image has no more keypoints, the greatest number
    keys |= np.where(np.arange(places)[:, None] < lengths, np.arange(places)[:, None], np.iinfo(kind).max).astype(kind)
    best = keys.min(1).T
    image, row = np.nonzero(best >> shift <= MOST_BITS)
    place = (best & (1 << shift) - 1)[image, row]
    mutual = (back & (1 << shift) - 1)[place, image] == row
    image, row, place = image[mutual], row[mutual], place[mutual]
    n = np.bincount(image, minlength=images)
    begin = np.cumsum(n) - n
    p, q = a[:, :2].copy().view("<f4")[row], b[:, :2].copy().view("<f4")[(ends - lengths)[image] + place]
    swap = first[image][:, None]
    p, q = (np.ascontiguousarray(np.where(s, q, p).T) for s in (swap, ~swap))
    out = np.where(n >= LEAST_AGREEING, n, 0)
    for ask in (_at_most, _consensus) if least else (_consensus,):
        some = np.flatnonzero(out >= max(least, 1))
        some, out = some[np.argsort(n[some], kind="stable")], np.zeros(images, int)
        end = len(some)
        while end:
            k = some[max(0, end - max(1, MATCHES // int(n[some[end - 1]]) ** 2)) : end]
            # an image's matches in a column, filled up to the longest one's number
            at = np.arange(n[k].max())[:, None]
            real = at < n[k]
            at = begin[k] + np.where(real, at, 0)
            out[k] = ask(p[:, at], q[:, at], real)
            end -= len(k)
    return out


def _at_most(a: np.ndarray, b: np.ndarray, real: np.ndarray) -> np.ndarray:
    """No less than _consensus() of the same, in single precision: squared tolerances are wider by more than its rounding.

    (t + u)^2 is at most 1.4 t^2 + 3.5 u^2, whatever t and u are: that needs no root.
    """
    (px, py, p_scale, p_angle), (qx, qy, q_scale, q_angle) = a, b
    px = np.where(real, px, np.float32(np.nan))  # agrees with nothing
    size, turn = q_scale / p_scale, q_angle - p_angle
    c, s = (size * np.cos(turn))[None], (size * np.sin(turn))[None]
    dx, dy = px[:, None] - px[None], py[:, None] - py[None]
    x, y = qx[:, None] - qx[None], qy[:, None] - qy[None]
    part = c * dx
    x -= part
    x += np.multiply(s, dy, out=part)
    x *= x
    y -= np.multiply(s, dx, out=part)
    y -= np.multiply(c, dy, out=part)
    y *= y
    x += y
    dx *= dx
    dy *= dy
    dx += dy
    dx *= np.float32(1.05 * 3.5 * 0.05**2)
    dx += (np.float32(1.05 * 1.4 * TOLERANCE**2) * np.maximum(q_scale, np.float32(1)) ** 2)[:, None]
    return (x <= dx).sum(0, dtype=np.uint16).max(0)


def _consensus(a: np.ndarray, b: np.ndarray, real: np.ndarray) -> np.ndarray:
    """a, b: x, y, scale and angle of each image's matches in a column, those that are real; the most that agree on what one of them proposes."""
    (px, py, p_scale, p_angle), (qx, qy, q_scale, q_angle) = a, b
    size, turn = (q_scale / p_scale).astype(float), (q_angle - p_angle).astype(float)
    c, s = (size * np.cos(turn))[None], (size * np.sin(turn))[None]
    # where each proposal (column) sends each match's first point (row)
    dx, dy = px[:, None] - px[None], py[:, None] - py[None]
    x, y = qx[:, None] - qx[None], qy[:, None] - qy[None]
    x, y = x - (c * dx - s * dy), y - (s * dx + c * dy)
    near = (TOLERANCE * np.maximum(q_scale, 1))[:, None] + 0.05 * np.sqrt(dx * dx + dy * dy)
    return ((x * x + y * y <= near * near) & real[:, None] & real[None]).sum(0).max(0)


def describe(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(id, points, problem): each image's keypoints in one binary, or why it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            read = [grey(x) for x in b.column(1).to_pylist()]
            points = [p.tobytes() for p in described([x for x, _ in read])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(points, pa.binary()), pa.array([p for _, p in read], pa.string())], names=["id", "points", "problem"])

    return images.select(images[id_col].cast("long").alias("id"), images[image_col].alias("image")).mapInArrow(run, "id long, points binary, problem string")


def _blocks(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, counts, points) of up to `most` images, by id: their ids, numbers of keypoints and keypoints, each in one binary; block is the smallest id."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def block() -> pa.RecordBatch:
        held.sort()
        ids = np.array([i for i, _ in held], np.int64)
        counts = np.array([len(p) // POINT.itemsize for _, p in held], np.int64)
        columns = [pa.array(ids[:1]), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), counts.tobytes(), b"".join(p for _, p in held)))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "counts", "points"])

    for b in slices(batches):
        for i, points in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and (len(held) >= most or size + len(points) > BLOCK_BYTES):
                yield block()
                held.clear()
                size = 0
            held.append((i, points))
            size += len(points)
    if held:
        yield block()


class Block:
    """Images with their keypoints one after another, and which images hold each table's key."""

    def __init__(self, ids: bytes, counts: bytes, points: bytes):
        self.ids, self.counts, self.points = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64), np.frombuffer(points, POINT)
        self.starts = np.cumsum(self.counts) - self.counts
        keys = self.points["bits"].copy().view("<u4").astype(np.int64) | np.arange(TESTS // KEY_BITS, dtype=np.int64)[None, :] << KEY_BITS
        owner = np.repeat(np.arange(len(self.ids)), self.counts * (TESTS // KEY_BITS))
        order = np.lexsort((owner, keys.ravel()))
        keys, owner = keys.ravel()[order], owner[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))  # a key counts once an image
        self.keys, self.owner = keys[new], owner[new]
        by_image = np.argsort(self.owner, kind="stable")
        self.own = np.split(self.keys[by_image], np.cumsum(np.bincount(self.owner, minlength=len(self.ids)))[:-1])

    def of(self, k: int) -> np.ndarray:
        return self.points[self.starts[k] : self.starts[k] + self.counts[k]]

    def in_common(self, keys: np.ndarray) -> np.ndarray:
        """How many of the keys each image holds."""
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        return np.bincount(self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(self.ids))


def links_between(x: Block, y: Block, least_keys: int) -> list[tuple[int, int]]:
    """Links that join what all verified pairs of x's images with y's (x itself: among them) join; pairs already joined by these are not verified."""
    same = x is y
    left = np.arange(len(x.ids))
    right = left if same else len(x.ids) + np.arange(len(y.ids))
    component = np.arange(len(x.ids) if same else len(x.ids) + len(y.ids))
    out = []
    for i in range(len(x.ids)):
        n = y.in_common(x.own[i])
        if same:
            n[: i + 1] = 0
        others = np.flatnonzero((n >= least_keys) & (component[right] != component[left[i]]))
        # the likeliest of each component first, then twice as many a round: what they join needs no further look
        others, each = others[np.argsort(-n[others], kind="stable")], 1
        while len(others):
            by = np.argsort(component[right[others]], kind="stable")
            sorted_ = component[right[others[by]]]
            now = np.zeros(len(others), bool)
            now[by] = np.arange(len(by)) - np.searchsorted(sorted_, sorted_) < each
            tried = others[now]
            linked = tried[agreements_of(x.of(i), y.points, y.starts[tried], y.counts[tried], y.ids[tried] <= x.ids[i], LEAST_AGREEING) >= LEAST_AGREEING]
            for j in linked.tolist():
                if component[right[j]] != component[left[i]]:
                    out.append((int(min(x.ids[i], y.ids[j])), int(max(x.ids[i], y.ids[j]))))
                    component[component == component[right[j]]] = component[left[i]]
            others, each = others[~now], 2 * each
            others = others[component[right[others]] != component[left[i]]]
    return out


def link_images(images: DataFrame, least_keys: int = 3, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(id_col, n_points, component_id, kept, problem) of every row of images.

    Images with least_keys tables' keys in common are candidates, however many images hold a key; each candidate pair is verified by
    geometric consensus (matches have to agree on one shift, turn and scale) unless links already join it, and verified pairs
    make components: what verifying all candidates gives. Images go into blocks, and every two blocks meet once, without a
    shuffle by keys. So the work grows with the square of the number of distinct images: little for each pair, and a
    verification for each candidate, which are nearly all pairs if descriptors hardly tell images apart.

    Images with equal keypoints are one class. problem says why an image has no keypoints to offer: null images, damaged ones and
    formats that aren't read (JPEG among them) link with nothing, as do images without corners. Null ids get component null and
    are kept; rows that repeat an id are one node. Other columns are not read; ids must be whole numbers; no rows: no rows.
    """
    seen = written(describe(images, id_col, image_col).withColumn("class", F.md5("points")), "points")
    filled = seen.where((F.length("points") > 0) & F.col("id").isNotNull())
    points = filled.groupBy("class").agg(F.min("id").alias("id"), F.min_by("points", "id").alias("points"))
    # rows that repeat an id with other images are one node: two blocks may begin with the same id
    blocks = written(points.select("id", "points").mapInArrow(partial(_blocks, SMALL), "block long, ids binary, counts binary, points binary").withColumn("block", F.xxhash64("block", "points")), "blocks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, Block] | None = None
        for b in slices(batches):
            for r in range(b.num_rows):
                (i, *first), (j, *second) = ([b.column(c)[r].as_py() for c in range(k, k + 4)] for k in (0, 4))
                if known is None or known[0] != i:
                    known = i, Block(*first)
                pairs = [p for p in links_between(known[1], known[1] if i == j else Block(*second), least_keys) if p[0] != p[1]]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    n = blocks.count()
    some = blocks.repartition(max(1, min(n, images.sparkSession.sparkContext.defaultParallelism), -(-n // BLOCKS)))
    other = some.select(*[F.col(c).alias(f"_{c}") for c in blocks.columns])
    # each two blocks once, in either order by turns, so that all tasks get about as many
    once = (F.col("block") == F.col("_block")) | ((F.col("block") < F.col("_block")) == (F.pmod(F.col("block").bitwiseXOR(F.col("_block")), F.lit(2)) == 0))
    met = some.join(other.hint("shuffle_replicate_nl"), once)
    links = written(met.mapInArrow(meet, "a long, b long"), "links")
    drop_written(blocks)
    found = connected_components(links).withColumnRenamed("node", "id")
    about = filled.groupBy("class").agg(F.min("id").alias("id")).join(found, "id", "left").select("class", F.coalesce("component", "id").alias("c"))
    out = seen.join(about, "class", "left")
    known = (F.length("points") > 0) & F.col("id").isNotNull()
    component = F.when(known, F.coalesce("c", "id")).otherwise(F.col("id"))
    n_points = F.coalesce(F.length("points") / POINT.itemsize, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), n_points.alias("n_points"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "problem")


def mosaics(vectors: DataFrame, side: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(image_id, image): a PGM of each vector, its components as tiles of side pixels from dark to bright. Null vectors: null."""

    def draw(v: np.ndarray | None) -> bytes | None:
        if v is None or not len(v) or not np.isfinite(v).all():
            return None
        n = int(np.ceil(len(v) ** 0.5))
        tiles = np.full(n * n, 128.0)
        tiles[: len(v)] = 128 + 127 * np.tanh(v * np.sqrt(len(v)) / 1.5)
        image = np.kron(tiles.reshape(n, n), np.ones((side, side))).round().astype(np.uint8)
        return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = [draw(None if v is None else np.array([np.nan if x is None else x for x in v], float)) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    return vectors.select(vectors[id_col].cast("long"), vectors[vec_col]).mapInArrow(run, "image_id long, image binary")

"""Copies of images by local descriptors: cropped, turned, resized, brightened or noisy copies are found by agreeing keypoints.

Keypoints are corners (local maxima of a structure-tensor response) on a pyramid of LEVELS levels, each smaller by STEP. A keypoint's direction
is that of its patch's centroid; its descriptor is 128 brightness comparisons at interpolated places that turn with the direction, so that it
doesn't change with rotation or brightness.

Search. A descriptor has four parts of 32 bits. Query images go to all tasks in blocks of BLOCK keypoints, as a hash table
of each part; a task asks them for the parts of its own descriptors as they are and with each bit changed, and compares all bits of what it meets:
a pair of descriptors is found if a part differs in one bit at most. Short parts would find more pairs, but corners look alike: parts of 21 bits
meet for 3 in 100 keypoints of unlike images, those of 32 for 15 in 10,000. `exact=True` compares all pairs instead. The index has a row for each image, so that its matches with a query are counted where
they are found, and nothing of the index or of the matches is shuffled.

Consensus. Matches vote for where the query's centre lies, for a scale and a turn, in cells that overlap by half. A copy needs VOTES
keypoints that agree, and VOTE_SHARE of the keypoints of the image that has fewer; they mustn't lie within a patch of each other, as one
corner is a keypoint on several levels. Most matches are of unlike images: those whose pair of images has too few of their scale and turn are
left out before places are looked at, which changes no result.

Equal images are one class, searched and found once; every row of a query class gets the result, and `image_classes` names every row's class. Images are
8-bit grey PGM files in a binary column.

Cases: null, empty or broken images have no keypoints and match nothing, nor do blank ones; rows with equal images share a class (the least id); a row without
an id is in no class; large images are handled whole, their keypoints in groups; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_left, table

STEP, LEVELS = 1.2, 5
PATCH = 8
RESPONSE = 0.05
MOST_BITS = 10
VOTES, VOTE_SHARE = 5, 0.05
PARTS, WIDTH = 4, 32
#: Slots of the hash table of a part, as bits.
SLOTS = 22
TURNS = 24
SHIFT_BIN = 6.0
#: Query keypoints that are sent to all tasks at once, 32 bytes each; index keypoints that are compared at once.
BLOCK, GROUP = 1 << 17, 1 << 13
#: Pixels of images of one size that are handled at once.
PIXELS = 1 << 18

_RNG = np.random.default_rng(20)
_TESTS = np.clip(_RNG.normal(0, PATCH / 2.25, (128, 4)), -PATCH + 1, PATCH - 1)
_SIDE = np.arange(-PATCH + 1, PATCH)
#: Rows and columns of a round patch, from its middle.
_DISC_AT = [v[(_SIDE[:, None] ** 2 + _SIDE**2 <= (PATCH - 1) ** 2 + 1)] for v in np.broadcast_arrays(_SIDE[:, None], _SIDE)]


def read_pgm(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM file."""
    if not raw or raw[:2] != b"P5":
        return None
    parts = raw.split(maxsplit=4)
    try:
        width, height, top = (int(x) for x in parts[1:4])
        body = raw[len(raw) - width * height :]
    except (ValueError, IndexError):
        return None
    if top != 255 or len(body) != width * height or width * height == 0 or len(raw) <= width * height:
        return None
    return np.frombuffer(body, dtype=np.uint8).reshape(height, width)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def _smooth(x: np.ndarray) -> np.ndarray:
    """A 1-2-1 filter along the last two axes."""
    x = np.concatenate([x[..., :1, :], x, x[..., -1:, :]], axis=-2)
    x = x[..., :-2, :] + 2 * x[..., 1:-1, :] + x[..., 2:, :]
    x = np.concatenate([x[..., :1], x, x[..., -1:]], axis=-1)
    return (x[..., :-2] + 2 * x[..., 1:-1] + x[..., 2:]) / 16


def _between(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pixel before, the share of the next one) of places along an axis of n pixels; the edge holds beyond it."""
    at = np.clip(at, 0, n - 1.001)
    first = at.astype(np.int32)
    return first, (at - first).astype(at.dtype)


def sampled(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Grey levels of one image between pixels, by bilinear interpolation."""
    (a, fy), (b, fx) = _between(x.shape[0], rows), _between(x.shape[1], columns)
    flat, at = x.ravel(), a * x.shape[1] + b
    top, below = flat[at], flat[at + x.shape[1]]
    top, below = top + (flat[at + 1] - top) * fx, below + (flat[at + x.shape[1] + 1] - below) * fx
    return top + (below - top) * fy


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (the last two axes) of another size."""
    (a, fy), (b, fx) = (_between(s, (np.arange(n) + 0.5) * (s / n) - 0.5) for n, s in ((height, x.shape[-2]), (width, x.shape[-1])))
    fy, fx = fy.astype(x.dtype)[:, None], fx.astype(x.dtype)
    x = x[..., a, :] * (1 - fy) + x[..., a + 1, :] * fy
    return x[..., b] * (1 - fx) + x[..., b + 1] * fx


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column) of corners, but those whose patch crosses the edge."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = (_smooth(_smooth(v)) for v in (gx * gx, gy * gy, gx * gy))
    r = (a * b - c * c - 0.05 * (a + b) ** 2)[:, PATCH - 1 : 1 - PATCH, PATCH - 1 : 1 - PATCH]
    inner = r[:, 1:-1, 1:-1]
    rows = np.maximum(np.maximum(r[:, :-2], r[:, 1:-1]), r[:, 2:])  # of three rows, then of three columns
    beside = np.maximum(np.maximum(rows[..., :-2], rows[..., 2:]), np.maximum(r[:, :-2, 1:-1], r[:, 2:, 1:-1]))
    image, y, x_ = np.nonzero((inner > beside) & (inner > 0.12))
    strength = inner[image, y, x_]
    # a tenth of the corners may be stamped ones: the strongest of the others sets the scale
    first = np.searchsorted(image, np.arange(x.shape[0] + 1))
    scale = np.array([np.quantile(strength[i:j], 0.9) if j > i else 1.0 for i, j in zip(first, first[1:], strict=False)])
    good = strength > RESPONSE * scale[image]
    return image[good], y[good] + PATCH, x_[good] + PATCH


def keypoints_of(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, (x, y, level, turn) in the image's own pixels and radians, descriptor as two 64-bit numbers) of each keypoint of images of one size."""
    owners, spots, codes = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 4))], [np.zeros((0, 2), dtype=np.uint64)]
    level_images = images.astype(np.float32)
    tests = _TESTS.astype(np.float32)
    for level in range(LEVELS):
        if level:
            level_images = resized(_smooth(level_images), *(max(2, round(n / STEP)) for n in level_images.shape[1:]))
        height, width = level_images.shape[1:]
        if min(height, width) < 2 * PATCH + 3:
            break
        x = _smooth(level_images)
        flat = x.ravel()
        every = _corners(x)
        for k in range(0, every[0].size, GROUP // 8):
            owner, ys, xs = (v[k : k + GROUP // 8] for v in every)
            base = owner * (height * width)
            patch = flat[(base + ys * width + xs)[:, None] + _DISC_AT[0] * width + _DISC_AT[1]]
            turn = np.arctan2(patch @ _DISC_AT[0].astype(np.float32), patch @ _DISC_AT[1].astype(np.float32))
            cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]
            at = []
            for j in (0, 2):
                a, fy = _between(height, ys[:, None].astype(np.float32) + tests[:, j] * sin + tests[:, j + 1] * cos)
                b, fx = _between(width, xs[:, None].astype(np.float32) + tests[:, j] * cos - tests[:, j + 1] * sin)
                place = base[:, None] + a * width + b
                top, below = flat[place], flat[place + width]
                top, below = top + (flat[place + 1] - top) * fx, below + (flat[place + width + 1] - below) * fx
                at.append(top + (below - top) * fy)
            owners.append(owner)
            codes.append(np.packbits(at[0] < at[1], axis=1, bitorder="little").view("<u8"))
            spots.append(np.stack([(xs + 0.5) * (images.shape[2] / width), (ys + 0.5) * (images.shape[1] / height), np.full(xs.size, level), turn], axis=1))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(spots)[order], np.concatenate(codes)[order]


def keypoints(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spots and descriptors of one image."""
    return keypoints_of(image[None])[1:]


#: An image's keypoints: its centre, (x, y, level, turn) of each as 32-bit numbers, descriptors.
IMAGE = "id long, n int, cx float, cy float, spots binary, codes binary"


def described(df: DataFrame) -> DataFrame:
    """IMAGE rows of the images (id, image) that have keypoints."""

    def described_group(ids: list[int], images: np.ndarray) -> pa.RecordBatch:
        owner, spots, codes = keypoints_of(images)
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        some = np.flatnonzero(np.diff(first)).tolist()
        columns = (
            pa.array([ids[i] for i in some], pa.int64()), pa.array(np.diff(first)[some].astype(np.int32)), *(pa.array(np.full(len(some), images.shape[k] / 2, dtype=np.float32)) for k in (2, 1)),
            pa.array([spots[first[i] : first[i + 1]].astype("<f4").tobytes() for i in some], pa.binary()), pa.array([codes[first[i] : first[i + 1]].tobytes() for i in some], pa.binary()),
        )
        return pa.RecordBatch.from_arrays(list(columns), [f.split(" ")[0] for f in IMAGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = read_pgm(raw.as_py())
                if image is None:
                    continue
                ids, images = waiting.setdefault(image.shape, ([], []))
                ids.append(i)
                images.append(image)
                if len(ids) * image.size >= PIXELS:
                    yield described_group(ids, np.stack(images))
                    del waiting[image.shape]
            for ids, images in waiting.values():
                yield described_group(ids, np.stack(images))
            waiting = {}

    return df.mapInArrow(run, IMAGE)


class _Images:
    """IMAGE rows as arrays: id, n and centre by image; owner, spot and code by keypoint."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        self.id, self.n, cx, cy = (rows.column(k).to_numpy() for k in range(4))
        self.centre = np.stack([cx, cy], axis=1).astype(float)
        self.owner = np.repeat(np.arange(self.n.size), self.n)
        self.spots = np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype="<f4").reshape(-1, 4).astype(float)
        self.codes = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype="<u8").reshape(-1, 2)


def _part(codes: np.ndarray, k: int) -> np.ndarray:
    return (codes[:, k // 2] >> np.uint64(WIDTH * (k % 2))) & np.uint64((1 << WIDTH) - 1)


def _sums(numbers: np.ndarray) -> np.ndarray:
    """The exclusive-or of every choice of the numbers."""
    out = np.zeros(1, dtype=np.int64)
    for x in numbers:
        out = np.concatenate([out, out ^ x])
    return out


#: A random number for each bit of a part. The slot of some bits is the exclusive-or of their numbers, so that a changed bit changes all slots alike.
_BIT_SLOTS = np.random.default_rng(21).integers(1, 1 << SLOTS, WIDTH)
_LOW_SLOTS, _HIGH_SLOTS = _sums(_BIT_SLOTS[: WIDTH // 2]), _sums(_BIT_SLOTS[WIDTH // 2 :])


def _slot(bits: np.ndarray) -> np.ndarray:
    bits = bits.astype(np.int64)
    return _LOW_SLOTS[bits & ((1 << WIDTH // 2) - 1)] ^ _HIGH_SLOTS[bits >> WIDTH // 2]


class _Block:
    """Descriptors by the bits of each part."""

    def __init__(self, codes: np.ndarray, exact: bool = False):
        self.codes, self.exact, self.tables = codes, exact, []
        for k in range(0 if exact else PARTS):
            slot = _slot(_part(codes, k))
            starts = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << SLOTS))]).astype(np.int32)
            self.tables.append((np.argsort(slot, kind="stable").astype(np.int32), starts, starts[1:] > starts[:-1]))

    def _met(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (row of codes, row of the block)."""
        if self.exact:
            for k in range(codes.shape[0]):
                yield np.full(self.codes.shape[0], k), np.arange(self.codes.shape[0])
        for k, (order, starts, filled) in enumerate(self.tables):
            own = _slot(_part(codes, k))
            for changed in (0, *_BIT_SLOTS.tolist()):
                slot = own ^ changed
                some = np.flatnonzero(filled[slot])
                slot = slot[some]
                first = starts[slot]
                many = starts[slot + 1] - first
                row = np.repeat(some, many)
                yield row, order[np.repeat(first - np.cumsum(many) + many, many) + np.arange(row.size)]

    def near(self, codes: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of codes, row of the block) that meet and differ in most_bits at most."""
        found = [np.zeros(0, dtype=np.int64)]
        (own, own_rest), (all_, all_rest) = (np.ascontiguousarray(x.T) for x in (codes, self.codes))
        for row, other in self._met(codes):
            differ = np.bitwise_count(own[row] ^ all_[other])
            some = np.flatnonzero(differ <= most_bits)  # most pairs differ in more bits of the first half alone
            row, other, differ = row[some], other[some], differ[some]
            good = differ + np.bitwise_count(own_rest[row] ^ all_rest[other]) <= most_bits
            found.append(row[good] * np.int64(self.codes.shape[0]) + other[good])
        return np.divmod(np.unique(np.concatenate(found)), max(1, self.codes.shape[0]))


def _agreeing(pair: np.ndarray, need: np.ndarray, levels: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The matches that share their pair of images, scale and turn, as cells of the consensus have them, with as many as the pair needs: others are in no cell
    that counts, wherever they place the centre."""
    keys = [((pair * (2 * LEVELS) + levels + up + LEVELS - 1) * 2 + half) * TURNS + np.floor(part + half / 2).astype(np.int64) % TURNS for up in (0, 1) for half in (0, 1)]
    _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return np.flatnonzero((count[back].reshape(len(keys), -1) >= need).any(axis=0))


def consensus(queries: _Images, images: _Images, q: np.ndarray, t: np.ndarray, votes: int = VOTES, share: float = VOTE_SHARE) -> tuple[np.ndarray, ...]:
    """(query, image, votes, dx, dy), by place, of pairs of images with enough matches that agree on the place of the query's centre, the scale and the
    turn; q and t are the keypoints of each match."""
    pair = images.owner[t].astype(np.int64) * max(1, queries.n.size) + queries.owner[q]
    _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
    need = votes + share * np.minimum(images.n[images.owner[t]], queries.n[queries.owner[q]])
    some = count[back] >= need
    q, t, pair, need = q[some], t[some], pair[some], need[some]
    a, b = queries.spots[q], images.spots[t]
    levels, turn = (b[:, 2] - a[:, 2]).astype(np.int64), b[:, 3] - a[:, 3]
    some = _agreeing(pair, need, levels, turn / (2 * np.pi) % 1 * TURNS)
    q, t, pair, a, b, levels, turn = (v[some] for v in (q, t, pair, a, b, levels, turn))
    centre = queries.centre[queries.owner[q]]
    (ux, uy), cos, sin, scale = (centre - a[:, :2]).T, np.cos(turn), np.sin(turn), STEP**levels
    at = np.stack([b[:, 0] + scale * (ux * cos - uy * sin), b[:, 1] + scale * (ux * sin + uy * cos)])
    part = turn / (2 * np.pi) % 1 * TURNS
    # each match votes for the cells around its own values, so that no cell's edge parts those who agree
    cells = []
    for up, half, sx, sy in ((u, h, x, y) for u in (0, 1) for h in (0, 1) for x in (0, 1) for y in (0, 1)):
        turns = np.floor(part + half / 2).astype(np.int64) % TURNS
        places = [np.floor(v / SHIFT_BIN + s / 2).astype(np.int64) for v, s in zip(at, (sx, sy), strict=True)]
        cells.append(np.stack([pair, levels + up, turns * 8 + half * 4 + sx * 2 + sy, *places], axis=1))
    if not pair.size:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, float, float))
    every = np.concatenate(cells)
    match = np.tile(np.arange(pair.size), len(cells))
    order = np.lexsort((q[match], *every.T[::-1]))  # by cell, then by keypoint of the query
    every, match = every[order], match[order]
    head = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
    fresh = head | np.concatenate([[True], q[match[1:]] != q[match[:-1]]])
    first = np.flatnonzero(head)
    number = np.add.reduceat(fresh.astype(np.int64), first)
    size = np.diff(np.append(first, match.size))
    spread = sum(np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) for v in a[match, :2].T)
    image, query = np.divmod(every[first, 0], queries.n.size)
    least = np.minimum(images.n[image], queries.n[query])
    good = np.flatnonzero((number >= votes + share * least) & (spread >= 2 * PATCH))
    moved = [np.add.reduceat((v - c)[match], first) / size for v, c in zip(at, centre.T, strict=True)]
    best = good[np.lexsort((first[good], -number[good], every[first[good], 0]))]
    best = best[np.concatenate([[True], every[first[best[1:]], 0] != every[first[best[:-1]], 0]])] if best.size else best
    return query[best], image[best], number[best], moved[0][best], moved[1][best]


def found_in(index: DataFrame, block: DataFrame, most_bits: int = MOST_BITS, votes: int = VOTES, share: float = VOTE_SHARE, exact: bool = False) -> DataFrame:
    """(query, image, votes, dx, dy) of a block of queries (of bounded size) and all images of the index."""
    shipped = index.sparkSession.sparkContext.broadcast(block.toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = near = None
        for batch in batches:
            if near is None:
                queries = _Images(shipped.value)
                near = _Block(queries.codes, exact)
            upto = np.cumsum(batch.column(1).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GROUP, side="right")))
                images = _Images(batch.slice(at, to - at))
                own, other = near.near(images.codes, most_bits)
                query, image, *rest = consensus(queries, images, other, own, votes, share)
                yield pa.RecordBatch.from_pydict({"query": pa.array(queries.id[query]), "image": pa.array(images.id[image]), **{k: pa.array(v) for k, v in zip(("votes", "dx", "dy"), rest, strict=True)}})
                at = to

    return index.mapInArrow(run, "query long, image long, votes long, dx double, dy double")


def search(scratch: Scratch, index: DataFrame, queries: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """(query, image, votes, dx, dy) of queries and images (both IMAGE tables) whose keypoints agree; queries are dealt into blocks by hash."""
    blocks = max(1, -(-(queries.agg(F.sum("n")).first()[0] or 0) // block))
    of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = None
    for k in range(blocks):
        part = scratch.keep(found_in(index, queries.filter(of == k), **how), f"found-{k}")
        found = part if found is None else found.unionByName(part)
    return found


def image_classes(scratch: Scratch, images: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, class) of all rows, and (id, image) of one row of each class. Classes are found by digests alone, images stay where they are."""
    keyed = images.withColumn("digest", F.sha2("image", 256))
    rows = scratch.keep(keyed.select("id", "digest"), f"{name}-digests")
    repeated = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("class"), F.count("*").alias("rows")).filter("rows > 1")
    repeated = scratch.keep(repeated, f"{name}-repeated")
    members = join_left(rows, repeated, ["digest"], "rows").select("id", F.coalesce("class", "id").alias("class"))
    ones = join_left(keyed, repeated, ["digest"], "rows").filter("id IS NOT NULL AND digest IS NOT NULL AND (class IS NULL OR class = id)").select("id", "image")
    return members, ones


def image_copies(images: DataFrame, queries: DataFrame, exact: bool = False) -> DataFrame:
    """(role, id, class_id, votes, dx, dy). Rows of the role `match` name, for every row of queries, a class of images that it is a copy of (null, once, if
    there is none), and how far its centre moved; rows of the role `member` name the class of every row of images. Both inputs are (id, image)."""
    scratch = Scratch(images.sparkSession, "images")
    members, ones = image_classes(scratch, images, "index")
    rows, asked = image_classes(scratch, queries, "query")
    found = search(scratch, scratch.keep(described(ones), "index"), scratch.keep(described(asked), "queries"), exact=exact)
    matched = rows.select("id", F.col("class").alias("query")).join(found, "query", "left")
    matched = matched.select(F.lit("match").alias("role"), "id", F.col("image").alias("class_id"), "votes", F.round("dx", 2).alias("dx"), F.round("dy", 2).alias("dy"))
    return matched.unionByName(members.select(F.lit("member").alias("role"), "id", F.col("class").alias("class_id")), allowMissingColumns=True)


def painted(seed: bytes, side: int = 64) -> np.ndarray:
    """A picture of clouds and rectangles that follows from bytes: the images of tables that have none."""
    rng = np.random.default_rng(np.frombuffer(seed, dtype=np.uint8))
    out = np.full((side, side), 128.0)
    for cells, depth in ((6, 25), (12, 35), (20, 45)):
        out += resized(rng.normal(0, depth, (cells + 1, cells + 1)), side, side)
    for _ in range(6):
        x, y = rng.integers(0, side - 6, 2)
        w, h = rng.integers(6, side // 2, 2)
        out[y : y + h, x : x + w] += rng.integers(-60, 61)
    return np.clip(_smooth(out), 0, 255)


def turned(image: np.ndarray, angle: float) -> np.ndarray:
    """An image turned about its centre, in a frame of the same size; what comes into the frame is black."""
    height, width = image.shape
    v, u = np.mgrid[:height, :width] - np.array([(height - 1) / 2, (width - 1) / 2])[:, None, None]
    rows, columns = (height - 1) / 2 - u * np.sin(angle) + v * np.cos(angle), (width - 1) / 2 + u * np.cos(angle) + v * np.sin(angle)
    inside = (rows >= 0) & (rows <= height - 1) & (columns >= 0) & (columns <= width - 1)
    return np.where(inside, sampled(image.astype(float), rows, columns), 0)


def edited(image: np.ndarray, kind: int = 0) -> np.ndarray:
    """A copy that is cropped and darker, turned, smaller, larger, noisy, or half as wide and high: the kind modulo 6."""
    image = image.astype(float)
    if kind % 6 == 1:
        image = turned(image, kind * 0.1)
    elif kind % 6 in (2, 3):
        image = resized(_smooth(image), *(round(n * (0.75, 1.4)[kind % 6 - 2]) for n in image.shape))
    elif kind % 6 == 4:
        image = image + np.random.default_rng(kind).normal(0, 10, image.shape)
    elif kind % 6 == 5:
        image = image[image.shape[0] // 4 : -(image.shape[0] // 4), image.shape[1] // 4 : -(image.shape[1] // 4)]
    else:
        image = image[6:-5, 4:-7] * 0.8 + 10
    return np.clip(np.rint(image), 0, 255)


def painted_images(df: DataFrame, id_col: str, seed_col: str, edit: bool = False) -> DataFrame:
    """(id, image) of rows, painted from their values; with `edit` copies of these, edited in the way of their first value's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seed in batch.column(1).to_pylist():
                raw = np.asarray([0.0 if v is None else v for v in seed], dtype="<f4").tobytes() if seed else b""
                image = painted(raw) if raw else None
                out.append(None if image is None else write_pgm(edited(np.rint(image), int.from_bytes(raw[:4], "little") >> 4) if edit else np.rint(image)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "image": pa.array(out, pa.binary())})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(seed_col).cast("array<float>").alias("seed")).mapInArrow(run, "id long, image binary")


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """Edited copies of the images of every row whose id is divisible by 50, searched in the images of all rows; and the classes of all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return image_copies(painted_images(rows, "vec_id", "embedding"), painted_images(rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", edit=True))

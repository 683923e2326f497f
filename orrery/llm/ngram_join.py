"""Exact similarity join on word shingles: documents whose sets have a Jaccard similarity of at least 0.8.

1. Sets. Words are hashed in whole row groups; a document's set is its sorted distinct 64-bit shingle hashes. Documents with equal sets
   are one node (named by a 64-bit digest of the set) from here on.
2. Tiles. Two sets of that similarity share one of their first n - ceil(0.8 n) + 1 shingles in any common order, here
   rarest first by a counting sketch of fixed width over all shingles (an order needs no exact counts). A tile holds the sets that have one
   shingle among their first; only sets that are near in size (within 0.8) can be similar. Shingles whose count in the sketch is high may have tiles of
   any size: these are dealt into blocks by hash, so that no task gets a whole tile. A sketch has room for few of them.
3. Bounds. The rows of a block are compared by hashed bitmaps (bits are parities): each differing bit is an element that one side lacks, which bounds the
   overlap from above. Each row gives its best partner that the bound allows, so that a block makes no more pairs than it has rows. Only sets with
   such a partner go on to the next rounds, and those in tiles of several blocks.
4. Rounds. The best partner of each set is verified by intersecting the sorted arrays, and links join components (by pointer jumping). Then the same
   again, in other blocks, between different components only, until a round finds no link. A large group of copies becomes one component in these
   rounds at the cost of a few links for each of its sets.
5. Last round. All pairs of different components that share a tile and pass the bound are verified. In each tile the largest component is set
   apart: only the other sets are compared, with each other and with it, so that a tile costs as many rows as it has for each block of
   others. What is left there are near misses.

Pairs in one component aren't compared any more, as nothing depends on them; no pair of different components is left out.

Cases: a null, empty or blank text has no shingles and is linked with nothing (its component is its own id); fewer than five words are one shingle; equal rows
are equal documents; rows of one id with different texts are documents each; a null id names no document: such a row gets the component of its links (the
smallest id there), else null; an empty table gives an empty result; other columns don't matter. Digests of sets and hashes of shingles have 64 bits: among
100 million different sets the chance of any collision is about 3e-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .graph import components
from .shared import Scratch, hashable, join_left, table

WORDS = 5
SKETCH_BITS = 20
SKETCH_PARTS = 64
BLOCK = 1024
#: Rounds of best partners before all that is left is compared; a round without links ends them sooner.
ROUNDS = 2
#: Bits of a bitmap at most. Those of sets of more than some 18,000 shingles can't differ in as many as it takes to leave a pair out, and all of theirs are intersected.
MOST_BITS = 8192
#: A shingle may have a large tile if it has this count in the sketch, above four times the mean.
LARGE = 4096

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, firsts): text i has the shingles hashes[firsts[i]:firsts[i+1]], repeats included."""
    _, _, first, h = textops.words(data, offsets)
    count = np.diff(first)
    if not h.size:
        return h, np.zeros(offsets.size, np.int64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    every = np.zeros(h.size, dtype=np.uint64)
    for k in range(words):
        every += padded[k : k + h.size] * _FACTORS[k % 8] + np.uint64(k)
    every = textops.mix(every)
    doc = np.repeat(np.arange(count.size), count)
    within = np.arange(h.size) + words <= first[1:][doc]
    n = np.maximum(count - words + 1, 0)
    short = (count > 0) & (count < words)
    if short.any():
        for i in np.flatnonzero(short):  # the whole sequence as one
            own = h[first[i] : first[i + 1]]
            every[first[i]] = textops.mix((own * _FACTORS[: own.size]).sum(keepdims=True) + np.uint64(own.size))[0]
        within[first[:-1][short]] = True
        n[short] = 1
    return every[within], np.concatenate([[0], np.cumsum(n)])


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def linked(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """100 * intersection >= 80 * union, by the sum of both sizes."""
    return 9 * common >= 4 * sizes


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A hashed bitmap of a set, of one to two bits for each element, as bytes: whether an odd number of elements falls on a bit."""
    bits = min(MOST_BITS, max(64, 1 << int(hashes.size - 1).bit_length()))
    odd = np.bincount(((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    """The bitmap of the same set with fewer bytes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, to), axis=0) if bits.size > to else bits


def overlap_bounds(some: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """Upper bounds of the overlap of sets (rows of bitmaps) with one set: each differing bit is an element that one side lacks."""
    differ = np.bitwise_count((some ^ one).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return np.minimum((sizes + size - differ) // 2, np.minimum(sizes, size))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, data, offsets in textops.documents(batches, "text"):
        h, first = shingles(data, offsets)
        yield rows, [np.unique(h[first[i] : first[i + 1]]) for i in range(len(rows))]


def sketch(df: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all shingles by their last bits: fixed in size, whatever the input."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, dtype=np.int64)
        some = False
        for _, data, offsets in textops.documents(batches, "text"):
            h, _ = shingles(data, offsets)
            out += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
            some = True
        if some:
            parts = [x.astype("<i8" if x.max(initial=0) > 2**31 - 1 else "<i4") for x in out.reshape(SKETCH_PARTS, -1)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(SKETCH_PARTS), pa.int32()), "wide": pa.array([x.itemsize == 8 for x in parts]), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, wide, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                more = np.frombuffer(counts, dtype="<i8" if wide else "<i4").astype(np.int64)
                sums[part] = sums[part] + more if part in sums else more
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "wide": pa.array([True] * len(sums)), "counts": pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())})

    kind = "part int, wide boolean, counts binary"
    rows = df.mapInArrow(count, kind).repartition(SKETCH_PARTS, "part").mapInArrow(add, kind).collect()
    out = np.zeros((SKETCH_PARTS, size // SKETCH_PARTS), dtype=np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], dtype="<i8")
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


_ROW = "id long, mark long, n long, node long, bits binary, prefix array<long>, large array<long>"


def _rows(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """The node, size, bitmap and first shingles of each row (id, mark, text); large: those whose tiles may be large."""
    shipped = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        last, limit = np.uint64(counts.size - 1), LARGE + 4 * float(counts.mean())
        for rows, sets in _sets(batches):
            n, node, bits, prefix, large = [], [], [], [], []
            for s in sets:
                n.append(s.size)
                if not s.size:
                    for x in (node, bits, prefix, large):
                        x.append(None)
                    continue
                often = counts[s & last]
                order = np.lexsort((s, often))[: prefix_size(s.size)]
                much = often[order] >= limit
                node.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                bits.append(bitmap(s).tobytes())
                prefix.append(s[order[~much]].view(np.int64))
                large.append(s[order[much]].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefix, large)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), *lists], [f.split(" ")[0] for f in _ROW.split(", ")])

    return df.mapInArrow(run, _ROW)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _sets(batches):
        yield pa.RecordBatch.from_pydict({"node": rows.column(0), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of pairs (a, b, a_set, b_set)."""
    for batch in batches:
        a, b = [], []
        for p, q, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            if x.size and linked(np.intersect1d(x, y, assume_unique=True).size, x.size + y.size):
                a.append(p.as_py())
                b.append(q.as_py())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(scratch: Scratch, sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Links among pairs (a, b)."""
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set")
    return scratch.keep(both.mapInArrow(_verified, "a long, b long").distinct(), f"{name}-links")


class _Tile:
    """Rows (node, n, component, bits) of one or two blocks of a tile, by size; bits as bytes. side 0 is compared with side 1, or with itself if alone."""

    def __init__(self, rows: list[tuple], alone: bool):
        self.alone = alone
        self.side, self.node, self.n, self.comp = ([r[k] for r in rows] for k in (3, 4, 5, 6))
        self.bits = [r[7] for r in rows]

    def few(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, bound) of pairs that may be linked, one by one."""
        whole = [int.from_bytes(b, "little") for b in self.bits]
        for i in range(len(whole)):
            for j in range(i + 1 if self.alone else 0, len(whole)):
                if not self.alone and (self.side[i] or not self.side[j]):
                    continue
                a, b = self.n[i], self.n[j]
                if self.comp[i] == self.comp[j] or 5 * min(a, b) < 4 * max(a, b):
                    continue
                x, y, w, v = whole[i], whole[j], len(self.bits[i]) * 8, len(self.bits[j]) * 8
                while w > v:
                    w //= 2
                    x = (x >> w) ^ (x & ((1 << w) - 1))
                while v > w:
                    v //= 2
                    y = (y >> v) ^ (y & ((1 << v) - 1))
                bound = min((a + b - (x ^ y).bit_count()) // 2, a, b)
                if 9 * bound >= 4 * (a + b):
                    yield i, j, bound

    def many(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, all j of its pairs, bounds)."""
        side, n, comp = np.array(self.side), np.array(self.n), np.array(self.comp)
        width = np.array([len(b) for b in self.bits])
        folded = {}
        for w in np.unique(width).tolist():
            wide = np.flatnonzero(width >= w)
            place = np.full(width.size, -1)
            place[wide] = np.arange(wide.size)
            folded[w] = place, np.stack([fold(np.frombuffer(self.bits[k], dtype=np.uint8), w) for k in wide])
        for i in range(n.size) if self.alone else np.flatnonzero(side == 0):
            others = np.arange(i + 1, n.size) if self.alone else np.flatnonzero(side == 1)
            m = others[(comp[others] != comp[i]) & (5 * np.minimum(n[others], n[i]) >= 4 * np.maximum(n[others], n[i]))]
            for w in np.unique(np.minimum(width[m], width[i])).tolist():
                own = m[np.minimum(width[m], width[i]) == w]
                place, bits = folded[w]
                bound = overlap_bounds(bits[place[own]], n[own], bits[place[i]], int(n[i]))
                good = linked(bound, n[own] + n[i])
                if good.any():
                    yield int(i), own[good], bound[good]

    def pairs(self) -> tuple[list[int], list[int], list[float]]:
        if len(self.n) <= 8:
            found = list(self.few())
            return [i for i, _, _ in found], [j for _, j, _ in found], [b / (self.n[i] + self.n[j] - b) for i, j, b in found]
        a, b, score = [], [], []
        n = np.array(self.n)
        for i, j, bound in self.many():
            a += [i] * j.size
            b += j.tolist()
            score += (bound / (n[i] + n[j] - bound)).tolist()
        return a, b, score


def _compare(every: bool):
    """Rows (key, low, high, side, node, n, component, bits) sorted by (key, low, high) to pairs (a, b, score): for each row its best partner, or all pairs.

    A run of rows with equal (key, low, high) is a tile of two blocks (side 0 and 1; the same rows when low = high), of at most BLOCK rows each.
    """

    def flush(rows: list[tuple], out: tuple[list, list, list]) -> None:
        if len(rows) < 2:
            return
        tile = _Tile(rows, rows[0][1] == rows[0][2])
        first, second, score = tile.pairs()
        if not every and len(first) > 1:
            best: dict[int, tuple[float, int]] = {}
            for i, j, x in zip(first, second, score, strict=True):
                for p, q in ((i, j), (j, i)):
                    if p not in best or best[p] < (x, -tile.node[q]):
                        best[p] = x, -tile.node[q]
            for p, (x, q) in best.items():
                out[0].append(tile.node[p])
                out[1].append(-q)
                out[2].append(x)
            return
        for i, j, x in zip(first, second, score, strict=True):
            for p, q in ((i, j), (j, i)):
                out[0].append(tile.node[p])
                out[1].append(tile.node[q])
                out[2].append(x)
                if every:
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def batch_of() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})
            for x in out:
                x.clear()
            return b

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    flush(rows, out)
                    rows = []
                rows.append(row)
                if len(out[0]) > 50_000:
                    yield batch_of()
        flush(rows, out)
        yield batch_of()

    return run


def _compared(dealt: DataFrame, bits: DataFrame, every: bool = False) -> DataFrame:
    """Pairs (a, b, score) of rows (key, low, high, side, node, n, component)."""
    rows = dealt.join(bits, "node").select("key", "low", "high", "side", "node", "n", "component", "bits")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side", "n", "node").mapInArrow(_compare(every), "a long, b long, score double")


def _block(block: int, rows: Column, salt: int) -> Column:
    """The block of a row: by hash, of as many blocks as the rows make."""
    return F.pmod(F.xxhash64("node", "key", F.lit(salt)), F.ceil(rows / block)).cast("int")


def _labelled(tiles: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return tiles.withColumn("component", F.col("node"))
    return tiles.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pairs(scratch: Scratch, tiles: DataFrame, found: DataFrame | None, bits: DataFrame, block: int, salt: int = 0) -> DataFrame:
    """Pairs (a, b, score) of different components, fitting sizes and bounds that share a block of a tile: the best ones of each row."""
    labelled = _labelled(tiles, found)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).filter("x <> y").select("key", "rows")
    at = _block(block, F.col("rows"), salt)
    rows = join_left(labelled, scratch.keep(mixed, f"mixed-{salt}"), ["key"], "rows").filter("rows IS NOT NULL")
    return _compared(rows.select("key", at.alias("low"), at.alias("high"), F.lit(0).alias("side"), "node", "n", "component"), bits)


def _all_pairs(scratch: Scratch, tiles: DataFrame, found: DataFrame, bits: DataFrame, block: int) -> DataFrame:
    """All pairs (a, b, score) of different components, fitting sizes and bounds that share a tile. The largest component of a tile (side 1) isn't compared with itself."""
    labelled = _labelled(tiles, found)
    by_part = labelled.groupBy("key", "component").agg(F.count("*").alias("rows"))
    mixed = by_part.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("top"), F.max("rows").alias("top_rows"), (F.sum("rows") - F.max("rows")).alias("others")).filter("others > 0")
    rows = join_left(labelled, scratch.keep(mixed, "mixed-last"), ["key"], "top_rows").filter("others IS NOT NULL").withColumn("is_top", F.col("component") == F.col("top"))
    count = F.when(F.col("is_top"), F.col("top_rows")).otherwise(F.col("others"))
    other_blocks, top_blocks = (F.ceil(F.col(c) / block).cast("int") for c in ("others", "top_rows"))
    rows = rows.withColumn("block", _block(block, count, 0))
    # blocks of others are 0, 1, 2, those of the largest component follow; a row goes to each tile that has its block: (low, high), low one of the others
    lows = F.sequence(F.lit(0), other_blocks - 1)
    as_top = F.transform(lows, lambda low: F.struct(low.alias("low"), (other_blocks + F.col("block")).alias("high"), F.lit(1).alias("side")))
    with_others = F.transform(lows, lambda x: F.struct(F.least(x, F.col("block")).alias("low"), F.greatest(x, F.col("block")).alias("high"), F.when(F.col("block") <= x, 0).otherwise(1).alias("side")))
    with_top = F.transform(F.sequence(F.lit(0), top_blocks - 1), lambda x: F.struct(F.col("block").alias("low"), (other_blocks + x).alias("high"), F.lit(0).alias("side")))
    dealt = rows.withColumn("tile", F.explode(F.when(F.col("is_top"), as_top).otherwise(F.concat(with_others, with_top))))
    return _compared(dealt.select("key", "tile.low", "tile.high", "tile.side", "node", "n", "component"), bits, every=True)


def _best(pairs: DataFrame) -> DataFrame:
    """One pair (a, b) for each node a, a < b."""
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("score", F.col("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(scratch: Scratch, found: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """found (node, component) after more links."""
    label = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).filter("a <> b")
    top = components(scratch, between, name).select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = found.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = top.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return scratch.keep(moved.unionAll(alone), f"{name}-found")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): rows with one id and mark are equal."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _nodes(scratch: Scratch, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of each node. First shingles stay where they are, but those of nodes of several rows."""
    every = join_left(rows.filter("n > 0"), repeated, ["node"], "members")
    chosen = every.filter(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))
    names = ("node", "id", "mark", "n", "bits", "prefix", "large")
    return scratch.keep(every.filter("members IS NULL").select(*names).unionByName(chosen.select(*names).dropDuplicates(["node"])), "nodes")


def _sets_of(scratch: Scratch, docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes, from a row of each."""
    key = F.xxhash64("id", "mark")
    asked = scratch.keep(nodes.select("node", key.alias("key")).join(wanted, "node", "left_semi").withColumn("weight", F.lit(1)), "asked")
    texts = join_left(docs.withColumn("key", key), asked, ["key"], "weight").filter("node IS NOT NULL")
    sets = scratch.keep(texts.select("node", "text").mapInArrow(_set_rows, "node long, hashes binary"), "sets")
    if sets.groupBy("node").count().filter("count > 1").isEmpty():
        return sets
    return scratch.keep(sets.dropDuplicates(["node"]), "sets-once")  # rows that are repeated with their id


def groups(scratch: Scratch, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, mark, n, component) of each row of `_documents`, a written table; component is null without shingles."""
    rows = scratch.keep(_rows(docs, sketch(docs.select("text"))), "rows")
    by_node = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("members"))
    repeated = scratch.keep(by_node.filter("members > 1"), "repeated")
    nodes = _nodes(scratch, rows, repeated)
    every = scratch.keep(rows.select("id", "mark", "n", "node"), "documents")
    scratch.drop("rows")
    entries = nodes.select("node", "n", F.explode("prefix").alias("key"))
    # what has a row of fitting size in its tile: by size, the nearest ones are its neighbours
    by_size = Window.partitionBy("key").orderBy("n", "node")
    near = entries.select("key", "node", "n", F.lag("n").over(by_size).alias("before"), F.lead("n").over(by_size).alias("after"))
    near = near.filter("5 * before >= 4 * n OR 5 * n >= 4 * after").select("key", "node", "n")
    tiles = scratch.keep(near.unionByName(nodes.select(F.explode("large").alias("key"), "node", "n")), "tiles")
    bits = scratch.keep(nodes.join(tiles.select("node").distinct(), "node", "left_semi").select("node", "bits"), "bits")

    pairs = scratch.keep(_pairs(scratch, tiles, None, bits, block), "pairs")
    # sets that no bound links, in tiles of one block, have been compared with all of theirs
    partnered = pairs.select(F.col("a").alias("node"))
    wide = scratch.keep(tiles.groupBy("key").count().filter(F.col("count") > block), "wide")
    partnered = scratch.keep(partnered.unionAll(join_left(tiles, wide, ["key"], "count").filter("count IS NOT NULL").select("node")).distinct(), "partnered")
    tiles = scratch.keep(tiles.join(partnered, "node", "left_semi"), "tiles-kept")
    scratch.drop("tiles")
    sets = _sets_of(scratch, docs, nodes, partnered)
    found = components(scratch, _verify(scratch, sets, scratch.keep(_best(pairs), "best-0"), "round-0"), "found-0")
    for k in range(1, ROUNDS + 1):
        links = _verify(scratch, sets, scratch.keep(_best(_pairs(scratch, tiles, found, bits, block, k)), f"best-{k}"), f"round-{k}")
        if links.isEmpty():
            break
        found = _joined(scratch, found, links, f"found-{k}")
    last = _all_pairs(scratch, tiles, found, bits, block).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = _joined(scratch, found, _verify(scratch, sets, scratch.keep(last, "last-pairs"), "last"), "found-last")
    heavy = scratch.keep(found.join(repeated.select("node", "members"), "node", "left").withColumn("members", F.coalesce("members", F.lit(1))), "heavy")
    out = join_left(every, heavy, ["node"], "members").select("id", "mark", "n", F.coalesce("component", "node").alias("component"))
    out = scratch.keep(out, "result")
    scratch.drop_but("result")
    return out


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id): a row for each row of df."""
    scratch = Scratch(df.sparkSession, "jaccard")
    rows = groups(scratch, _documents(df, id_col, text_col), block)
    several = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    out = join_left(rows, scratch.keep(several, "several"), ["component"], "rows")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group: that of the least id (rows without an id come last); rows without shingles are in no group, and stay."""
    scratch = Scratch(df.sparkSession, "first")
    rows = groups(scratch, _documents(df, id_col, text_col))
    key, order = F.xxhash64("id", "mark"), F.struct(F.col("id").isNull(), "id", "mark")
    several = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min_by(key, order).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    told = join_left(rows, scratch.keep(several, "several"), ["component"], "rows").filter("rows > 1").groupBy(key.alias("key")).agg(F.bool_and(key == F.col("first")).alias("stays"), F.count("*").alias("rows"))
    told = scratch.keep(told, "told")  # rows of one key are equal in id and text
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    marked = df.select(whole, F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))).alias("key"), F.xxhash64(*hashable(df)).alias("tie"))
    left = join_left(marked, told, ["key"], "rows").filter("stays IS NULL OR stays")
    once = left.filter("rows IS NULL OR rows = 1").select("row")
    return once.unionByName(left.filter("rows > 1").groupBy("key").agg(F.min_by("row", "tie").alias("row")).select("row")).select("row.*")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

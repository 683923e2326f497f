"""Byte-level BPE: encoding and decoding of whole texts with a tokenizer file's merges.

Texts are cut into words of the byte-level pattern by array operations on code point classes. Each different word is encoded
once: short words (up to SHORT bytes) of equal length form a matrix of parts, with a matrix of the ranks of adjacent parts
beside it; scan each row for its least rank, delete the boundary there, refresh the ranks left and right of it, until no row
has a rank. A longer word is encoded with a heap over linked parts, which gives the same merges without the repeated scans.
Decoding maps ids to bytes and reads them as UTF-8.

Cases: a null text is empty: no ids, and the decoded text is empty; ties are of equal rank in one word, where the leftmost
is merged first; the string of an added token becomes that token; very long texts are handled whole, their words in one
row group; repeated rows are encoded each; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textops
from .shared import table

SHORT = 48
#: Row groups of about this many bytes; different words that a worker keeps between groups.
GROUP = 1 << 20
KEPT_WORDS = 400_000
NO_RANK = np.int32(2**31 - 1)
#: Seed of the second hash of a word. Ids are used again only where both hashes of a word are those of the word that they were made of.
CHECK = 0x5851F42D4C957F2D
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0


@cache
def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    return out


def word_starts(points: np.ndarray, section: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pattern start; section: where a text starts (no word crosses that)."""
    n = points.size
    kind = _classes()[points]
    fresh = section.copy()
    fresh[0] = True
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    # a blank goes to the word behind it; so does no other white space, which ends a run that leaves its last character
    joined = np.zeros(n, dtype=bool)
    joined[1:] = ~blank[1:] & (points[:-1] == 0x20) & ~fresh[1:]
    start &= ~joined
    last = np.zeros(n, dtype=bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:]
    start |= last
    # contractions: an apostrophe that starts a word, and one or two letters
    mark = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & ~fresh[1:])
    if mark.size:
        a = points[mark + 1]
        two = mark + 2
        inside = (two < n) & ~fresh[np.minimum(two, n - 1)]
        b = np.where(inside, points[np.minimum(two, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[mark[one | pair] + 1] = False
        ends = np.concatenate([mark[one] + 2, mark[pair] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class BytePairCodec:
    """The merges and bytes of a tokenizer file (byte-level BPE without normaliser)."""

    def __init__(self, spec: dict):
        model, back = spec["model"], _byte_chars()
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        of = [b""] * size
        for token, i in vocab.items():
            of[i] = bytes(back[c] for c in token) if token not in added else token.encode()
        for token, i in added.items():
            of[i] = token.encode()
        self.added = {token.encode(): i for token, i in added.items()}
        lengths = np.array([len(b) for b in of], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(of), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.of_byte = np.zeros(256, dtype=np.int32)
        for c, b in back.items():
            self.of_byte[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self._hash()

    def _hash(self) -> None:
        """An open table of pairs, so that a rank is found in about one step."""
        bits = max(4, int(self.codes.size * 4).bit_length())
        self.bits = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, NO_RANK, dtype=np.int32)
        for code, rank, h in zip(self.codes.tolist(), self.ranks.tolist(), self._slot(self.codes).tolist(), strict=True):
            while self.slots[h] != -1:
                h = (h + 1) & (self.slots.size - 1)
            self.slots[h], self.slot_rank[h] = code, rank

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; NO_RANK where there is no merge."""
        codes = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(codes)
        found = self.slots[at]
        out = np.where(found == codes, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((found != codes) & (found != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & (self.slots.size - 1)
            found = self.slots[at[open_]]
            hit = found == codes[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, how many) of words of equal length, a row each."""
        n, width = parts.shape
        count = np.full(n, width, dtype=np.int64)
        if width == 1:
            return parts, count
        ranks = np.full((n, width), NO_RANK, dtype=np.int32)
        ranks[:, :-1] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        rows, work, near, left = np.arange(n), parts.copy(), ranks, width
        while rows.size:
            place = near.argmin(axis=1)
            at = np.arange(rows.size)
            least = near[at, place]
            going = least != NO_RANK
            if not going.all():
                parts[rows[~going], :left] = work[~going]
                rows, work, near, place, least = rows[going], work[going], near[going], place[going], least[going]
                at = np.arange(rows.size)
                if not rows.size:
                    break
            # delete the boundary behind `place`: each row loses a part
            work[at, place] = self.made[least]
            left -= 1
            keep = np.ones(work.shape, dtype=bool)
            keep[at, place + 1] = False
            work = work[keep].reshape(rows.size, left)
            near = near[keep].reshape(rows.size, left)
            count[rows] = left
            fresh = np.full(rows.size, NO_RANK, dtype=np.int32)
            more = np.flatnonzero(place < left - 1)
            fresh[more] = self.rank(work[more, place[more]], work[more, place[more] + 1])
            near[at, place] = fresh
            more = np.flatnonzero(place > 0)
            near[more, place[more] - 1] = self.rank(work[more, place[more] - 1], work[more, place[more]])
        return parts, count

    def _long(self, word: bytes) -> np.ndarray:
        """Parts of one long word: a heap of (rank, place) over linked parts."""
        parts = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        table = self.pair_table
        heap = [(r, i) for i in range(n - 1) if (r := table.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or table.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (x := table.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := table.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([p for p in parts if p >= 0], dtype=np.int32)

    @property
    def pair_table(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            self._pairs = {(c >> 32, c & 0xFFFFFFFF): r for c, r in zip(self.codes.tolist(), self.ranks.tolist(), strict=True)}
        return self._pairs

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many by word) of the words data[s:e]."""
        lengths = ends - starts
        counts = np.zeros(starts.size, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # words, and their ids one after another
        for width in np.unique(lengths[lengths <= SHORT]).tolist():
            which = np.flatnonzero(lengths == width)
            parts, count = self._short(self.of_byte[data[starts[which, None] + np.arange(width)]])
            counts[which] = count
            found.append((which, parts[np.arange(width) < count[:, None]]))
        for i in np.flatnonzero(lengths > SHORT).tolist():
            ids = self._long(data[starts[i] : ends[i]].tobytes())
            counts[i] = ids.size
            found.append((np.array([i]), ids))
        first = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(first[-1], dtype=np.int32)
        for which, ids in found:
            out[spans(first[which], counts[which])] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.bytes[spans(self.starts[ids], self.starts[ids + 1] - self.starts[ids])]


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (counts[0] of them), first[1], ..."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(total)


class Encoder:
    """Encodes row groups of texts, and keeps the words that it has met (at most KEPT_WORDS between groups)."""

    def __init__(self, codec: BytePairCodec):
        self.codec = codec
        self._forget()

    def _forget(self) -> None:
        self.keys, self.check, self.first, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _sections(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Where texts or what stands between added tokens start; the added tokens as (start, end, id)."""
        raw, special = data.tobytes(), []
        for token, i in self.codec.added.items():
            at = raw.find(token)
            while at >= 0:
                if offsets[np.searchsorted(offsets, at, side="right")] >= at + len(token):
                    special.append((at, at + len(token), i))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        special.sort()
        cuts = np.unique(np.concatenate([offsets[:-1], np.array([x for s, e, _ in special for x in (s, e)], dtype=np.int64)]))
        return cuts[cuts < data.size], special

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of ids by text) of the texts data[offsets[i]:offsets[i+1]]."""
        if not data.size:
            return np.zeros(0, np.int32), np.zeros(offsets.size, np.int64)
        cuts, special = self._sections(data, offsets)
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        broken = points >= 0xDC80
        broken &= points <= 0xDCFF  # bytes that aren't UTF-8 count as a byte each
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        wide[broken] = 1
        at = np.cumsum(wide) - wide
        section = np.zeros(points.size, dtype=bool)
        section[np.searchsorted(at, cuts)] = True
        starts = at[word_starts(points, section)]
        if special:  # the words inside an added token are one
            drop = np.zeros(starts.size, dtype=bool)
            for s, e, _ in special:
                drop |= (starts > s) & (starts < e)
            starts = starts[~drop]
        ends = np.append(starts[1:], data.size)
        keys, back = np.unique(textops.range_hashes(data, starts, ends), return_inverse=True)
        check = textops.range_hashes(data, starts, ends, CHECK)
        one = np.empty(keys.size, dtype=np.int64)
        one[back] = np.arange(starts.size)  # a word of each key
        ids = {s: i for s, _, i in special}
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(keys.size, dtype=bool)
        if self.keys.size:
            known = self.keys[np.minimum(place, self.keys.size - 1)] == keys
        new = np.flatnonzero(~known)
        if new.size:
            flat, counts = self.codec.encode_words(data, starts[one[new]], ends[one[new]])
            first = self.flat.size + np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, flat])
            added = ((self.keys, keys[new]), (self.check, check[one[new]]), (self.first, first), (self.count, counts))
            self.keys, self.check, self.first, self.count = (np.insert(a, place[new], b) for a, b in added)
            place = np.searchsorted(self.keys, keys)
        count, first = self.count[place][back], self.first[place][back]
        flat = self.flat
        other = np.flatnonzero(self.check[place][back] != check)
        if other.size:  # words that only share another word's key
            ids_of, count[other] = self.codec.encode_words(data, starts[other], ends[other])
            first[other] = flat.size + np.cumsum(count[other]) - count[other]
            flat = np.concatenate([flat, ids_of])
        if ids:
            which = np.flatnonzero(np.isin(starts, list(ids)))
            first[which], count[which] = flat.size + np.arange(which.size), 1
            flat = np.concatenate([flat, np.array([ids[int(starts[w])] for w in which], dtype=np.int32)])
        out = flat[spans(first, count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        by_text = upto[np.searchsorted(starts, offsets)]
        if self.keys.size > KEPT_WORDS:
            self._forget()
        return out, by_text


def read_codec(path: str) -> BytePairCodec:
    with open(path, encoding="utf-8") as f:
        return BytePairCodec(json.load(f))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every text. The file is read once, by the driver;
    its merges go to the executors (their size is that of a vocabulary, not of the data)."""
    shipped = df.sparkSession.sparkContext.broadcast(read_codec(tokenizer_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for rows, data, offsets in textops.documents(batches, "text", GROUP):
            ids, first = encoder.encode(data, offsets)
            decoded = encoder.codec.decode(ids)
            byte_at = np.concatenate([[0], np.cumsum(encoder.codec.starts[ids + 1] - encoder.codec.starts[ids])])[first]
            n_tokens, id_sums, text_sums, all_ids, texts = [], [], [], [], []
            for i in range(len(rows)):
                own = ids[first[i] : first[i + 1]]
                text = decoded[byte_at[i] : byte_at[i + 1]].tobytes().decode("utf-8", "replace")
                n_tokens.append(own.size)
                id_sums.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(own)
                    texts.append(text)
            out = {"id": rows.column(0), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_byte_pair(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_path(), with_ids=False)

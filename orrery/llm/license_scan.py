"""Fuzzy search for short licence notices in whole texts.

A text is reduced to its lower-cased words with single blanks between them. A notice of which k edits are allowed is cut into
k + 1 pieces: a place with at most k edits leaves one piece untouched (pigeonhole), so that exact searches for pieces find every candidate.
Around a candidate, the regex library matches the whole notice with at most k errors, and reports the span and its errors.
Notices of different labels can be fewer edits apart than that. So a place with another version number than the notice, or with
a condition that the notice lacks (nc, nd, sa), is none; of places of different labels that share half of the shorter one, those with
the fewest errors stay.
The base phrases are found as runs of equal words.

Cases: a null, empty or blank text has no words, no labels and the score 0; of overlapping places of one label that with the fewest
errors stays (the first one, if equal); an error is a character, whatever its bytes (a byte in texts that aren't UTF-8); very long texts are searched whole; repeated rows give repeated results; an empty table gives an
empty result; other columns don't matter. Positions are numbers of words, from 0.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textops
from .byte_pair import spans
from .shared import table

#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


#: What tells licences of the cc family apart.
CONDITIONS = {"nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"}
DIGITS = "0123456789"


@dataclass(frozen=True)
class Notice:
    """A notice as normalised words, its label, and how many edits (of characters) still make it."""

    words: str
    label: str
    edits: int
    versioned: bool = False

    def decides(self, found: str) -> bool:
        """Whether the whole words of a place have no other version and no other condition; lost or garbled ones are edits."""
        if self.versioned:
            left = iter(c for c in self.words if c in DIGITS)
            if not all(c in left for c in found if c in DIGITS):  # in this order
                return False
        return not self.label.startswith("cc-") or not CONDITIONS & (set(found.split()) - set(self.words.split()))

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """(offset, text) of edits + 1 pieces of about equal length."""
        cuts = [len(self.words) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


NOTICES = (
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 8),
    Notice("licensed under the apache license version 2 0", "apache-2", 3, versioned=True),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 1),
    Notice("licensed under cc by sa 4 0", "cc-by-sa", 1),
    Notice("licensed under cc by 4 0", "cc-by", 1),
    Notice("creative commons attribution noncommercial 4 0 international", "cc-by-nc", 4),
    Notice("creative commons attribution noncommercial sharealike 4 0 international", "cc-by-nc-sa", 4),
    Notice("creative commons attribution noderivatives 4 0 international", "cc-by-nd", 4),
    Notice("creative commons attribution sharealike 4 0 international", "cc-by-sa", 4),
    Notice("creative commons attribution 4 0 international", "cc-by", 3),
    Notice("licensed under the gnu general public license version 3", "gpl-3", 4, versioned=True),
    Notice("licensed under the gnu general public license version 2", "gpl-2", 4, versioned=True),
    Notice("under the terms of the gnu general public license as published by the free software foundation", "gpl", 6),
    Notice("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl", 6),
    Notice("under the terms of the gnu affero general public license as published by the free software foundation", "agpl", 6),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    Notice("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 8),
    Notice("subject to the terms of the mozilla public license v 2 0", "mpl-2", 4, versioned=True),
    Notice("made available under the terms of the eclipse public license v 2 0", "epl-2", 4, versioned=True),
    Notice("distributed under the boost software license version 1 0", "bsl-1", 4, versioned=True),
    Notice("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 8),
    Notice("dedicated to the public domain under the cc0 1 0 universal", "cc0", 4),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
)


@cache
def _pattern(notice: Notice) -> regex.Pattern:
    return regex.compile(f"(?b)(?:{regex.escape(notice.words, literal_spaces=True)}){{e<={notice.edits}}}")


def _fuzzy(text: str, notices: tuple[Notice, ...]) -> list[tuple[int, int, int, Notice]]:
    """(start, end, errors, notice) in the normalised text of many documents, which are lines."""
    found = []
    for notice in notices:
        length, done = len(notice.words), set()
        for offset, piece in notice.pieces:
            at = text.find(piece)
            while at >= 0:
                lo, hi = max(0, at - offset - notice.edits), at - offset + length + notice.edits
                line = text.rfind("\n", lo, at) + 1
                lo = max(lo, line)
                end = text.find("\n", at, hi)
                hi = hi if end < 0 else end
                if (lo, hi) not in done:
                    done.add((lo, hi))
                    if (m := _pattern(notice).search(text, lo, hi)) and notice.decides(_whole_words(text, m.start(), m.end())):
                        found.append((m.start(), m.end(), sum(m.fuzzy_counts), notice))
                at = text.find(piece, at + 1)
    best: list[tuple[int, int, int, Notice]] = []
    taken: dict[str, list[tuple[int, int]]] = {}  # by label: places that don't overlap, in order
    for s, e, errors, notice in sorted(found, key=lambda x: (x[2], x[0], -x[1], x[3].words)):
        places = taken.setdefault(notice.label, [])
        k = bisect_left(places, (s, e))
        if not (k and places[k - 1][1] > s) and not (k < len(places) and places[k][0] < e):
            insort(places, (s, e))
            best.append((s, e, errors, notice))
    return _nearest(best)


def _whole_words(text: str, start: int, end: int) -> str:
    """The words that a place has letters of."""
    while start and text[start] not in " \n" and text[start - 1] not in " \n":
        start -= 1
    while end < len(text) and text[end - 1] not in " \n" and text[end] not in " \n":
        end += 1
    return text[start:end]


def _characters(raw: np.ndarray) -> tuple[str, np.ndarray]:
    """(text, the number of characters before each byte and behind the last one)."""
    try:
        text, first = raw.tobytes().decode(), (raw & 0xC0) != 0x80
    except UnicodeDecodeError:
        text, first = raw.tobytes().decode("latin-1"), np.ones(raw.size, dtype=bool)
    return text, np.concatenate([[0], np.cumsum(first)])


def _nearest(places: list[tuple[int, int, int, Notice]]) -> list[tuple[int, int, int, Notice]]:
    """Without the places that share half of the shorter one with a place of another label and fewer errors."""
    order, lost = sorted(places, key=lambda x: x[0]), set()
    for i, a in enumerate(order):
        for k in range(i + 1, len(order)):
            b = order[k]
            if b[0] >= a[1]:
                break
            if a[3].label != b[3].label and a[2] != b[2] and 2 * (min(a[1], b[1]) - b[0]) >= min(a[1] - a[0], b[1] - b[0]):
                lost.add(i if a[2] > b[2] else k)
    return [x for i, x in enumerate(order) if i not in lost]


def scan(data: np.ndarray, offsets: np.ndarray, phrases=PHRASES, notices: tuple[Notice, ...] = NOTICES) -> tuple[np.ndarray, list[list[tuple[int, str]]], list[list[dict]]]:
    """(words by text, base places by text as (word, label), notices by text)."""
    start, end, first, h = textops.words(data, offsets, textops.NOT_ALNUM)
    n = offsets.size - 1
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    spots: list[list[dict]] = [[] for _ in range(n)]
    doc = np.repeat(np.arange(n), np.diff(first))
    for phrase, label in phrases:
        own = textops.hash_words(phrase.split())
        at = np.flatnonzero(h[: max(0, h.size - own.size + 1)] == own[0])
        for k in range(1, own.size):
            at = at[h[at + k] == own[k]]
        at = at[doc[at] == doc[at + own.size - 1]]
        for i in at.tolist():
            base[doc[i]].append((i - int(first[doc[i]]), label))
    if h.size:
        length = end - start
        after = np.cumsum(length + 1)
        text = np.full(int(after[-1]), 0x20, dtype=np.uint8)
        text[spans(after - length - 1, length)] = textops.LOWER[data[spans(start, length)]]
        text[after[np.append(first[1:][np.diff(first) > 0] - 1, -1)] - 1] = 0x0A
        whole, upto = _characters(text)
        behind = upto[after]  # each word's end and blank, in characters
        for s, e, errors, notice in _fuzzy(whole, notices):
            a, b = (int(np.searchsorted(behind, x, side="right")) for x in (s, max(s, e - 1)))
            d = int(doc[a])
            spots[d].append({"label": notice.label, "first_word": a - int(first[d]), "last_word": b - int(first[d]), "errors": errors, "similarity": 1 - errors / len(notice.words), "text": data[start[a] : end[b]].tobytes().decode("utf-8", "replace")})
    return np.diff(first), base, spots


def license_notices(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Counts, labels, score, and the notices with their spans, for every text."""
    kind = df.schema[id_col].dataType.simpleString()
    spot = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("similarity", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textops.documents(batches, "text"):
            words, base, spots = scan(data, offsets, phrases, notices)
            places = [[p for p, _ in b] for b in base]
            sets = [{x for _, x in b} for b in base]
            columns = {
                "id": rows.column(0), "n_words": pa.array(words, pa.int64()), "n_base": pa.array([len(b) for b in base], pa.int64()),
                "first_word": pa.array([min(p, default=None) for p in places], pa.int64()), "last_word": pa.array([max(p, default=None) for p in places], pa.int64()),
                "base_labels": pa.array([",".join(sorted(s)) for s in sets], pa.string()),
                "labels": pa.array([",".join(sorted(s | {x["label"] for x in more})) for s, more in zip(sets, spots, strict=True)], pa.string()),
                "score": pa.array([1.0 if s else max((x["similarity"] for x in more), default=0.0) for s, more in zip(sets, spots, strict=True)], pa.float64()),
                "notices": pa.array([sorted(more, key=lambda x: (x["first_word"], x["label"])) for more in spots], pa.list_(spot)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label: string, first_word: long, last_word: long, errors: int, similarity: double, text: string>>"
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))

"""Scores of whole documents under a gated recurrent language model that is trained on the corpus, and under word counts.

1. Counts of all training words: each task adds up its own words, then they meet by word. They give the base score and the shortlist.
2. Training. The training documents are dealt into ROUNDS equal shares by hash. In a round each task trains on the documents of the share in
   its partitions (small partitions share a task, equally many each), from the model of the round before; the first one has the biases of the counts. Then the tasks'
   models are averaged with the weights of their words, by parts of the parameter vector, so that what is gathered grows with the input while
   no task holds more than a part of each model. So every training document is learnt from, once; where a task has too few words for
   MIN_STEPS steps, it repeats them. Scores depend a little on how the documents are partitioned, as the averages do; counts and base scores don't.
3. Scoring. The recurrent state goes through all windows of a document. Words outside the shortlist get the model's
   probability of such a word times (count + 1) / (words + kinds + 1) among those. Counts of HEAD frequent words are broadcast (a fixed size);
   rarer words meet the table of counts by a join on the word, and are summed up by document.

Cases: a null, empty or blank text is an end token only; a null id counts as training; repeated rows are counted and scored each; very long
texts are scored whole; without training documents the model is an untrained one and all counts are 0; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru, textops
from .shared import Scratch, shuffles_end, spread, table

#: Words whose counts are broadcast: 16 bytes each, whatever the input.
HEAD = 1 << 16
#: Buckets by which these are looked up, as bits.
BUCKETS = 20
#: Shares of the documents with an average of models behind each, and the least number of steps of a model in a round.
ROUNDS, MIN_STEPS = 3, 100
#: A model is averaged in so many parts, and has at least so many words to learn from (where there are as many), so that the
#: models' size stays in proportion to the input.
PARTS, MODEL_WORDS = 256, 1 << 21
#: Row groups of scoring, in bytes: many lanes stay busy beside a long text.
GROUP = 12 << 20
FLUSH = 1 << 20
HELD_OUT = (7, 2)
#: The end of a text among words: the hash of a blank, which no word can be.
END_WORD = textops.hash_words([b" "])[0]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, back = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
    return words, np.bincount(back, weights=np.concatenate([c for _, c in found])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a partition's texts, and of ends."""

    def out(found) -> pa.RecordBatch:
        words, counts = _merge(found)
        return pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "count": pa.array(counts)})

    found: list[tuple[np.ndarray, np.ndarray]] = []
    for rows, data, offsets in textops.documents(batches, "text"):
        _, _, _, h = textops.words(data, offsets)
        found += [np.unique(h, return_counts=True), (np.array([END_WORD]), np.array([len(rows)]))]
        if len(found) >= 16:
            found = [_merge(found)]
            if found[0][0].size > FLUSH:
                yield out(found)
                found = []
    if found:
        yield out(found)


class Lexicon:
    """Ranks of the shortlist and counts of the head, by word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        """By falling count; the end comes first in the shortlist."""
        short = [END_WORD, *words[words != END_WORD][: gru.SHORTLIST - 2]]
        ranks = dict(zip(short, range(gru.END, gru.SHORTLIST), strict=False))
        words = np.append(words, np.array([] if (words == END_WORD).any() else [END_WORD], dtype=np.uint64))
        counts = np.append(counts, np.zeros(words.size - counts.size, dtype=np.int64))
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.ranks = np.array([ranks.get(w, gru.OTHER) for w in self.words], dtype=np.int64)
        #: The first word of a bucket of hashes, and whether it has others, which hardly any has; ranks and counts with those of other words behind them.
        self.first = np.searchsorted(self.words, np.arange(1 << BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS)).astype(np.int32)
        self.crowded = np.diff(np.append(self.first, self.words.size)) > 1
        self.all_ranks, self.all_counts = np.append(self.ranks, gru.OTHER), np.append(self.counts, 0)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank, count, whether it is in the head)."""
        bucket = (h >> np.uint64(64 - BUCKETS)).view(np.int64)
        at = self.first.take(bucket)
        crowded = np.flatnonzero(self.crowded.take(bucket))
        at[crowded] = np.searchsorted(self.words, h[crowded])
        np.minimum(at, self.words.size - 1, out=at)
        known = self.words.take(at) == h
        at[~known] = self.words.size
        return self.all_ranks.take(at), self.all_counts.take(at), known


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, words with an end behind each text, firsts)."""
    for rows, data, offsets in textops.documents(batches, "text", GROUP):
        _, _, first, h = textops.words(data, offsets)
        yield rows, np.insert(h, first[1:], END_WORD), first + np.arange(first.size)


def _models(df: DataFrame, lexicon, shipped) -> DataFrame:
    """(part, weight, moves): how far a model of each task's texts is from the one that is shipped, in PARTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(*shipped.value)
        kept = []
        for _, h, _ in _streams(batches):
            ranks = lexicon.value.look(h)[0]
            if trainer.steps < MIN_STEPS:
                kept.append(ranks)
            trainer.learn(ranks)
        words = trainer.words
        while kept and trainer.steps < MIN_STEPS:
            for ranks in kept:
                trainer.learn(ranks)
        if words:
            parts = np.array_split(trainer.flat - shipped.value[0], PARTS)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "weight": pa.array([float(words)] * PARTS), "moves": pa.array([x.astype("<f2").tobytes() for x in parts], pa.binary())})

    return df.mapInArrow(run, "part int, weight double, moves binary")


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for part, weight, moves in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            before, total = sums.get(part, (0.0, 0.0))
            sums[part] = before + weight, total + weight * np.frombuffer(moves, dtype="<f2").astype(float)
    if sums:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "moves": pa.array([(x / w).astype("<f4").tobytes() for w, x in sums.values()], pa.binary())})


def trained(df: DataFrame, lexicon, start: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """`start` and the average of the tasks' moves; one model comes to the driver."""
    shipped = df.sparkSession.sparkContext.broadcast((start, bounds))
    with shuffles_end(df.sparkSession):
        rows = _models(df, lexicon, shipped).repartition(min(PARTS, spread(df.sparkSession)), "part").mapInArrow(_average, "part int, moves binary").collect()
    shipped.destroy()  # its files would stay with the executors
    if not rows:
        return start
    return start + np.concatenate([np.frombuffer(r["moves"], dtype="<f4") for r in sorted(rows, key=lambda r: r["part"])])


def models_of(partitions: int, words: int) -> int:
    """How many models learn from so many words in a round: each has equally many partitions, of about MODEL_WORDS words. (Where some have two
    partitions and some have one, the latter have too few words for MIN_STEPS steps, and learn from them again.)"""
    return max(1, partitions // max(1, round(partitions * MODEL_WORDS / max(1, words))))


_SCORED = "row long, id {}, held_out boolean, n_tokens long, n_head long, n_other long, logs double, head_logs double, other_logs double, tail array<long>"


def _scored(df: DataFrame, lexicon, shipped, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        model, bounds = shipped.value
        for rows, h, first in _streams(batches):
            ranks, counts, known = lexicon.value.look(h)
            doc = np.repeat(np.arange(len(rows)), np.diff(first))
            add = lambda weights: np.bincount(doc, weights=weights, minlength=len(rows))  # noqa: E731, B023
            log = np.where(known, np.log10(counts + 1), 0.0)
            other = ranks == gru.OTHER
            tail = h[~known].view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(row + np.arange(len(rows))), "id": rows.column(0), "held_out": rows.column(1), "n_tokens": pa.array(np.diff(first)),
                "n_head": pa.array(add(known & (counts > 0)).astype(np.int64)), "n_other": pa.array(add(other).astype(np.int64)),
                "logs": pa.array(gru.text_logs(model, ranks, first, bounds=bounds) / np.log(10)), "head_logs": pa.array(add(log)), "other_logs": pa.array(add(np.where(other, log, 0.0))),
                "tail": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(add(~known))]).astype(np.int32)), pa.array(tail)),
            })
            row += len(rows)

    return df.mapInArrow(run, _SCORED.format(kind))


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts. A histogram of counts by eighths of powers of two comes first, so that hardly more than `most` words are sorted."""
    size = F.floor(F.log2(F.col("count").cast("double")) * 8)
    left, least = most, 0
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # a few hundred rows, whatever the input
        left, least = left - r["n"], r["size"]
        if left <= 0:
            break
    return counts.filter(size >= least).orderBy(F.desc("count"), "word").limit(most)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, log10_perplexity) of every text."""
    scratch = Scratch(df.sparkSession, "lm")
    out_of = held_out(F.col(id_col)) if train is None else ~train
    docs = df.select(F.col(id_col).alias("id"), out_of.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    texts = docs.filter("NOT held_out").select("id", "text")
    counts = scratch.keep(texts.select("text").mapInArrow(_count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "counts")
    totals = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    head = _most_frequent(counts, HEAD).collect()  # a fixed number of words
    head_words = np.array([r["word"] for r in head], dtype=np.int64).view(np.uint64)
    lexicon = Lexicon(head_words, np.array([r["count"] for r in head], dtype=np.int64))
    shipped = df.sparkSession.sparkContext.broadcast(lexicon)
    tokens, kinds = int(totals["tokens"]), int(totals["kinds"])
    by_rank = np.bincount(lexicon.ranks, weights=lexicon.counts, minlength=gru.SHORTLIST)
    by_rank[gru.OTHER] = tokens - by_rank[gru.END :].sum()
    bounds = gru.class_bounds(by_rank)
    model = gru.fresh(counts=by_rank, bounds=bounds)
    share = F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS))
    models = models_of(texts.rdd.getNumPartitions(), tokens // ROUNDS)
    for k in range(ROUNDS):
        model = trained(texts.filter(share == k).select("text").coalesce(models), shipped, model, bounds)
    last = df.sparkSession.sparkContext.broadcast((model, bounds))
    rows = scratch.keep(_scored(docs, shipped, last, df.schema[id_col].dataType.simpleString()), "scored")
    last.destroy()
    tail = rows.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("count", F.lit(0)) + 1.0)).alias("tail_logs"), F.count("count").alias("n_tail"))
    short = lexicon.ranks != gru.OTHER
    others = int(totals["tokens"] - lexicon.counts[short].sum()) + int(totals["kinds"] - (lexicon.counts[short] > 0).sum()) + 1
    seen = F.coalesce("tail_logs", F.lit(0.0))
    out = rows.drop("tail").join(tail, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_logs") + seen - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        (F.col("logs") + F.col("other_logs") + seen - F.col("n_other") * float(np.log10(others))).alias("score"),
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))

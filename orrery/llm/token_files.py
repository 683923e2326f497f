"""Token counts of documents in flat token files: 16-bit ids, an end-of-document id behind each document, no index.

Files are read in splits. A task joins the bytes of its split, and searches both alignments of the end id at once, as it can't know yet whether its first
byte is an even one. A prefix scan over the splits of a file (a row each) then gives their offsets, which picks the alignment; the last byte of the split before
and the first of this one are stitched to the id that they may share. A second scan over the same rows carries the last end and the number of documents
across blocks, so that counts of documents that span any number of blocks come out whole.

Cases: an empty document has no tokens; what stands behind the last end is an unfinished document, which is reported with `finished` false; an empty table has no
files and gives no rows; a null text is an empty document; equal rows are documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .shared import Scratch, shuffles_end, table

#: The end-of-document id of files that this module writes: no id of a vocabulary of up to 65535 tokens.
END = 0xFFFF
DOCS_PER_FILE = 20_000
#: Splits are read as rows that end in this byte; it goes back in between.
_BREAK = b"\n"


def hashed_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): the words of each text as 16-bit ids (their hash modulo END), as bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textops.documents(batches, "text"):
            _, _, first, h = textops.words(data, offsets, lower=False)
            ids = (h % np.uint64(END)).astype("<u2")
            yield pa.RecordBatch.from_pydict({"id": rows.column(0), "tokens": pa.array([ids[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())})

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, tokens binary")


def write_token_files(tokens: DataFrame, path: str, shard: Column, shards: int, order: list[Column], end: int = END) -> None:
    """One file and one task for each shard, its documents in order: rows of the text writer that end in the end id's bytes."""
    rows = tokens.withColumn("shard", shard).repartitionById(shards, "shard").sortWithinPartitions("shard", *order)
    separator = end.to_bytes(2, "little").decode("latin-1")
    with shuffles_end(tokens.sparkSession):
        rows.select("shard", F.col("tokens").cast("string").alias("value")).write.partitionBy("shard").option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


def _blocks(end: int):
    """Bytes of splits to their length, edge bytes, and places (in bytes, of the end id's first byte) of both alignments."""

    def block(file: str, split: int, size: int, pieces: list[bytes]) -> dict:
        raw = _BREAK.join(pieces) + _BREAK  # a byte too much behind a file that doesn't end in one
        data = np.frombuffer(raw, dtype=np.uint8)
        places = [np.flatnonzero(data[a : a + (data.size - a) // 2 * 2].view("<u2") == end) * 2 + a for a in (0, 1)]
        return {"file": file, "split": split, "size": size, "bytes": data.size, "first": int(data[0]), "last": int(data[-1]), "even": places[0], "odd": places[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []

        def flush():
            if now is not None:
                b = block(*now, pieces)
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.int64())) if k in ("even", "odd") else pa.array([v]) for k, v in b.items()})

        for batch in batches:
            for value, *block_of in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if now != block_of:
                    yield from flush()
                    now, pieces = block_of, []
                pieces.append(value.as_buffer().to_pybytes())
        yield from flush()

    return run


def count_tokens(spark: SparkSession, path: str, scratch: Scratch, end: int = END) -> DataFrame:
    """(file, doc_index, first_token, n_tokens, finished) of the documents of all files below a folder."""
    text = spark.read.option("lineSep", _BREAK.decode()).option("recursiveFileLookup", "true").text(path)
    pieces = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"))
    blocks = scratch.keep(pieces.mapInArrow(_blocks(end), "file string, split long, size long, bytes long, first long, last long, even array<long>, odd array<long>"), "blocks")
    # both scans are over a row for each split; a file has as many as its bytes make
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("shared", F.lag("last").over(order))
    stitched = (F.col("start") % 2 == 1) & (F.col("shared") + 256 * F.col("first") == end)
    own = F.when(F.col("start") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    ends = F.transform(F.concat(F.when(stitched, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")), own), lambda p: ((p + F.col("start")) / 2).cast("long"))
    inside = F.filter("ends", lambda e: 2 * (e + 1) <= F.col("size"))  # none of the byte behind the file
    at = at.select("file", "split", "size", ends.alias("ends")).withColumn("ends", inside)
    at = at.withColumn("docs_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn("end_before", F.coalesce(F.last(F.try_element_at("ends", F.lit(-1)), ignorenulls=True).over(before), F.lit(-1)))
    starts = F.transform("ends", lambda e, i: F.when(i == 0, F.col("end_before")).otherwise(F.get("ends", i - 1)) + 1)
    each = at.select("file", "docs_before", F.posexplode(F.arrays_zip(starts.alias("a"), F.col("ends").alias("b"))))
    done = each.select("file", (F.col("docs_before") + F.col("pos")).alias("doc_index"), F.col("col.a").alias("first_token"), (F.col("col.b") - F.col("col.a")).alias("n_tokens"), F.lit(True).alias("finished"))
    last = at.groupBy("file").agg(F.sum(F.size("ends")).alias("doc_index"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1)).alias("end"), F.max("size").alias("size"))
    rest = last.select("file", F.col("doc_index").cast("long"), (F.col("end") + 1).alias("first_token"), (F.floor(F.col("size") / 2) - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("finished")).filter("n_tokens > 0")
    return done.unionByName(rest)


def document_token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """(id, n_tokens) of all documents, by way of token files: the place of a document in its file is its rank in the shard.

    Tokens are made twice, for the names of documents and for the files, as that costs less than writing them once more.
    """
    scratch = Scratch(df.sparkSession, "tokens")
    keyed = hashed_ids(df, id_col, text_col).withColumn("key", F.xxhash64("id", "tokens"))
    names = scratch.keep(keyed.select("id", "key"), "names")
    shards = max(1, -(-names.count() // docs_per_file))
    # rows of one id are spread as well, and equal rows may change places
    shard = F.pmod("key", F.lit(shards)).cast("int")
    order = [F.col("id").asc_nulls_last(), F.col("key")]
    write_token_files(keyed, scratch.path("files"), shard, shards, order)
    counted = scratch.keep(count_tokens(df.sparkSession, scratch.path("files"), scratch), "counted")
    scratch.drop_but("names", "counted")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*order)) - 1
    ranked = names.withColumn("shard", shard).select("id", "shard", place.cast("long").alias("doc_index"))
    found = counted.select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("int").alias("shard"), "doc_index", "n_tokens")
    return ranked.join(found, ["shard", "doc_index"]).select(F.col("id").alias(id_col), "n_tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"))

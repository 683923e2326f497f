"""WARC archives: writing with deduplicated payloads, and reading without an index.

Writing. Payloads are grouped by SHA-1 and length; the least page of a group is a response, others are revisits without a block that refer
to it. Records are rows of Spark's text writer with the record end as row separator, so that files are committed as any table's are.

Reading. Files are read in splits, cut at the magic line; each piece is a candidate record, whether the magic begins a record or stands inside a
payload. A task gives each candidate's offset in its split and, by its Content-Length, the offset of its successor. Sums of splits
before give offsets in files. Within a split, pointers are followed to the first offset outside; between splits, pointer jumping from
the file's start doubles the reach each time. Candidates that aren't reached are parts of payloads. Payloads are hashed where a
piece is a whole record; records of several pieces are read again and put together.

Cases: a null payload is empty; empty payloads count as equal payloads, unless `least_bytes` is above 0; a repeated page (equal id and payload) is
written alike each time; a null page id comes last among equals, and is read back as null; a null url leaves out its header;
control characters in urls are left out; an empty table gives an empty archive and no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, join_left, shuffles_end, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 50_000


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: 20 bits at a time, five hexadecimal digits to four others."""
    digits = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(df: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> str:
    """One record for each row of df, in the folder that is returned.

    The first page of each payload is found by digests alone; payloads stay where they are, as the digests that occur more than once are broadcast
    (the most frequent ones, if they are many).
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    pages = pages.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    firsts = pages.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("pages"))
    repeated = scratch.keep(firsts.filter("first IS NOT NULL AND pages > 1"), "repeated")
    dealt = join_left(pages, repeated, ["digest", "bytes"], "pages")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))), F.lit("")),
        F.lit("WARC-Date: 2020-01-01T00:00:00Z\r\n"),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.when(again, F.lit(0).cast("long")).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(again, "").otherwise(F.col("payload")))
    with shuffles_end(df.sparkSession):
        dealt.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(scratch.path("archives"))
    return scratch.path("archives")


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))}


def _page(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits.lstrip(b"-").isdigit() else None


_CANDIDATE = "file string, split long, place long, after long, span long, whole boolean, kind string, page_id long, refers_to long, head_digest string, head_bytes long, bytes long, digest string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (value, file, split) in file order to candidates; place and after count from the first piece of the split."""
    mark, now, at = len(MAGIC), None, 0
    for batch in batches:
        out: dict[str, list] = {x.split(" ")[0]: [] for x in _CANDIDATE.split(", ")}
        for value, file, split in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now != (file, split):
                now, at = (file, split), 0
            piece = value.as_buffer().to_pybytes()
            head, found, rest = piece.partition(b"\r\n\r\n")
            fields = _fields(head) if found else {}
            length = fields.get(b"content-length", b"")
            length = int(length) if length.isdigit() else None
            whole = length is not None and len(rest) in (length, length + len(END))
            payload = rest[:length] if whole else b""
            row = {
                "file": file, "split": split, "place": at - mark, "after": -1 if length is None else at + len(head) + 4 + length + len(END), "span": len(piece) + mark, "whole": whole,
                "kind": fields.get(b"warc-type", b"").decode("utf-8", "replace"), "page_id": _page(fields.get(b"warc-record-id")), "refers_to": _page(fields.get(b"warc-refers-to")),
                "head_digest": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:"), "head_bytes": len(head), "bytes": length,
                "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None,
            }
            at += len(piece) + mark
            for k, v in row.items():
                out[k].append(v)
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_pydict({x.split(" ")[0]: pa.array(out[x.split(" ")[0]], kinds[x.split(" ")[1]]) for x in _CANDIDATE.split(", ")})


def _exits(key: tuple, rows: pa.Table) -> pa.Table:
    """For the candidates of one split: the first offset outside it on their chain. A split has a bounded number of bytes."""
    rows = rows.sort_by([("place", "descending")])
    out: dict[int, int] = {}
    for place, after in zip(rows["place"].to_pylist(), rows["after"].to_pylist(), strict=True):
        out[place] = out.get(after, after)
    return pa.table({"file": rows["file"], "at": rows["place"], "to": pa.array([out[p] for p in rows["place"].to_pylist()], pa.int64())})


def _reached(key: tuple, rows: pa.Table) -> pa.Table:
    """The candidates of one split on the chain from its entry."""
    rows = rows.sort_by([("place", "ascending")])
    want, keep = set(), []
    for i, (place, after, entry) in enumerate(zip(rows["place"].to_pylist(), rows["after"].to_pylist(), rows["entry"].to_pylist(), strict=True)):
        if entry or place in want:
            want.add(after)
            keep.append(i)
    return rows.take(pa.array(keep, pa.int64())).select(["file", "place", "after"])


def boundary_chain(scratch: Scratch, candidates: DataFrame) -> DataFrame:
    """(file, place, after) of real records; candidates: (file, split, place, after) with offsets in files."""
    rows = candidates.select("file", "split", "place", "after")
    exits = scratch.keep(rows.filter("place >= 0").groupBy("file", "split").applyInArrow(_exits, "file string, at long, to long"), "exits")
    # only offsets that a chain enters a split at can be met
    met = exits.select("file", F.col("to").alias("at")).distinct().unionAll(exits.select("file", F.lit(0).cast("long").alias("at")).distinct())
    jump = scratch.keep(exits.join(met.distinct(), ["file", "at"]), "jump-0")
    reach, step = scratch.keep(jump.filter("at = 0").select("file", "at"), "reach-0"), 0
    while True:
        step += 1
        wider = reach.unionAll(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct()
        ahead = jump.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        further = jump.join(ahead, ["file", "to"]).select("file", "at", F.col("next").alias("to"))
        count = reach.count()
        reach = scratch.keep(wider.join(exits.select("file", "at"), ["file", "at"], "left_semi"), f"reach-{step}")
        if reach.count() == count:
            break
        jump = scratch.keep(further, f"jump-{step}")
        scratch.drop(f"jump-{step - 1}", f"reach-{step - 1}")
    entries = reach.select("file", F.col("at").alias("place"), F.lit(True).alias("entry"))
    marked = rows.filter("place >= 0").join(entries, ["file", "place"], "left").select("file", "split", "place", "after", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "split").applyInArrow(_reached, "file string, place long, after long")


def _assembled(key: tuple, rows: pa.Table) -> pa.Table:
    """One record of several pieces: its payload's digest and length."""
    rows = rows.sort_by([("place", "ascending")])
    record = MAGIC.encode().join(v.as_buffer().to_pybytes() for v in rows["value"].combine_chunks())
    head, _, rest = record.partition(b"\r\n\r\n")
    payload = rest[: int(_fields(head)[b"content-length"])]
    return pa.table({"file": pa.array([key[0].as_py()]), "place": pa.array([key[1].as_py()], pa.int64()), "made": pa.array([base64.b32encode(hashlib.sha1(payload).digest()).decode()])})


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(file, place, kind, page_id, refers_to, head_digest, bytes, digest) of each record; digest is of the bytes that were read."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    pieces = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    local = scratch.keep(pieces.mapInArrow(_candidates, _CANDIDATE), "local")
    by_split = local.groupBy("file", "split").agg(F.sum("span").alias("span"))
    before = F.coalesce(F.sum("span").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.keep(by_split.select("file", "split", before.alias("start")), "starts")
    placed = local.join(starts, ["file", "split"]).withColumn("place", F.col("place") + F.col("start")).withColumn("after", F.when(F.col("after") >= 0, F.col("after") + F.col("start")).otherwise(-1))
    placed = scratch.keep(placed.drop("start"), "placed")
    scratch.drop("local")
    chain = scratch.keep(boundary_chain(scratch, placed), "chain")
    records = placed.join(chain.select("file", "place"), ["file", "place"], "left_semi")
    parted = chain.join(placed.filter("NOT whole").select("file", "place"), ["file", "place"], "left_semi")
    if parted.isEmpty():
        return records
    # payloads that hold the magic: their pieces are found by the last record before them, and read again
    owner = F.last(F.when(F.col("real"), F.col("place")), ignorenulls=True).over(Window.partitionBy("file").orderBy("place"))
    owned = placed.select("file", "split", "place", "whole").join(chain.select("file", "place", F.lit(True).alias("real")), ["file", "place"], "left").withColumn("owner", owner)
    owned = owned.join(parted.select("file", F.col("place").alias("owner")), ["file", "owner"], "left_semi")
    owned = scratch.keep(owned.join(starts, ["file", "split"]).select("file", "split", (F.col("place") - F.col("start")).alias("local_place"), "place", "owner"), "owned")
    again = pieces.mapInArrow(_numbered, "value binary, file string, split long, local_place long").join(owned, ["file", "split", "local_place"])
    made = again.select("file", F.col("owner").alias("record"), "place", "value").groupBy("file", "record").applyInArrow(_assembled, "file string, place long, made string")
    return records.join(made, ["file", "place"], "left").withColumn("digest", F.coalesce("digest", "made")).drop("made")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark, now, at = len(MAGIC), None, 0
    for batch in batches:
        place = []
        for value, file, split in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now != (file, split):
                now, at = (file, split), 0
            place.append(at - mark)
            at += len(value.as_buffer()) + mark
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], ["value", "file", "split", "local_place"])


def archived_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact), from archives that were written and read back."""
    scratch = Scratch(df.sparkSession, "warc")
    path = write_archives(df, scratch, id_col, url_col, payload_col, least_bytes)
    records = scratch.keep(read_archives(df.sparkSession, path, scratch).select("kind", "page_id", "refers_to", "head_digest", "bytes", "digest"), "records")
    scratch.drop_but("records")
    asked = records.filter("kind = 'revisit'").groupBy("refers_to", "head_digest").agg(F.count("*").alias("pages"))
    responses = records.filter("kind = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("head_digest"), F.col("bytes").alias("full")).distinct()
    out = join_left(records, scratch.keep(asked.join(responses, ["refers_to", "head_digest"]), "asked"), ["refers_to", "head_digest"], "pages")
    again = F.col("kind") == "revisit"
    return out.select(
        F.col("page_id").alias(id_col), F.when(again, F.col("full")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(again, F.col("head_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to", F.when(again, F.col("full").isNotNull()).otherwise(F.col("digest") == F.col("head_digest")).alias("intact"),
    )


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))

"""WARC archives: writing with revisit records, and reading by verified boundary chains.

Archives are plain text files of Spark's writer: one record a row, the blank lines between records are the line
separator. The reader splits files at every place where a record could begin, which a payload can hold too. Each such
candidate names its successor's offset; pointer jumping from the start of each file keeps those that the chain reaches.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.llm.common import cut_lineage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digits: Column) -> Column:
    """Forty hexadecimal digits in upper-case base32: five of them are four base32 digits."""
    alphabet = F.lit(BASE32)

    def four(part: int) -> list[Column]:
        bits = F.lpad(F.conv(F.substring(digits, part * 5 + 1, 5), 16, 2), 20, "0")
        return [F.substring(alphabet, F.conv(F.substring(bits, k * 5 + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[c for part in range(8) for c in four(part)])


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record for each row of ``pages`` (page_id, url, html): page_id, record_type, refers_to, record (string).

    Of equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response (rows that
    repeat that id all are) and the others are revisits without a block. A null html is an empty payload, a null id is
    written as ``null`` and loses every tie, a null url is empty; line breaks in a url become blanks. Groups of equal
    payloads are reduced to one row each before they are joined.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    # One row a digest, and only digests that repeat: the others are responses. The table is written first, so that its
    # size is known when the join is planned, and the payloads are not shuffled to meet a few digests.
    chosen = cut_lineage(rows.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("d"))
              .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first"))
    marked = rows.join(chosen, F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("first")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return marked.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first")).alias("refers_to"), F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Archives of ``records`` below ``folder``, a file for each partition."""
    records(pages, least_bytes).select("record").write.option("lineSep", END).text(folder)


def _parse(head: bytes) -> dict[bytes, bytes] | None:
    """Header fields (first ones count), or None if a line is no field or a length is missing."""
    fields: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(key.strip().lower(), value.strip())
    return fields if re.fullmatch(rb"\d{1,18}", fields.get(b"content-length", b"")) else None


PIECES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("head", pa.int64()), ("length", pa.int64()),
    ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers", pa.string()),
    ("named_digest", pa.string()), ("named_bytes", pa.int64()), ("digest", pa.string())])
_DDL = ("file string, block bigint, at bigint, size bigint, head bigint, length bigint, type string, record_id string, uri string, "
        "refers string, named_digest string, named_bytes bigint, digest string")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece between two magics says as a record. ``at`` counts from the first piece of its split."""
    split, at = None, 0
    text = lambda fields, key: (v := fields.get(key)) and v.decode("utf-8", "replace")
    for batch in batches:
        out: list[tuple] = []
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece")), strict=True):
            if (file, block) != split:
                split, at = (file, block), 0
            end = piece.find(END.encode())
            fields = _parse(piece[:end]) if end >= 0 else None
            if fields is None:
                out.append((file, block, at, len(piece), *[None] * 9))
            else:
                head, length = end + len(END), int(fields[b"content-length"])
                named = fields.get(b"x-payload-length", b"")
                digest = None
                if head + length <= len(piece):
                    digest = base64.b32encode(hashlib.sha1(piece[head:head + length]).digest()).decode()
                out.append((file, block, at, len(piece), head, length, text(fields, b"warc-type"), text(fields, b"warc-record-id"),
                            text(fields, b"warc-target-uri"), text(fields, b"warc-refers-to"),
                            (text(fields, b"warc-payload-digest") or "").removeprefix("sha1:") or None,
                            int(named) if named.isdigit() else None, digest))
            at += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)]
                                         if out else [pa.array([], t) for t in PIECES.types], schema=PIECES)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """file, block (start of the split), piece (binary): what stands between two magics, in the order of the file."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"))


def reachable(candidates: DataFrame) -> DataFrame:
    """The (file, start) that a chain of (file, start, next) reaches from the least start of each file.

    Pointer jumping: each round doubles the length of every jump and adds the targets of those that are reached, so
    rounds grow with the logarithm of a file's records. Rounds are written to the shared folder.
    """
    starts = candidates.groupBy("file").agg(F.min("start").alias("start"))
    jumps = cut_lineage(candidates.join(candidates.select("file", F.col("start").alias("next")), ["file", "next"], "left_semi")
                        .select("file", "start", "next").where("next > start"))
    found, count = cut_lineage(starts), -1
    while True:
        found = cut_lineage(found.union(found.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))).distinct())
        n = found.count()
        if n == count:
            return found
        count = n
        further = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jumps = cut_lineage(jumps.join(further, ["file", "next"]).select("file", "start", F.col("far").alias("next")))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """file, start, type, record_id, uri, refers, payload_bytes, payload_digest of every record below ``folder``.

    A piece that merely looks like a record (magic in a payload) is no record, because no chain ends at it. A payload
    with magic inside is put together from its pieces before its digest is taken. Revisits have no block; their length
    and digest are those that the record names. Files are read in splits; only offsets and header fields are joined.
    Empty folders give no rows.
    """
    found = cut_lineage(_pieces(spark, folder).mapInArrow(_candidates, _DDL))
    span = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
             .withColumn("base", F.coalesce(F.sum("bytes").over(span), F.lit(0))).select("file", "block", "base"))
    placed = cut_lineage(found.join(bases, ["file", "block"]).withColumn("start", F.col("base") + F.col("at") - len(MAGIC))
                         .withColumn("next", F.col("start") + len(MAGIC) + F.col("head") + F.col("length") + len(END)))
    chained = placed.where("start >= 0 and next is not null")
    kept = cut_lineage(chained.join(reachable(chained), ["file", "start"], "left_semi"))
    broken = kept.where("digest is null").select("file", F.col("start").alias("owner"), "next", "head", "length")
    if not broken.isEmpty():
        kept = _joined_payloads(spark, folder, placed, kept, broken)
    revisit = F.col("type") == "revisit"
    return kept.select(
        "file", "start", "type", "record_id", "uri", "refers",
        F.when(revisit, F.col("named_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("named_digest")).otherwise(F.col("digest")).alias("payload_digest"))


def _joined_payloads(spark: SparkSession, folder: str, placed: DataFrame, kept: DataFrame, broken: DataFrame) -> DataFrame:
    """``kept`` with digests for records whose payload holds magic: their pieces are read again and joined in order.

    A group holds the pieces of one payload, which is one row's text.
    """
    last = F.last("owner", ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    owned = (placed.join(kept.select("file", "start", F.col("start").alias("owner")), ["file", "start"], "left")
             .withColumn("owner", last).join(broken.select("file", "owner"), ["file", "owner"], "left_semi")
             .select("file", "block", "at", "start", "owner"))
    owned = cut_lineage(owned)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            places = []
            for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece")), strict=True):
                if (file, block) != split:
                    split, at = (file, block), 0
                places.append(at)
                at += len(piece) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()),
                                              batch.column("piece")], names=["file", "block", "at", "piece"])

    pieces = (_pieces(spark, folder).mapInArrow(numbered, "file string, block bigint, at bigint, piece binary")
              .join(owned, ["file", "block", "at"]))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"])
    joined = (pieces.groupBy("file", "owner").agg(F.array_join(F.transform(parts, lambda p: F.hex(p)), MAGIC.encode().hex()).alias("digits"))
              .join(broken, ["file", "owner"])
              .select("file", F.col("owner").alias("start"),
                      base32(F.sha1(F.substring(F.unhex("digits"), F.col("head").cast("int") + 1, F.col("length").cast("int")))).alias("late")))
    return kept.join(joined, ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "late")).drop("late")


def page_digests(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` and returns what the archives say of each page."""
    write_archives(pages, folder, least_bytes)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archives(spark, folder).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", page("refers")).alias("refers_to"), "uri")

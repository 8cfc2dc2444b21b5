"""WARC archives of pages: written by Spark, read back with every record
boundary verified.

Writing: one record for each page, the text writer's line ends being the end of
a record, so files are committed (and redone) as any Spark output.  Of pages
with equal payloads the one with the smallest id is a response, the others are
revisits that refer to it.

Reading: files are split at the magic, wherever Spark's splits fall, so a task
sees only pieces between two magics and cannot know which of them begins a
record: a payload may hold a whole record's text.  Each task emits its
candidates (pieces that begin with a header) with the offset of the record
that would follow.  Offsets are sums of piece lengths, within the split by the
task, over splits by a window.  Candidates that follow each other inside a
split form a chain already; from chain to chain, pointer jumping from the start
of each file keeps what is reachable and so rejects every magic inside a
payload.  The number of rounds is the logarithm of the number of splits and
rejected magics that a file has.  Payloads never take part: they are digested
where they are read, and only records whose payload holds a magic are put
together from their pieces.

Defined results: a NULL payload is empty; a NULL id is written without one, is
never a revisit and comes back NULL; rows of one id and one payload are all
responses (or revisits of the same record); a NULL url leaves its field out,
line ends and the magic in one are percent-encoded; payloads of any length and
content are fine; empty tables give archives without a record, which read as
no rows.  Other columns are ignored.  A file that breaks off, garbage after a
record, or a header that itself holds the magic ends that file's chain; the
last reachable record then has ``intact`` false.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .common import utf8, written

# --- fixed values: the format's words
MAGIC = "WARC/1."
VERSION = "1"
LINE = "\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: What a header cannot hold, and what stands for it in a url.
ESCAPES = [("\r", "%0D"), ("\n", "%0A"), (MAGIC, "WARC%2F1.")]
#: Extension field with the id of a page.
PAGE_FIELD = "Page-Id"
CAPTURED = "2024-01-01T00:00:00Z"
#: Records of one file.
FILE_RECORDS = 50_000

PIECE = "file string, block bigint, at bigint, stop bigint, size bigint, next bigint, chain bigint, kind string, record_id string, refers_to string, page_id bigint, uri string, n bigint, digest string"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: each 40 bits are ten hexadecimal digits, eight of base
    32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), HEX32, BASE32)


def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page, digest, first) of pages whose payload a page of smaller id has."""
    known = pages.filter(F.col("page").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("page", base32_sha1(F.col("payload")).alias("digest"))
    known = written(known)
    first = known.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).filter("first < last")
    return known.join(written(first.select("digest", "first")), "digest").filter("page > first").distinct()


def records(pages: DataFrame, min_bytes: int = 0) -> Column:
    """One column ``value``, the record of each page without its last blank
    lines."""
    later = written(revisits(pages, min_bytes)).select(F.col("page").alias("page_"), F.col("digest").alias("digest_"), "first")
    own = pages.withColumn("digest", base32_sha1(F.col("payload")))
    own = own.join(later, (F.col("page") == F.col("page_")) & (F.col("digest") == F.col("digest_")), "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))

    clean = F.col("url")
    for bad, good in ESCAPES:
        clean = F.replace(clean, F.lit(bad), F.lit(good))
    head = F.concat(
        F.lit(f"{MAGIC}{VERSION}{LINE}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page"), F.col("digest"))),
        field("WARC-Target-URI", clean),
        field("WARC-Date", F.lit(CAPTURED)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("first"), F.col("digest")))),
        field(PAGE_FIELD, F.col("page").cast("string")),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return own.select(F.concat(head, F.lit(LINE), block).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """A WARC record for each row, in files under ``path``."""
    plain = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(utf8(payload_col), F.lit(b"")).alias("payload"), F.col(url_col).alias("url"))
    records(plain, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
    return out


_HEAD = re.compile(rb"[01]\r\n")
_LENGTH = re.compile(r"[0-9]{1,15}\Z")
_PAGE = re.compile(r"-?[0-9]{1,19}\Z")


def payload_of(kind: str, block: bytes) -> bytes:
    """What follows the HTTP header of a response, else the whole block."""
    return block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else block


def sha1_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every piece its place in the split; of candidates the header, where
    the next record would begin, and the payload's digest if the piece holds all
    of it.  Pieces of a split come in order."""
    split, at, chain, expected = None, 0, 0, None
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    types = [kinds[x.split()[1]] for x in PIECE.split(", ")]
    for batch in batches:
        rows = []
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, block) != split:
                split, at, chain, expected = (file, block), 0, 0, None
            piece = value.as_py()
            begin, at = at - len(MAGIC), at + len(piece) + len(MAGIC)
            row = dict.fromkeys(names) | {"file": file, "block": block, "at": begin, "stop": at}
            end = piece.find(b"\r\n\r\n") if _HEAD.match(piece) else -1
            fields = fields_of(piece[:end]) if end >= 0 else {}
            length = fields.get("content-length", "")
            # the text before the first magic of a file is no piece of a record
            if _LENGTH.match(length) and "warc-type" in fields and (begin >= 0 or block > 0):
                size = int(length)
                body = piece[end + 4 : end + 4 + size]
                if begin != expected:
                    chain += 1
                expected = begin + len(MAGIC) + end + 4 + size + len(END)
                page = fields.get(PAGE_FIELD.lower(), "")
                row |= {"size": size, "next": expected, "chain": chain, "kind": fields["warc-type"], "record_id": fields.get("warc-record-id")}
                row |= {"refers_to": fields.get("warc-refers-to"), "page_id": int(page) if _PAGE.match(page) and -(1 << 63) <= int(page) < 1 << 63 else None, "uri": fields.get("warc-target-uri")}
                if len(body) == size:
                    payload = payload_of(row["kind"], body)
                    row |= {"n": len(payload), "digest": sha1_of(payload)}
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between magics, in order."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def placed(found: DataFrame) -> DataFrame:
    """Places in the split made places in the file; ``whole`` is the file's
    size."""
    total = found.groupBy("file", "block").agg(F.max("stop").alias("total"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = total.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("base"), (F.sum("total").over(W.partitionBy("file")) - len(MAGIC)).alias("whole"))
    both = found.join(written(base), ["file", "block"])
    return both.withColumns({c: F.col(c) + F.col("base") for c in ("at", "stop", "next")}).drop("base")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, block, chain, entry): chains that the record chain from the start
    of the file runs through, and where it enters them."""
    key = ["file", "block", "chain"]
    ends = candidates.groupBy(*key).agg(F.max("next").alias("exit"))
    to = candidates.select("file", F.col("at").alias("exit"), F.col("block").alias("to_block"), F.col("chain").alias("to_chain"))
    jump = materialize(ends.join(to, ["file", "exit"]).select(*key, "to_block", "to_chain", F.col("exit").alias("entry")))
    seen = materialize(candidates.filter("at = 0").select(*key, F.col("at").alias("entry")))
    n = seen.count()
    while n:
        step = seen.select(*key).join(jump, key).select("file", F.col("to_block").alias("block"), F.col("to_chain").alias("chain"), "entry")
        seen = materialize(seen.unionByName(step).distinct())
        before, n = n, seen.count()
        if n == before:
            break
        over = jump.select("file", F.col("block").alias("to_block"), F.col("chain").alias("to_chain"), F.col("to_block").alias("b"), F.col("to_chain").alias("c"), F.col("entry").alias("e"))
        jump = materialize(jump.drop("entry").join(over, ["file", "to_block", "to_chain"]).select(*key, F.col("b").alias("to_block"), F.col("c").alias("to_chain"), F.col("e").alias("entry")))
    return seen


def owned(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file, at, owner): pieces of the records in ``kept`` that hold a magic;
    ``owner`` is the record's place."""
    wide = kept.filter("digest is null").select("file", "block", F.col("at").alias("owner"), F.col("next").alias("until"))
    some = found.join(wide.select("file").distinct(), "file").select("file", "block", "at")
    starts = kept.select("file", "block", F.col("at"), F.col("at").alias("begin"))
    marked = some.join(starts, ["file", "block", "at"], "left")
    # the last record before a piece, in its split or in an earlier one
    here = F.last("begin", True).over(W.partitionBy("file", "block").orderBy("at"))
    last = starts.groupBy("file", "block").agg(F.max("begin").alias("last"))
    blocks = found.select("file", "block").distinct().join(last, ["file", "block"], "left")
    earlier = F.last("last", True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", earlier.alias("earlier"))
    owner = marked.withColumn("here", here).join(blocks, ["file", "block"]).select("file", "at", F.coalesce("here", "earlier").alias("owner"))
    return owner.join(wide.select("file", "owner", "until"), ["file", "owner"]).filter("at < until").select("file", "at", "owner")


def _placed_pieces(base: DataFrame, path: str) -> DataFrame:
    """(file, at, value) of every piece, read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            places = []
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (file, block) != split:
                    split, at = (file, block), 0
                places.append(at - len(MAGIC))
                at += len(value.as_py()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.int64()), batch.column(2)], ["file", "block", "local", "value"])

    again = pieces(base.sparkSession, path).mapInArrow(run, "file string, block bigint, local bigint, value binary")
    return again.join(base, ["file", "block"]).select("file", (F.col("local") + F.col("base")).alias("at"), "value")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [payload_of(kind, block) for kind, block in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        columns = [*batch.columns[:2], pa.array([len(x) for x in found], pa.int64()), pa.array([sha1_of(x) for x in found]), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["file", "at", "n", "digest", "payload"])


def _bodies(spark: SparkSession, path: str, base: DataFrame, which: DataFrame, own: DataFrame) -> DataFrame:
    """(file, at, n, digest, payload) of the records in ``which``, put together
    from the pieces that ``own`` gives them."""
    parts = _placed_pieces(base, path).join(own, ["file", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("value")))), lambda p: p["value"]), MAGIC)
    whole = parts.groupBy("file", F.col("owner").alias("at")).agg(text.cast("binary").alias("value"))
    both = which.join(whole, ["file", "at"])
    head = F.octet_length(F.substring_index(F.col("value").cast("string"), END, 1)) + len(END)
    block = F.substring(F.col("value"), head + 1, F.col("size").cast("int"))
    return both.select("file", "at", "kind", block.alias("block")).mapInArrow(_digests, "file string, at bigint, n bigint, digest string, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(file, at, kind, record_id, page_id, uri, refers_to, n, digest, intact)
    of every record: its place, header fields, and bytes and SHA-1 of the
    payload that it holds itself.  ``payloads`` adds the payload."""
    found = written(pieces(spark, path).mapInArrow(_candidates, PIECE))
    found = written(placed(found))
    candidates = found.filter("next is not null")
    runs = reachable(candidates)
    kept = candidates.join(runs, ["file", "block", "chain"]).filter("at >= entry")
    known = candidates.select("file", F.col("at").alias("next"), F.lit(True).alias("followed"))
    kept = written(kept.join(known, ["file", "next"], "left").withColumn("intact", F.coalesce("followed", F.col("next") == F.col("whole"))))
    base = written(found.groupBy("file", "block").agg(F.min("at").alias("first")).select("file", "block", (F.col("first") + len(MAGIC)).alias("base")))
    columns = ["file", "at", "kind", "record_id", "page_id", "uri", "refers_to", "n", "digest", "intact"]
    wide = kept.filter("digest is null")
    own = owned(found, kept)
    if payloads:
        own = own.unionByName(kept.filter("digest is not null").select("file", "at", F.col("at").alias("owner")))
        bodies = _bodies(spark, path, base, kept.select("file", "at", "kind", "size"), own)
        return kept.drop("n", "digest").join(bodies, ["file", "at"]).select(*columns, "payload")
    if wide.isEmpty():
        return kept.select(*columns)
    bodies = _bodies(spark, path, base, wide.select("file", "at", "kind", "size"), own).drop("payload")
    mended = wide.drop("n", "digest").join(bodies, ["file", "at"])
    return kept.filter("digest is not null").select(*columns).unionByName(mended.select(*columns))


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): with
    revisits given the payload of the response that they refer to, and its
    page."""
    answers = records.filter("kind = 'response'").groupBy("record_id").agg(F.first("page_id").alias("page"), F.first("n").alias("bytes"), F.first("digest").alias("sha1"))
    answers = written(answers).withColumnRenamed("record_id", "refers_to")
    both = records.join(answers, "refers_to", "left")
    return both.select(
        "page_id",
        F.when(F.col("kind") == "revisit", F.col("bytes")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("page").alias("refers_to"),
    )

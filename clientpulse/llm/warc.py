"""WARC archives of pages, written by Spark and read back along verified record boundaries.

Writing: pages with equal payloads share one response record, the others become revisit records that refer to it. Records are text
rows whose separator closes them, so each task writes its own archives.

Reading: archives are split at every occurrence of the record magic, wherever Spark cuts the file. A split knows only how many bytes
its pieces take; sums over the splits of a file give absolute offsets. Each piece is a candidate record whose header names its
successor's offset. Pointer jumping from the start of each file, twice as far in every round, keeps the reachable candidates, so
magic inside a payload never starts a record. A payload that holds magic is put together again from the pieces it was cut into.

Null html is the empty payload. Pages with the same id are separate records, each with its own payload; those with the largest id of a
payload are all responses. A page with a null id is always a response, and nothing refers to it. An empty table writes no record and reads back as no row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientpulse.session import materialize, scratch_path

MAGIC, CRLF = "WARC/1.1\r\n", "\r\n"
RECORDS_PER_FILE = 20_000
_DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _hex_to_base32(hex_digest: F.Column) -> F.Column:
    """Base32 of a hex number of 40 digits: five hex digits are twenty bits, four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for part in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * part + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """One record per page. Of equal payloads of at least ``min_revisit_bytes`` that with the largest id is the response.

    Only digests are shuffled to find the groups; pages meet the answer for revisits by id, a broadcast when Spark finds it small.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = own.select("page_id", F.octet_length("html").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("digest")).where(F.col("size") >= min_revisit_bytes)
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    later = digests.join(shared, "digest").where(F.coalesce(F.col("page_id") < F.col("first"), F.lit(False)))
    later = later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_same"), F.col("first").alias("_first")).distinct()
    later = materialize(later, "revisits")
    # an id may stand for several payloads, so a revisit is told by both
    rows = own.join(later, (own["page_id"] == later["_page"]) & (F.sha2(own["html"].cast("binary"), 256) == later["_same"]), "left")
    revisit = F.col("_first").isNotNull()
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))

    def name(i: F.Column) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))

    head = F.concat_ws(
        CRLF,
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), _hex_to_base32(F.sha1(F.col("html").cast("binary")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("_first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(F.lit(MAGIC), head, F.lit(CRLF + CRLF), block)
    writer = rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("compression", "none").text(path)


_PIECES = "file string, block long, place long, size long, header string, length long, next long, digest string, payload_bytes long, rest binary"


def _cut(keep_all: bool):
    """Header and successor of each piece, at its place within the split; with ``keep_all`` its bytes and nothing else."""

    def row(raw: bytes, at: int) -> tuple:
        head, found, body = raw.partition(b"\r\n\r\n")
        declared = re.search(rb"(?:^|\r\n)Content-Length: *(\d{1,18})(?:\r\n|$)", head) if found else None
        if keep_all or declared is None:
            return None, None, None, None, None, raw if keep_all else None
        length = int(declared[1])
        following = at + len(MAGIC) + len(head) + 4 + length + 4
        if len(body) != length + 4:
            return head.decode("utf-8", "replace"), length, following, None, None, None
        payload = body[:length].partition(b"\r\n\r\n")[2]
        return head.decode("utf-8", "replace"), length, following, _digest(payload), len(payload), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
                raw = value.as_py()
                if (file, block) != split:
                    split, place = (file, block), 0
                # the magic that ends a piece starts the next one: a piece begins where its own magic did
                rows.append((file, block, place - len(MAGIC), len(raw) + len(MAGIC), *row(raw, place - len(MAGIC))))
                place += len(raw) + len(MAGIC)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _before(pieces: DataFrame) -> DataFrame:
    """Bytes that the earlier splits of a file took; one small row per split."""
    taken = pieces.groupBy("file", "block").agg(F.sum("size").alias("taken"))
    pairs = taken.alias("a").join(taken.alias("b"), "file").where("b.block < a.block")
    return pairs.groupBy("file", F.col("a.block").alias("block")).agg(F.sum("b.taken").alias("before"))


def _absolute(pieces: DataFrame, before: DataFrame) -> DataFrame:
    rows = pieces.join(before, ["file", "block"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    rows = rows.withColumns({"at": F.col("before") + F.col("place"), "next": F.col("before") + F.col("next")})
    return rows.drop("before", "block", "place").where("at >= 0")


def reachable(candidates: DataFrame) -> DataFrame:
    """The (file, at) that the chain at -> next reaches from 0, by pointer jumping.

    After round k every reached record within 2^k steps of the start is known and pointers lead 2^k steps on.
    """
    jump = materialize(candidates.select("file", "at", "next"), "jump")
    nodes = jump.select("file", "at")
    known = materialize(jump.where("at = 0").select("file", "at"), "known")
    count = known.count()
    while True:
        further = known.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(nodes, ["file", "at"])
        known = materialize(known.unionByName(further).distinct(), "known")
        now = known.count()
        if now == count:
            return known
        count = now
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = materialize(jump.join(onward, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jump")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (as computed), named_digest, record_type, refers_to and url of every record."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = materialize(raw.mapInArrow(_cut(False), _PIECES), "pieces")
    before = _before(pieces)
    pieces = _absolute(pieces, before)
    found = pieces.join(reachable(pieces.where("next is not null")), ["file", "at"])
    whole = found.where("digest is not null").select("header", "digest", "payload_bytes")
    torn = found.where("digest is null")
    if not torn.isEmpty():
        whole = whole.unionByName(_mended(raw, before, pieces, found))

    def field(label: str) -> F.Column:
        return F.regexp_extract("header", rf"(?:^|\r\n){label}: *([^\r]*)", 1)

    refers = F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return whole.select(
        F.expr("try_cast(regexp_extract(header, 'WARC-Record-ID: *<urn:page:(-?[0-9]+)>', 1) as bigint)").alias("page_id"),
        F.when(field("WARC-Type") == "response", F.col("payload_bytes")).alias("payload_bytes"),
        F.when(field("WARC-Type") == "response", F.col("digest")).alias("payload_digest"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("named_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
    )


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("at")
    first = frame.iloc[0]
    raw = MAGIC.encode().join(bytes(r) for r in frame["rest"])
    head, _, body = raw.partition(b"\r\n\r\n")
    payload = body[: int(first["length"])].partition(b"\r\n\r\n")[2]
    return pd.DataFrame({"header": [head.decode("utf-8", "replace")], "digest": [_digest(payload)], "payload_bytes": [len(payload)]})


def _mended(raw: DataFrame, before: DataFrame, pieces: DataFrame, found: DataFrame) -> DataFrame:
    """Records whose payload holds magic, from the pieces up to the next record; only their pieces are read again and moved.

    A piece belongs to the last record at or before it. The window runs over offsets within one file, no bytes.
    """
    records = found.select("file", "at", F.col("at").alias("start"), F.when(F.col("digest").isNull(), F.col("length")).alias("torn"))
    in_file = Window.partitionBy("file").orderBy("at")
    owned = pieces.select("file", "at").join(records, ["file", "at"], "left")
    owned = owned.withColumn("record", F.last(F.when(F.col("start").isNotNull(), F.struct("start", "torn")), ignorenulls=True).over(in_file))
    owned = owned.where("record.torn is not null").select("file", "at", F.col("record.start").alias("start"), F.col("record.torn").alias("length"))
    again = _absolute(raw.mapInArrow(_cut(True), _PIECES), before).select("file", "at", "rest").join(owned, ["file", "at"])
    return again.groupBy("file", "start").applyInPandas(_joined, "header string, digest string, payload_bytes long")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back and answer for every page: sizes and digests of the full payload, also for revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    records = materialize(read_archives(spark, path), "records")
    sizes = records.where("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    revisits = records.where("record_type = 'revisit'").join(sizes, (F.col("refers_to") == F.col("_id")) & (F.col("named_digest") == F.col("_digest")), "left")
    revisits = revisits.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("named_digest")})
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return records.where("record_type = 'response'").select(columns).unionByName(revisits.select(columns))

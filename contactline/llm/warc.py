"""WARC archives: writing with revisit records, and reading back by verified record boundaries.

Archives are uncompressed WARC 1.1, one or more records per file, written by Spark's text sink (a
record's end is the line separator) and read by byte ranges with the version line as separator, so
both work on any store that Spark reaches, and a file of any size is read by many tasks.

The version line may also stand inside a payload. Each task therefore only emits candidates: the
offset of a version line and the offset at which a record that begins there would end. Chains of
candidates are shortened inside each byte range, pointer jumping from offset 0 over the shortened
chains finds where each range is entered, and only candidates on that path are records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactline.runtime import materialise

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Distinct repeated payloads whose digests (20 bytes each) may be sent to every task.
BROADCAST_ROWS = 50_000


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 20 bits at a time."""
    parts = [
        F.lpad(F.conv(F.substring(sha1_hex, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)
    ]
    # Spark writes base 32 with the digits 0-9A-V.
    return F.translate(
        F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """A header line; line breaks in values are escaped."""
    value = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes ``page_id, url, html`` as one record each.

    Null html is an empty payload, null urls and page_ids have no header. Of equal payloads of
    ``least_bytes`` at least, the one with the largest page_id is a response and the others are
    revisits of it (rows that repeat this page_id are responses too, rows without page_id revisit).
    An empty table makes an archive without records.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    repeated = materialise(
        pages.where(F.col("bytes") >= least_bytes).groupBy(F.unhex("sha1").alias("_sha1")).agg(
            F.max("page_id").alias("first_id"), F.count("*").alias("_n")
        ).where("_n > 1").select("_sha1", "first_id"),
        "repeated_payloads")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    own = (F.unhex("sha1") == F.col("_sha1")) & (F.col("bytes") >= least_bytes)
    pages = pages.join(repeated, own, "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(GAP))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.coalesce(urn("page_id"), F.lit("<urn:page:>"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _header("WARC-Refers-To", F.when(revisit, urn("first_id"))),
        _header("WARC-Profile", F.when(
            revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(GAP),
    )
    pages.select(F.concat(head, body).alias("value")).write.option("lineSep", GAP).text(folder)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """``file, block, i, value``: what follows each version line (and what precedes the first), in
    the order of ``i`` inside a byte range. ``i`` is the same in each scan of the same files."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), "value",
    )


def _parsed(value: str) -> list[Column]:
    """``head``, ``length`` (of the record's block), and ``read`` if the block is whole."""
    head = F.when(F.instr(value, GAP) > 0, F.substring_index(value, GAP, 1))
    length = F.regexp_extract(
        F.concat(F.lit("\r\n"), head), r"(?i)\r\nContent-Length: *(\d{1,18})(?:\r\n|$)", 1
    ).try_cast("long")
    whole = F.octet_length(value) == F.octet_length(head) + 2 * len(GAP) + length
    body = F.substring(
        F.col(value).cast("binary"), F.octet_length(head) + len(GAP) + 1, length.cast("int"))
    return [
        head.alias("head"), length.alias("length"), F.when(whole, _payload(body)).alias("read")]


def _candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What each version line is followed by, without payloads; and of each its offset ``at`` and
    the offset ``next`` at which a record that begins there would end (null: no record can)."""
    read = materialise(
        _scan(spark, folder).select(
            "file", "block", "i", F.octet_length("value").cast("long").alias("size"),
            *_parsed("value")),
        "candidates")
    # Where a line begins: sizes of the byte ranges before, then of the lines before in the range.
    step = F.col("size") + len(MAGIC)
    ranges = read.groupBy("file", "block").agg(F.sum(step).alias("sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "file", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    above = (
        Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    span = F.octet_length("head") + 2 * len(GAP) + len(MAGIC) + F.col("length")
    offsets = read.select(
        "file", "block", "i", span.alias("span"),
        F.coalesce(F.sum(step).over(above), F.lit(0)).alias("inside"),
    ).join(ranges, ["file", "block"]).select(
        "file", "block", "i", "span",
        (F.col("before") + F.col("inside") - len(MAGIC)).alias("at"),
    ).where("at >= 0").select("file", "block", "i", "at", (F.col("at") + F.col("span")).alias("next"))
    return read, materialise(offsets, "offsets")


def _payload(body: Column) -> Column:
    """Digest and size of the payload after the HTTP header of a record's block."""
    text = body.cast("string")
    http = F.octet_length(F.substring_index(text, GAP, 1)) + len(GAP)
    payload = F.substring(body, http + 1, F.octet_length(body))
    return F.struct(
        F.substring_index(text, GAP, 1).alias("http"), F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("bytes"))


def _leaving(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each candidate of a byte range, where its chain leaves the candidates of the range."""
    rows = rows.sort_values("at")
    ends: dict[int, int] = {}
    for at, after in zip(rows["at"].to_numpy()[::-1], rows["next"].to_numpy()[::-1], strict=True):
        if after == after:  # not null
            ends[int(at)] = ends.get(int(after), int(after))
    return pd.DataFrame(
        {"file": rows["file"].iloc[0], "at": list(ends), "next": list(ends.values())})


def _following(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a byte range that its entry leads to."""
    after = dict(zip(rows["at"], rows["next"], strict=True))
    found = []
    for at in rows.loc[rows["entry"], "at"]:
        while at in after and after[at] == after[at]:
            found.append(int(at))
            at = after[at]
    return pd.DataFrame({"file": rows["file"].iloc[0], "at": found})


def _records(offsets: DataFrame) -> DataFrame:
    """``file, at`` of candidates that a chain from the file's start reaches."""
    jumps = materialise(
        offsets.select("file", "block", "at", "next").groupBy("file", "block").applyInPandas(
            _leaving, "file string, at long, next long"), "jumps")
    reached = offsets.where("at = 0").select("file", "at")
    n = -1
    while n != (n := reached.count()):
        reached = materialise(
            reached.union(reached.join(jumps, ["file", "at"]).select("file", "next")).distinct(),
            "reached")
        far = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("_far"))
        jumps = materialise(
            jumps.join(far, ["file", "next"]).select("file", "at", F.col("_far").alias("next")),
            "jumps")
    entries = reached.select("file", "at", F.lit(True).alias("entry"))
    marked = offsets.join(entries, ["file", "at"], "left").select(
        "file", "block", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "block").applyInPandas(_following, "file string, at long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, record_type, payload_bytes, payload_digest, refers_to`` of each record.

    Size and digest of a response are those of the payload as read, of a revisit those of its
    headers. Bytes after the last record that can be reached are ignored, as is a record that the
    end of its file cuts.
    """
    read, offsets = _candidates(spark, folder)
    records = materialise(_records(offsets), "records")
    real = records.select("file", "at", F.lit(True).alias("real"))
    found = offsets.join(real, ["file", "at"]).join(
        read.select("file", "block", "i", "head", "read"), ["file", "block", "i"])
    found = materialise(found.select("file", "at", "next", "head", "read"), "found")
    whole = found.where("read is not null").select("head", "read")
    broken = found.where("read is null").select("file", "at", "next")
    if not broken.isEmpty():
        whole = whole.union(_joined(spark, folder, offsets, real, broken))
    field = lambda name: F.nullif(F.regexp_extract(
        F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n")), rf"(?i)\r\n{name}: *([^\r]*)\r", 1),
        F.lit(""))
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    kind = field("WARC-Type")
    size = F.regexp_extract("read.http", r"(?i)\r\nContent-Length: *(\d+)", 1).try_cast("long")
    return whole.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(kind == "revisit", size).otherwise(F.col("read.bytes")).alias("payload_bytes"),
        F.when(kind == "revisit", F.substring_index(field("WARC-Payload-Digest"), ":", -1))
        .otherwise(base32(F.col("read.sha1"))).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", page("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
    )


def _joined(
    spark: SparkSession, folder: str, offsets: DataFrame, real: DataFrame, broken: DataFrame
) -> DataFrame:
    """``head, read`` of records in whose payloads the version line stands: a second scan gathers
    the pieces of each."""
    order = Window.partitionBy("file").orderBy("at")
    owned = offsets.join(real, ["file", "at"], "left").select(
        "file", "block", "i", "at",
        F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(order).alias("owner"))
    ends = broken.select("file", F.col("at").alias("owner"), "next")
    keys = materialise(
        owned.join(ends, ["file", "owner"]).where("at < next").select(
            "file", "block", "i", "at", "owner"), "pieces")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    pieces = _scan(spark, folder).join(keys, ["file", "block", "i"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("all"))
    joined = pieces.select(F.array_join(F.transform("all", lambda p: p["value"]), MAGIC).alias("value"))
    return joined.select(*_parsed("value")).where("read is not null").select("head", "read")


#: DuckDB SQL for what ``pages`` give when they are written and read back.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""

"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
# Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, content_type string, headers map<string,string>, block binary, payload binary"
)


def _id(kind: str, *key: str) -> Column:
    """A record id made from the capture's key."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, block: Column, **headers: Column) -> Column:
    """A whole record but for its last two line ends; null headers are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = {"WARC-Type": kind, "WARC-Date": F.lit(DATE), **{k.replace("_", "-"): v for k, v in headers.items()}}
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in named.items()]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit(VERSION), F.concat_ws("", *lines), size, block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for every page.

    The text writer's line separator is the end of a WARC record, so each part file is a
    gzip-compressed archive, committed by Spark. Of equal payloads of at least
    ``REVISIT_BYTES`` the row with the largest id (of equal ids, one) is the response.
    """
    p = pages.select(
        F.col(id_col).alias("page_id"),
        # control characters and blanks cannot stand in a header
        F.regexp_replace(F.col(url_col), "[\\x00-\\x20\\x7f]", "%20").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("row", F.monotonically_increasing_id())
    p = p.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    large = p.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    p = p.join(large.where(F.col("n") > 1).select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    p = p.withColumns({"first_page": F.col("first.page_id"), "first_row": F.col("first.row")})

    response_id = _id("response", "page_id", "row")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    path_part = F.coalesce(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lit("/"))
    request = _record(
        "request",
        F.concat(F.lit("GET "), F.when(path_part == "", "/").otherwise(path_part), F.lit(" HTTP/1.1\r\n\r\n")),
        WARC_Record_ID=_id("request", "page_id", "row"),
        WARC_Target_URI=F.col("url"),
        WARC_Concurrent_To=response_id,
        Content_Type=F.lit("application/http; msgtype=request"),
    )
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
        WARC_Record_ID=response_id,
        WARC_Target_URI=F.col("url"),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
        WARC_Refers_To=F.when(revisit, _id("response", "first_page", "first_row")),
        WARC_Profile=F.when(revisit, PROFILE),
        Content_Type=F.lit("application/http; msgtype=response"),
    )
    metadata = _record(
        "metadata",
        F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("size").cast("string"))),
        WARC_Record_ID=_id("metadata", "page_id", "row"),
        WARC_Target_URI=F.col("url"),
        WARC_Concurrent_To=response_id,
        Content_Type=F.lit("application/warc-fields"),
    )
    records = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _parsed(pieces: Iterator[bytes], mark: bytes) -> Iterator[dict]:
    """Records from the pieces between version lines; a block that holds one is put together again."""
    end = END.encode()
    for piece in pieces:
        if not piece.strip():
            continue
        while (head := piece.find(end)) < 0:
            piece += mark + next(pieces)
        headers = {}
        for line in piece[:head].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        start = head + len(end)
        while len(piece) < start + size:
            more = next(pieces, None)
            if more is None:
                raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
            piece += mark + more
        block = piece[start : start + size]
        http = headers.get("content-type", "").startswith("application/http")
        yield {
            "record_id": headers.get("warc-record-id"),
            "type": headers.get("warc-type"),
            "target_uri": headers.get("warc-target-uri"),
            "date": headers.get("warc-date"),
            "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"),
            "payload_digest": headers.get("warc-payload-digest"),
            "content_type": headers.get("content-type"),
            "headers": list(headers.items()),
            "block": block,
            "payload": block[block.find(end) + len(end) :] if http and end in block else b"" if http else block,
        }


def read_records(spark: SparkSession, path: str, version: str = VERSION, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives in a folder.

    Spark's text reader cuts the files, compressed or not, at version lines; each task then
    goes through its records one by one and holds no more than ``batch_bytes`` and a record.
    A record that ends too early is an error.
    """
    kinds = [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("payload", pa.binary())]
    names = [part.split(" ")[0] for part in RECORD.split(", ")]
    schema = pa.schema([pa.field(n, dict(kinds).get(n, pa.string())) for n in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for record in _parsed((v for b in batches for v in b.column(0).to_pylist()), version.encode()):
            held.append(record)
            size += 2 * len(record["block"])
            if size >= batch_bytes:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    pieces = spark.read.option("lineSep", version).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value")).mapInArrow(parse, RECORD)


def captures(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One nested row per capture.

    A request or metadata record joins the response or revisit that its concurrent-to
    identifier names. A row has ``capture_id``, ``record`` (null if no response was found)
    and the lists ``requests`` and ``metadata``, empty where there are none. Records of
    other types are left out. A revisit's ``payload_bytes`` and ``payload_sha1`` are those
    of the response that it refers to, whose identifier is in ``record.refers_to``; they
    are null if that response is missing. A table without records gives no rows.
    """
    full = records.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_sha1": F.sha1("payload")}
    )
    own = full.where(F.col("type").isin("response", "revisit"))
    fields = ["record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "content_type", "headers"]
    fields += ["block", "payload"] if keep_payload else []
    first = F.struct(*fields, "payload_bytes", "payload_sha1").alias("record")
    own = own.select(F.col("record_id").alias("capture_id"), first)
    side = full.where(F.col("type").isin("request", "metadata"))
    part = F.struct("record_id", "target_uri", "headers", F.col("block").cast("string").alias("text"))
    side = side.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.collect_list(F.when(F.col("type") == "request", part)).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", part)).alias("metadata"),
    )
    rows = own.join(side, "capture_id", "full")
    empty = F.array().cast(side.schema["requests"].dataType)
    return rows.withColumns({"requests": F.coalesce("requests", empty), "metadata": F.coalesce("metadata", empty)})


def resolved(rows: DataFrame, *keep: str) -> DataFrame:
    """Captures with ``payload_bytes``, ``payload_sha1`` and the columns ``first_<k>`` of the response a revisit names."""
    plain = rows.where(F.coalesce(F.col("record.type"), F.lit("")) != "revisit")
    again = rows.where(F.col("record.type") == "revisit")
    firsts = plain.select(
        F.col("capture_id").alias("first_id"), F.col("record.payload_bytes"), F.col("record.payload_sha1"), *[F.col(k).alias(f"first_{k}") for k in keep]
    )
    again = again.join(firsts, F.col("record.refers_to") == F.col("first_id"), "left").drop("first_id")
    plain = plain.withColumns({"payload_bytes": F.col("record.payload_bytes"), "payload_sha1": F.col("record.payload_sha1")})
    nothing = {f"first_{k}": F.lit(None).cast(rows.schema[k].dataType) for k in keep}
    return plain.withColumns(nothing).unionByName(again)


def page_id(rows: DataFrame) -> Column:
    """The page id that ``write_archive`` put into the metadata record."""
    text = F.get(F.col("metadata"), F.lit(0))["text"]
    return F.regexp_extract(text, "pageId: (-?[0-9]+)", 1).try_cast("bigint")

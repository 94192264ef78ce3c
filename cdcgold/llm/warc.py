"""WARC archives: written by Spark's text sink, read back and joined to one row per capture.

A record is a row whose text ends in the record separator, so the archives need no file access
outside Spark.  Every capture has a request, a response or revisit, and a metadata record; request
and metadata name the response in WARC-Concurrent-To, and a revisit names the response whose
payload it repeats in WARC-Refers-To.

Of captures with equal payloads of `MIN_REVISIT` bytes or more, that with the largest key (then
URL) holds the payload.  Defined cases: a null payload is empty; a null key or URL stays null (a
null key is below all others); line breaks in a URL are percent-encoded in the header, the metadata
record has it as it was; rows that are equal in key, URL and payload are equal records, read back as
often as they were written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cdcgold.session import materialise, scratch, workspace

CRLF = "\r\n"
MIN_REVISIT = 1000
#: Records of one archive, and about the bytes it may have: a file is read as a whole.
RECORDS = 6000
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + " "), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record without the two line breaks that end it; null fields are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(CRLF))
    lines = [F.coalesce(F.concat(F.lit(name + ": "), v, F.lit(CRLF)), F.lit("")) for name, v in fields]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(head, F.lit(f"WARC-Date: {DATE}{CRLF}"), *lines, size, body)


def write(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html"
) -> None:
    """Archives of all rows in the folder `path`."""
    rows = pages.select(
        F.col(page_id).cast("string").alias("key"), F.col(page_id).alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    capture = F.to_json(F.struct("key", "url", "digest"), {"ignoreNullFields": "false"})
    rows = rows.withColumn("capture", capture)
    best = F.max(F.struct("id", "url", "capture"))
    # only payloads that come more than once have a row here, known in size before the join
    seen = Observation()
    measured = rows.observe(seen, F.max("bytes").alias("largest"))
    first = measured.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes")
    first = first.agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialise(first.select("digest", "bytes", F.col("best.capture").alias("holder")), "payloads")
    rows = rows.join(first, ["digest", "bytes"], "left")
    again = F.col("holder").isNotNull() & (F.col("holder") != F.col("capture"))
    to = _urn("response", F.col("capture"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", to),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(again, PROFILE)),
            ("WARC-Refers-To", F.when(again, _urn("response", F.col("holder")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(again, "").otherwise(F.col("payload"))),
    )
    request = _record(
        "request",
        [
            ("WARC-Record-ID", _urn("request", F.col("capture"))),
            ("WARC-Target-URI", target),
            ("WARC-Concurrent-To", to),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = _record(
        "metadata",
        [
            ("WARC-Record-ID", _urn("metadata", F.col("capture"))),
            ("WARC-Target-URI", target),
            ("WARC-Concurrent-To", to),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("capture: "), "capture", F.lit(CRLF)),
    )
    lines = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # as many as fit even if all were as large as the largest; a capture more than that has a file of its own
    per_file = min(RECORDS, 3 * max(1, ARCHIVE_BYTES // ((seen.get["largest"] or 0) + 4096)))
    lines.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers (names in lower case, "" the version), and where the block begins and ends."""
    at, n = 0, len(data)
    while at < n:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= n:
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        version, *lines = data[at:stop].decode("utf-8", "replace").split(CRLF)
        head = {"": version}
        for line in lines:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        begin = stop + 4
        end = begin + int(head["content-length"])
        if end > n:
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, begin, end
        at = end


_FIELDS = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri")
_NAMES = ("kind", "record_id", "concurrent_to", "refers_to", "uri")


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record: its links, and size, SHA-1 and bytes of the HTTP payload or block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                data = value.as_buffer().to_pybytes()
                out, size = [], 0
                for head, begin, end in parse(data):
                    if head.get("content-type", "").startswith("application/http"):
                        cut = data.find(b"\r\n\r\n", begin, end)
                        begin = end if cut < 0 else cut + 4
                    body = data[begin:end]
                    size += len(body)
                    sha = hashlib.sha1(body, usedforsecurity=False).hexdigest()
                    keep = with_payload or head["warc-type"] == "metadata"
                    out.append([*map(head.get, _FIELDS), head.get("warc-payload-digest"), len(body), sha, body if keep else None])
                    if size > 8 << 20:
                        yield table(out)
                        out, size = [], 0
                if out:
                    yield table(out)

    def table(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
            [*_NAMES, "said_digest", "bytes", "sha1", "body"],
        )

    files = spark.read.format("binaryFile").load(path).select("content")
    schema = ", ".join(f"{n} string" for n in _NAMES) + ", said_digest string, bytes long, sha1 string, body binary"
    return files.mapInArrow(run, schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit with its request and metadata, if there are any.

    A record that is there several times counts once as request or metadata.
    """
    part = F.struct("record_id", "uri", "bytes", "sha1", "body")
    main = records.filter(F.col("kind").isin("response", "revisit"))
    main = main.select(
        "record_id", "kind", "uri", "refers_to", F.struct("record_id", "uri", "bytes", "sha1", "said_digest", "body").alias("response")
    )
    for kind in ("request", "metadata"):
        own = records.filter(F.col("kind") == kind).filter("concurrent_to is not null")
        own = own.select(F.col("concurrent_to").alias("record_id"), part.alias(kind)).dropDuplicates(["record_id"])
        main = main.join(own, "record_id", "left")
    return main


def round_trip(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all rows, read the archives, and report each capture by its key.

    Archives stay where a path is given; without one they go once they have been read.
    """
    spark = pages.sparkSession
    with scratch(spark) as keep_report:
        with scratch(spark) as keep_records:
            path = path or workspace(spark, "archives")
            write(pages, path, page_id, url, payload)
            # archives are parsed once; what is kept of a record has no payload
            parsed = keep_records(records(spark, path, with_payload=False), "records")
        kind = pages.schema[page_id].dataType.simpleString()
        return keep_report(_report(materialise(captures(parsed), "captures"), kind), "round-trip")


def _report(rows: DataFrame, kind: str) -> DataFrame:
    said = F.from_json(F.regexp_extract(F.col("metadata.body").cast("string"), r"^capture: (.*)\r\n$", 1), "key string, url string")
    rows = rows.select(
        "record_id", "kind", "refers_to", "response.bytes", "response.sha1", "response.said_digest",
        said["key"].cast(kind).alias("page_id"), said["url"].alias("url"),
    )
    # only revisits look for another record; those they name, each once, are a written table, so
    # that the join with one which many revisits name can be broadcast or split
    revisits = rows.filter("kind = 'revisit'")
    held = rows.filter("kind = 'response'").join(revisits.select(F.col("refers_to").alias("record_id")), "record_id", "left_semi")
    held = held.select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), F.col("bytes").alias("b"), F.col("sha1").alias("s")
    )
    held = materialise(held.dropDuplicates(["refers_to"]), "referred")
    own = ["page_id", "kind", "bytes", "sha1", "url"]
    found = revisits.join(held, "refers_to", "left").select(*own, "to", "b", "s")
    rows = rows.filter("kind = 'response'").select(*own).unionByName(found, allowMissingColumns=True)
    return rows.select(
        "page_id",
        F.coalesce("b", "bytes").alias("payload_bytes"),
        F.coalesce("s", "sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("to").alias("refers_to"),
        "url",
    )

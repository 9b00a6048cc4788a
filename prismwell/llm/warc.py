"""WARC archives: writing, reading, and resolving revisits of equal payloads.

Archives are written by Spark's text writer: a record ends with an empty line, twice CR LF, which is
the writer's line separator; its committer keeps files of lost tasks out. A file holds a bounded
number of records. Reading parses by Content-Length, as a stream, plain or gzip (also one member per
record). Headers alone are shuffled to find equal payloads; payloads move only as compressed
archives, next to the decisions about their records.

Edge cases: a null payload is empty; null ids and urls have no header and come back null; payloads
under ``min_bytes`` are never resolved; of repeated rows the first in the archive is the response;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, scratch_path, text_bytes

RECORDS_PER_FILE = 1000
#: Payload bytes that a reader hands on at a time.
BATCH_BYTES = 4 << 20
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "archive string, ordinal long, warc_type string, record_id string, uri string, refers_to string, payload_digest string, row_id string, payload_bytes long, payload binary"


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the one string column of ``records``, each a record without its final empty lines."""
    records.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path, compression="gzip")


def response_records(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url", date: str | None = None) -> DataFrame:
    """A response record per row, its payload the column's UTF-8 bytes."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.regexp_replace(F.col(url).cast("string"), r"[\r\n]+", " ").alias("url"), text_bytes(payload).alias("body"))
    rows = rows.withColumn("n", F.octet_length("body")).withColumn("digest", F.sha2("body", 256))
    unique = F.md5(F.concat_ws("|", "id", "url", "digest", F.monotonically_increasing_id()).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(unique, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    http = F.concat(F.lit(_http(0).decode().split("Content-Length")[0] + "Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2))
    lines = [
        F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.lit(f"WARC-Date: {date or _now()}"), F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.concat(F.lit("X-Row-ID: "), F.col("id")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.col("n")).cast("string")),
    ]
    head = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), http)  # concat_ws leaves out null lines
    return rows.select(F.concat(head.cast("binary"), F.col("body")).cast("string").alias("value"))


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, one at a time."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its Content-Length")
        yield head, block


def _payload(head: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives at ``path``; a response's payload is checked by its digest."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _READ.split(", ")]
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, held = [], 0
                for k, (head, block) in enumerate(parse_archive(content)):
                    body = _payload(head, block)
                    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if head.get("warc-type") == "response" and digest not in (None, hashlib.sha256(body).hexdigest()):
                        raise ValueError(f"{archive}, record {k}: the payload does not match its digest")
                    rows.append((archive, k, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, head.get("x-row-id"), len(body), body if with_payload else None))
                    held += len(body) if with_payload else 0
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parsed, _READ)


def resolve_revisits(spark, source: str, target: str, min_bytes: int = 100, date: str | None = None, id_type: str = "long") -> None:
    """Read the archives at ``source`` and write them to ``target`` with repeated payloads as revisits.

    Of the records with one payload of ``min_bytes`` or more, that with the least row id (nulls
    last, then the first in the archives) stays a response, the others refer to it.
    """
    heads = cut(read_archives(spark, source, with_payload=False).drop("payload"))
    rank = F.struct(F.col("row_id").isNull(), F.col("row_id").cast(id_type), "archive", "ordinal", "record_id", "uri")
    same = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    again = salted_join(heads.where(F.col("payload_bytes") >= min_bytes), same.where("n > 1").drop("n"), ["payload_digest"], "inner")
    again = again.where("record_id != first.record_id").select("archive", "ordinal", F.col("first.record_id").alias("to"), F.col("first.uri").alias("to_uri"))
    by_file = again.groupBy("archive").agg(F.collect_list(F.struct("ordinal", "to", "to_uri")).alias("revisits"))  # as many as a file's records at most
    stamp = date or _now()

    def fresh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, revisits in zip(pdf["content"], pdf["revisits"], strict=True):
                to = {r["ordinal"]: r for r in (revisits if revisits is not None else [])}
                out, held = [], 0
                for k, (head, block) in enumerate(parse_archive(content)):
                    fields = [("WARC-Record-ID", head.get("warc-record-id")), ("WARC-Date", stamp), ("WARC-Target-URI", head.get("warc-target-uri")), ("WARC-Payload-Digest", head.get("warc-payload-digest")), ("X-Row-ID", head.get("x-row-id"))]
                    if r := to.get(k):
                        fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", r["to"]), ("WARC-Refers-To-Target-URI", r["to_uri"]), ("Content-Length", "0")]
                        out.append(_head(fields))
                    else:
                        body = _payload(head, block)
                        block = _http(len(body)) + body
                        out.append(_head([("WARC-Type", "response"), *fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]) + block)
                    held += len(out[-1])
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame({"value": out})
                        out, held = [], 0
                yield pd.DataFrame({"value": out})

    files = spark.read.format("binaryFile").load(source).select(F.col("path").alias("archive"), "content")
    told = files.join(by_file, "archive", "left").select("content", "revisits")
    write_archives(told.mapInPandas(fresh, "value binary").select(F.col("value").cast("string")), target)


def deduplicate_pages(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url", min_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Archive ``pages``, resolve revisits, read the result back: a row per page.

    Columns: the id, payload_bytes, payload_digest, record_type, refers_to (an id), archive.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    id_type = pages.schema[id_col].dataType.simpleString()
    write_archives(response_records(pages, payload, id_col, url), f"{folder}/captured")
    resolve_revisits(spark, f"{folder}/captured", f"{folder}/resolved", min_bytes, id_type=id_type)
    back = cut(read_archives(spark, f"{folder}/resolved", with_payload=False).drop("payload"))
    originals = back.where("warc_type = 'response'").groupBy("record_id").agg(F.first("row_id").alias("to_id"), F.first("payload_bytes").alias("to_bytes"))
    originals = originals.withColumnRenamed("record_id", "refers_to")
    revisits = salted_join(back.where("warc_type = 'revisit'"), originals, ["refers_to"])
    named = lambda df, size, to: df.select(F.col("row_id").cast(id_type).alias(id_col), size.alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), to.cast(id_type).alias("refers_to"), "archive")
    return named(back.where("warc_type = 'response'"), F.col("payload_bytes"), F.lit(None)).union(named(revisits, F.col("to_bytes"), F.col("to_id")))

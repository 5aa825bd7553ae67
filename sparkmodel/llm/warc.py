"""WARC archives that are read through an index.

Writing gives, besides the archives, an index of one row per record: file, offset, length, URL and payload digest.
Reading starts from index rows: they are sorted by file and offset, neighbouring byte ranges are joined to one read,
and only the selected records are fetched, each a gzip member of its own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm.runtime import drop_folder, drop_table, new_folder, ship, skewed_join, written

#: Payloads below this many bytes are never replaced by a revisit record.
REVISIT_BYTES = 100
#: An archive is closed beyond FILE_BYTES. One read spans at most READ_BYTES and skips gaps of up to GAP_BYTES.
FILE_BYTES, READ_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10
#: Bytes of records for one reading task.
TASK_BYTES = 16 << 20
#: Copies of equal rows that one task makes at a time.
COPIES = 1_000
#: The capture date of written records is a parameter, so that reruns give the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, url string, digest string"


def field(name: str, value: str | None) -> str:
    """A header line; line breaks of a value are percent-encoded, a null value gives no line."""
    return "" if value is None else f"{name}: {value.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def unescaped(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(kind: str, page: str | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP header, with its length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}|{page}|{url}|{digest}")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\n"
    head += field("WARC-Target-URI", url) + field("X-Page-ID", page) + f"WARC-Payload-Digest: sha256:{digest}\r\n"
    if kind == "revisit":
        head += f"WARC-Profile: {PROFILE}\r\n" + field("X-Refers-To-Page-ID", refers_to)
    head += f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(3, wbits=31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and the payload's length according to its HTTP header."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    return fields, payload, size


def record_types(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(id, url, digest, size, n, first, refers_to) for each distinct (id, url, payload) of pages (id, url, html).

    n counts equal rows. Of equal payloads of at least revisit_bytes, the row with the smallest id (null last; then url)
    is first. Only digests, ids and URLs are moved; equal rows are counted, and the smallest taken, before the shuffle.
    """
    rows = written(pages.groupBy("id", "url", "digest", "size").agg(F.count(F.lit(1)).alias("n")), "payloads")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    shared = rows.where(F.col("size") >= revisit_bytes)
    least = written(shared.groupBy("digest").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("rows")), "responses")
    joined = skewed_join(shared, least, "digest", "rows", rows.count())
    first = F.col("id").eqNullSafe(F.col("least.id")) & F.col("url").eqNullSafe(F.col("least.url"))
    of_shared = joined.select("id", "url", "digest", "size", "n", first.alias("first"), F.col("least.id").alias("refers_to"))
    others = rows.where(F.col("size") < revisit_bytes).withColumns({"first": F.lit(None).cast("boolean"), "refers_to": F.lit(None).cast(rows.schema["id"].dataType)})
    types = written(of_shared.unionByName(others), "types")
    drop_table(rows, least)
    return types


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per row to archives in `folder`, and return their index (INDEX), itself a written table.

    Payloads are the html in UTF-8 (null: empty). Each attempt of a task writes files of its own name, and the index is
    committed with the task, so files of lost attempts are never read. Of equal rows one brings its payload to the
    writer, and the records of the others, which hold none or a short one, are dealt over the tasks. A very long
    payload takes a few times its size in the task that writes it.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("size"))
    types = record_types(rows.drop("html"), revisit_bytes)

    def beside(left: DataFrame, kinds: DataFrame) -> DataFrame:
        same = left["id"].eqNullSafe(kinds["id"]) & left["url"].eqNullSafe(kinds["url"]) & (left["digest"] == kinds["digest"])
        return left.join(kinds, same).select(kinds["id"], kinds["url"], left["html"], kinds["digest"], kinds["size"], kinds["n"], kinds["first"], kinds["refers_to"])

    todo = beside(rows, types.where("n = 1"))
    repeated = types.where("n > 1")
    if not repeated.isEmpty():
        # one row of each is left before it meets its kind, by an aggregate that works before the shuffle
        once = beside(rows.groupBy("id", "url", "digest").agg(F.first("html").alias("html")), repeated)
        short = F.when(F.col("first").isNull(), F.col("html")).otherwise(F.lit(""))
        parts = once.withColumns({"html": short, "first": F.when(F.col("first").isNotNull(), False), "part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 2) / COPIES)))})
        each = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPIES).cast("bigint"), F.col("n") - 1 - F.col("part") * COPIES))
        copies = parts.repartition("digest", "id", "part").withColumn("copy", F.explode(each)).drop("part", "copy")
        todo = todo.unionByName(once).unionByName(copies)
    todo = todo.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", "size", "first", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for row in batch.to_pylist():
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{inner}/{name}", compression=None)
                    kind = "revisit" if row["first"] is False else "response"
                    member = record(kind, row["id"], row["url"], row["digest"], row["size"], row["html"].encode(), row["refers_to"], date)
                    out.write(member)
                    index.append((name, at, len(member), row["url"], row["digest"]))
                    at += len(member)
                columns = list(zip(*index, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    index = written(todo.mapInArrow(write, INDEX), "index")
    drop_table(types)
    return index


def joined_ranges(rows: list[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[tuple[str, int, int, list[int]]]:
    """Rows (file, offset, length), sorted, to reads (file, start, end, numbers of the rows inside)."""
    inside: list[int] = []
    name, start, end = "", 0, 0
    for i, (file, offset, length) in enumerate(rows):
        if inside and (file != name or offset > end + gap_bytes or max(end, offset + length) - start > read_bytes):
            yield name, start, end, inside
            inside = []
        if not inside:
            name, start, end = file, offset, offset
        inside.append(i)
        end = max(end, offset + length)
    if inside:
        yield name, start, end, inside


def read_records(selected: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of index rows: page_id (text), url, payload_bytes, payload_digest, record_type, refers_to (text) and place.

    Sizes and digests of responses are those of the bytes read, and must equal the record's own digest; a revisit has
    those of the payload it stands for. with_payload adds the payload (null for revisits).
    """
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, selected.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
    rows = selected.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for name, start, end, inside in joined_ranges(rows):
                with store.open_input_file(f"{inner}/{name}") as f:
                    data = f.read_at(end - start, start)
                out = []
                for i in inside:
                    _, offset, length = rows[i]
                    fields, payload, size = parsed(data[offset - start : offset - start + length])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response":
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {name} at {offset} does not match its digest")
                    out.append((unescaped(fields.get("X-Page-ID")), unescaped(fields.get("WARC-Target-URI")), size, digest, kind, unescaped(fields.get("X-Refers-To-Page-ID")), name, offset, length, payload if with_payload and kind == "response" else None))
                types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length", "payload"]
                keep = len(names) if with_payload else len(names) - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)][:keep], names=names[:keep])

    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, file string, offset bigint, length bigint"
    return rows.mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write pages to archives, read all of them back by their index: one row per page.

    id, payload_bytes, payload_digest, record_type, refers_to. Of rows with equal payloads of at least revisit_bytes
    the one with the smallest id is the response (null ids last, then the smallest url; of wholly equal rows one), the
    others revisit it; a revisit of a response without id has a null refers_to. Null html is an empty payload. Extra
    columns are ignored, whatever their names; an empty table gives an empty result. Very long payloads are as in
    write_archives. The archives are deleted once they have been read.
    """
    folder = new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, url_col, html_col, revisit_bytes)
    kind = pages.schema[id_col].dataType
    read = read_records(index, folder)
    out = written(read.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")), "records")
    drop_table(index)
    drop_folder(pages.sparkSession, folder)
    return out


SQL = f"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> least THEN least END AS refers_to
FROM firsts"""

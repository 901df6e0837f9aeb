"""WARC archives written and read as a chunked record table.

Writing takes rows (record identifier, chunk number, bytes): a record's header goes out with its first chunk, and each
chunk is compressed and written as it comes, so no record is held whole in Python. Reading streams each file, one
gzip member per record, and gives a row per chunk with the bytes and the SHA-1 of the payload up to there; the row of
the last chunk has the digest of the whole payload.

Records with equal payloads (length, SHA-1 and a 64-bit hash agree) of at least min_bytes are written once: the row with
the smallest page id is a response, the others are revisits of it. Only files that a finished task has listed in the
manifest are read.

Defined results: a null html is an empty payload; rows that share the smallest page id and its payload are responses,
all of them; a null page id is never the smallest unless all are null, and is then a response; a null url is written as
an empty address; repeated rows and equal page ids each give a record, with equal record identifiers; a payload of any
length is cut into chunks; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_join, lean, shared_dir, table, written

#: Bytes of payload in a chunk row, and bytes read from a file at once.
CHUNK, READ = 1 << 20, 1 << 18
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
ID = "urn:x-page:"


def chunk_table(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of every page: page_id, url, record_type, refers_to, sha1 (hex), n_bytes, chunk_no, n_chunks, data.

    Payloads are cut before anything moves, so no row that is shuffled is longer than a chunk. Digests are grouped first;
    chunk rows then meet the small table of payloads that occur twice or more, the most frequent of which are broadcast.
    The rows of a record come together and in order within a partition; a revisit carries no payload.
    """
    body = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"), F.monotonically_increasing_id().alias("row"))
    full = body.select("*", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n_bytes"), F.xxhash64("body").alias("xx"))
    same = ["sha1", "n_bytes", "xx"]
    copies = full.select("page_id", *same).groupBy(*same).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(copies.withColumn("first_id", F.when(F.col("n_bytes") >= min_bytes, F.col("first_id"))), "warc-copies")
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk)).cast("int")
    rows = full.withColumn("n_chunks", n_chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    rows = rows.withColumn("data", F.expr(f"substring(body, chunk_no * {chunk} + 1, {chunk})")).drop("body")
    out = counted_join(rows, copies, same, "n", copies.agg(F.sum("n")).first()[0] or 0, F.col("row"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    out = out.withColumn("revisit", revisit).filter("not revisit or chunk_no = 0").sortWithinPartitions("row", "chunk_no")
    return out.select(
        "page_id", "url", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "sha1", "n_bytes", "chunk_no",
        F.when(F.col("revisit"), 1).otherwise(F.col("n_chunks")).alias("n_chunks"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("data")).alias("data"),
    )


def _name(page_id) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def _head(row: dict) -> bytes:
    """Record header and HTTP header; a revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    url = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in row["url"])
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _name(row["page_id"])), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(row["refers_to"]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else row["n_bytes"]))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write_archives(chunks: DataFrame, uri: str) -> DataFrame:
    """Write an archive per partition; the manifest: file, n_records, n_bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(uri)
        name, records, size, out, member = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0, None, None
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                    if out is None:
                        fs.create_dir(path)
                        out = fs.open_output_stream(f"{path}/{name}")
                    if row["chunk_no"] == 0:
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        records += 1
                        size += out.write(member.compress(_head(row)))
                    size += out.write(member.compress(row["data"]))
                    if row["chunk_no"] == row["n_chunks"] - 1:
                        size += out.write(member.compress(b"\r\n\r\n") + member.flush())
        finally:
            if out is not None:
                out.close()
        if records:
            yield pa.RecordBatch.from_pylist([{"file": name, "n_records": records, "n_bytes": size}])

    return written(chunks.mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-manifest")


def inflate(stream, size: int = READ) -> Iterator[bytes]:
    """The bytes of a file of gzip members, in bounded portions."""
    member = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            out = member.decompress(data, size)
            if out:
                yield out
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
            else:
                data = member.unconsumed_tail


class Bytes:
    """A pull reader over portions of bytes that keeps what it needs and no more."""

    def __init__(self, portions: Iterator[bytes]):
        self.portions, self.kept = portions, b""

    def until(self, end: bytes) -> bytes | None:
        """Up to and without end; None at the end of the file."""
        while (at := self.kept.find(end)) < 0:
            more = next(self.portions, None)
            if more is None:
                if self.kept.strip():
                    raise ValueError("the archive ends inside a header")
                return None
            self.kept += more
        out, self.kept = self.kept[:at], self.kept[at + len(end) :]
        return out

    def take(self, n: int) -> bytes:
        """n bytes, or as many of them as are at hand; never more memory than a portion."""
        if not self.kept:
            self.kept = next(self.portions, b"")
            if not self.kept:
                raise ValueError("the archive ends inside a record")
        out, self.kept = self.kept[:n], self.kept[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def records(stream) -> Iterator[tuple[dict, int, bytes, int, str, bool]]:
    """Chunks of every record: header fields, chunk number, its bytes, payload bytes and SHA-1 up to there, whether it is the last."""
    src = Bytes(inflate(stream))
    while (head := src.until(b"\r\n\r\n")) is not None:
        if not head.startswith(VERSION):
            raise ValueError("no record begins here")
        fields = _fields(head)
        http = src.until(b"\r\n\r\n") or b""
        fields["http-length"] = _fields(http)["content-length"]
        left, done, no, sha1 = int(fields["content-length"]) - len(http) - 4, 0, 0, hashlib.sha1()
        while True:
            chunk = []
            want = min(left, CHUNK)
            while want:
                chunk.append(src.take(want))
                want -= len(chunk[-1])
            data = b"".join(chunk)
            sha1.update(data)
            left, done = left - len(data), done + len(data)
            yield fields, no, data, done, base64.b32encode(sha1.digest()).decode(), not left
            no += 1
            if not left:
                break
        if src.until(b"\r\n\r\n") != b"":
            raise ValueError("a record doesn't end where its length says")


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(text) if text else None


def read_archives(uri: str, manifest: DataFrame, keep_data: bool = True) -> DataFrame:
    """The chunk table again: page_id, chunk_no, record_type, refers_to, payload_bytes and payload_digest up to the chunk, last, data.

    A revisit gives one row with the length and digest of the full payload as its header has them. Digests that differ
    from the header raise an error.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}") as stream:
                    for fields, no, data, done, digest, last in records(stream):
                        said, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                        if last and not revisit and (digest != said or done != int(fields["http-length"])):
                            raise ValueError(f"{fields['warc-record-id']}: the payload differs from its header")
                        rows.append((_page(fields["warc-record-id"]), no, fields["warc-type"], _page(fields.get("warc-refers-to")), int(fields["http-length"]) if revisit else done, said if revisit else digest, last, *[data] * keep_data))
                        held += len(data) if keep_data else 0
                        if len(rows) >= 1000 or held > 8 * CHUNK:
                            yield _batch(rows, keep_data)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, keep_data)

    spread = manifest.select("file").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, ", ".join(f"{k} {t}" for k, t, _ in _COLUMNS[: 7 + keep_data]))


_COLUMNS = [("page_id", "long", pa.int64()), ("chunk_no", "int", pa.int32()), ("record_type", "string", pa.string()), ("refers_to", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("last", "boolean", pa.bool_()), ("data", "binary", pa.binary())]


def _batch(rows: list[tuple], keep_data: bool) -> pa.RecordBatch:
    names = _COLUMNS[: 7 + keep_data]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, _, t) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _, _ in names])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: a row per page."""
    uri = shared_dir(spark, "warc")
    manifest = write_archives(chunk_table(table(spark, sf_dir, "pages")), uri)
    return read_archives(uri, manifest, keep_data=False).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

QUERIES = {"op6_warc": op6_warc}
ORACLE = {"op6_warc": SQL}

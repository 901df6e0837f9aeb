"""Token ids in files: frequency-ranked, byte-aligned, variable length, with the control bytes apart from the data bytes.

Ids are numbered by falling frequency, so the common ones take one byte. Of each rank, two control bits tell its bytes
(one to four); four values share a control byte. A block holds document ids, lengths, control bytes and data bytes.
Reading looks the sizes of four values up in a 256-row table for each control byte; no value is decoded alone.

Layout of a file: the magic, then blocks of (documents, tokens, control bytes, data bytes: four little-endian unsigned
64-bit integers; document ids, int64; null marks, uint8; lengths, uint32; control; data). ``ranks.bin`` beside the files
has the id of each rank. Files are sorted by document id, and follow each other in that order. Only files that a
finished task has listed in the manifest are read, so the leavings of lost executors do no harm.

Defined results: a null text is empty and gives the end id alone; equal document ids are ordered by the CRC of their
ids; null document ids come first; repeated rows each give a row; very long texts are one cell of compressed ids; an
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, spread, vocabulary_path
from .common import lean, shared_dir, slices, table, written

MAGIC = b"WFVB\x01"
HEAD = "<4Q"
#: Bytes of compressed ids that a block is made from, about.
BLOCK = 2 << 20
#: Bytes of the four values that a control byte describes.
SIZES = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    at = np.cumsum(extra.astype(np.int64) + 1) - extra - 1
    data = np.zeros(int(at[-1]) + int(extra[-1]) + 1 if len(at) else 0, np.uint8)
    for k in range(int(extra.max()) + 1 if len(extra) else 0):
        has = extra >= k
        data[at[has] + k] = ranks[has] >> np.uint32(8 * k) & np.uint32(0xFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int, skip: int = 0) -> np.ndarray:
    """The values again, by table lookup; skip: values of the first control byte that are not in data."""
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()[skip : skip + n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        has = size > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def squeeze(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The ids of each text as one compressed cell, in 16-bit integers where they fit: what is shuffled and kept meanwhile."""
    zip_ = zstandard.ZstdCompressor(1)
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    raw, size = memoryview(ids.astype("<u4" if wide else "<u2").tobytes()), 4 if wide else 2
    return [(b"\x04" if wide else b"\x02") + zip_.compress(raw[size * a : size * b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def expand(cells: list[bytes]) -> np.ndarray:
    """The ids of all cells, one after the other."""
    unzip = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unzip.decompress(memoryview(c)[1:]), "<u4" if c[0] == 4 else "<u2") for c in cells]
    return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def encode_table(docs: DataFrame, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, with the end id: id, n_tokens, ids (see squeeze), ids_crc32 (of the ids as unsigned 32-bit)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, at = encoder.encode(part.column(1))
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                raw = memoryview(ids.astype("<u4").tobytes())
                cells = [bytes(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(squeeze(ids, at), pa.binary()), pa.array([zlib.crc32(c) for c in cells], pa.int64())], names=["doc_id", "n_tokens", "ids", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_crc32 long")


def frequencies(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows; one count per id of the vocabulary comes to the driver."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(expand(batch.column(0).to_pylist()))
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    out[counts["id"]] = counts["n"]
    return out


def write_files(encoded: DataFrame, uri: str, counts: np.ndarray) -> DataFrame:
    """Write the files and return their manifest: part, file, n_docs, n_tokens."""
    order = np.lexsort((np.arange(len(counts)), -counts)).astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    fs, path = _open(uri)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/ranks.bin") as out:
        out.write(order.tobytes())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(uri)
        part = TaskContext.get().partitionId()
        name, n_docs, n_tokens, out = f"{part:06d}-{uuid.uuid4().hex}.ids", 0, 0, None
        try:
            for batch in batches:
                for block in slices(batch, "ids", BLOCK):
                    if out is None:
                        out = fs.open_output_stream(f"{path}/{name}")
                        out.write(MAGIC)
                    ids = expand(block.column(1).to_pylist())
                    control, data = pack(rank[ids])
                    keys = block.column(0)
                    out.write(struct.pack(HEAD, block.num_rows, len(ids), len(control), len(data)))
                    out.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    out.write(keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                    out.write(block.column(2).to_numpy(zero_copy_only=False).astype("<u4").tobytes())
                    out.write(control)
                    out.write(data)
                    n_docs, n_tokens = n_docs + block.num_rows, n_tokens + len(ids)
        finally:
            if out is not None:
                out.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_tokens": n_tokens}])

    placed = encoded.select("doc_id", "ids", "n_tokens", "ids_crc32").repartitionByRange("doc_id", "ids_crc32").sortWithinPartitions("doc_id", "ids_crc32").select("doc_id", "ids", "n_tokens")
    return written(placed.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"), "token-manifest")


def read_files(spark: SparkSession, uri: str, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Documents as the files tell them: doc_id, start, n_tokens, ids_crc32; keep_ids adds the ids (uint32).

    The manifest has a row per file; a running sum over it, on the driver, gives each file its first position.
    """
    files, start = [], 0
    for row in sorted(manifest.collect()):
        files.append((row["file"], start))
        start += row["n_tokens"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(uri)
        order = None
        for batch in batches:
            for file in batch.to_pylist():
                if order is None:
                    with fs.open_input_stream(f"{path}/ranks.bin") as src:
                        order = np.frombuffer(src.read(), "<u4")
                begin = file["start"]
                with fs.open_input_stream(f"{path}/{file['file']}") as src:
                    if src.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{file['file']} is no token file")
                    while head := src.read(struct.calcsize(HEAD)):
                        docs, tokens, n_control, n_data = struct.unpack(HEAD, head)
                        keys, null = np.frombuffer(src.read(8 * docs), "<i8"), np.frombuffer(src.read(docs), np.uint8)
                        length = np.frombuffer(src.read(4 * docs), "<u4").astype(np.int64)
                        raw = memoryview(order[unpack(src.read(n_control), src.read(n_data), tokens)].astype("<u4").tobytes())
                        to = np.cumsum(length)
                        cells = [raw[4 * a : 4 * b] for a, b in zip(to - length, to, strict=True)]
                        out = [pa.array(keys, mask=null.astype(bool)), pa.array(begin + to - length, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(c) for c in cells], pa.int64())]
                        yield pa.RecordBatch.from_arrays(out + [pa.array(map(bytes, cells), pa.binary())] * keep_ids, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])
                        begin += tokens

    listed = spark.createDataFrame(files, "file string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


#: The end id that closes each document.
END_ID = 2


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with the public 49k word vocabulary, written to files and read back."""
    encoded = written(encode_table(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), END_ID), "token-ids")
    uri = shared_dir(spark, "token-files")
    return read_files(spark, uri, write_files(encoded, uri, frequencies(encoded)))


QUERIES = {"op9_token_files": op9_token_files}
ORACLE: dict[str, str] = {}

"""Substring dedup: every word covered by a window of WINDOW words that also starts elsewhere is removed.

An FM-index of the whole corpus doesn't fit one machine, and searching every document in every shard would grow with the
square of the corpus. So text is dealt to shards by content: each window belongs to its minimizer, the least hash among
its SEED-word runs, and equal windows have equal minimizers. Neighbouring windows with one minimizer place form a
segment, which goes to the shard of its minimizer once, however many copies of it there are. In each shard a compressed
FM-index (wavelet matrix) of its segments is built, in which a segment counts as often as it has copies. The segments are
streamed through it, backward search gives their matching statistics, and the intervals whose statistics reach WINDOW
words at two places or more are reported. Segments whose minimizer occurs once in the corpus can't hold a repeated window
and stay out.

A shard holds SHARD_WORDS words, about. A minimizer with more than HOT kinds of segments is dealt by window instead: its
windows, one by one and grouped by content, are pieces that go to the shards of their own hashes, so no shard grows with
a frequent passage. What has many copies is broadcast where it is joined, so no passage is a hot key.

Defined results: a null or empty text has no words and nothing removed; copies of a whole document remove all its windows
in each copy; texts under WINDOW words stay whole; equal ids and repeated rows each give a row and count as different
places; very long texts are cut like others; an empty table gives no rows; other columns are ignored. Equality of segments is by two 64-bit hashes, of words
inside the index by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, counted_join, forget, hashes_of, lean, mix, release, row_key, slices, table, words_of, written
from .fm_index import FMIndex

#: Words of a window, words whose hash may be a minimizer, words of a shard, and segments from which a minimizer is hot.
WINDOW, SEED, SHARD_WORDS, HOT = 35, 8, 300_000, 5_000
#: Bytes of text, and of compressed text, that a task looks at together.
PART, PACKED_PART = 3 << 20, 1 << 20
_INVERSE = pow(int(ODD), -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Runs:
    """Hashes of any runs of words, from prefix sums of word hash times power."""

    def __init__(self, hashed: np.ndarray):
        n = len(hashed)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * _powers(int(ODD), n), dtype=np.uint64)))
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, begin: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[begin + size] - self.sums[begin]) * self.inverse[begin] + np.asarray(size).astype(np.uint64))


def segments(starts: np.ndarray, hashed: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Maximal runs of windows with one minimizer place: doc, first (word of its document), windows, mini, h1."""
    sizes = np.diff(starts)
    n_win = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), n_win)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return {"doc": none, "first": none, "windows": none, "mini": none, "h1": none}
    runs = Runs(hashed)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win) + np.repeat(starts[:-1], n_win)
    # Sliding minimum over the seeds of each window by doubling; the leftmost of equals wins.
    value = np.full(len(hashed), np.iinfo(np.uint64).max, np.uint64)
    n_seed = len(hashed) - SEED + 1
    value[:n_seed] = runs.of(np.arange(n_seed), SEED)
    place = np.arange(len(hashed))
    span, need = 1, window - SEED + 1

    def step(by: int) -> None:
        nonlocal value, place
        other, where = value[by:], place[by:]
        keep = value[: len(other)] <= other
        value = np.concatenate((np.where(keep, value[: len(other)], other), value[len(other) :]))
        place = np.concatenate((np.where(keep, place[: len(where)], where), place[len(where) :]))

    while span * 2 <= need:
        step(span)
        span *= 2
    if span < need:
        step(need - span)
    mini, spot = value[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    return {"doc": doc[begin], "first": at[begin] - starts[doc[begin]], "windows": count, "mini": mini[begin].view(np.int64), "h1": runs.of(at[begin], count + window - 1).view(np.int64)}


SEGMENTS = "rk1 long, rk2 long, first int, windows short, mini long, h1 long"


def minimizer_counts(found: DataFrame) -> DataFrame:
    """mini, n: segments of each minimizer that has two or more."""
    return found.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def all_segments(docs: DataFrame) -> DataFrame:
    """Segments of every document (columns text, rk1, rk2)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                starts, code, words = words_of(part.column(0))
                if not len(code):
                    continue
                s = segments(starts, hashes_of(words)[code])
                doc = pa.array(s["doc"])
                yield pa.RecordBatch.from_arrays([part.column(1).take(doc), part.column(2).take(doc), pa.array(s["first"], pa.int32()), pa.array(s["windows"], pa.int16()), pa.array(s["mini"], pa.int64()), pa.array(s["h1"], pa.int64())], names=["rk1", "rk2", "first", "windows", "mini", "h1"])

    return docs.select("text", "rk1", "rk2").mapInArrow(run, SEGMENTS)


def pack_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text as a compressed cell, packed: what is shuffled when texts are joined."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "packed binary"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            cells = [None if t is None else squeeze(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cells, pa.binary())], names=[*keep, "packed"])

    return docs.select(F.col("text").alias("packed_text"), *keep).mapInArrow(run, schema)


def unpack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size with column 0, packed, as text again."""
    for batch in batches:
        for part in slices(batch, "packed", PACKED_PART):
            unzip = zstandard.ZstdDecompressor().decompress
            texts = pa.array([None if c is None else unzip(c).decode() for c in part.column(0).to_pylist()], pa.large_string())
            yield from slices(pa.RecordBatch.from_arrays([texts, *part.columns[1:]], names=["text", *part.schema.names[1:]]), "text", PART)


def cut_pieces(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The pieces that go to shards: key, h1, copies, words.

    wanted has rk1, rk2, first, windows, mini, h1, copies and hot; windows of hot segments come one by one. Pieces of
    equal content are one in each task, with the sum of their copies.
    """
    listed = wanted.groupBy("rk1", "rk2").agg(F.collect_list(F.struct("first", "windows", "mini", "h1", "copies", "hot")).alias("wanted"))
    texts = pack_texts(docs, "rk1", "rk2").join(listed, ["rk1", "rk2"]).select("packed", "wanted")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpack_batches(batches):
            starts, code, words = words_of(part.column(0))
            if not len(code):
                continue
            hashed = hashes_of(words)[code]
            lists = part.column(1)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            first, windows, mini, h1, copies, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            hot = hot.astype(bool)
            begin = np.repeat(starts[:-1], sizes) + first
            each = np.where(hot, windows, 1).astype(np.int64)
            of = np.repeat(np.arange(len(begin)), each)
            at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            size = np.where(hot, WINDOW, windows.astype(np.int64) + WINDOW - 1)[of]
            own = Runs(hashed).of(at, size).view(np.int64)
            key = np.where(hot[of], own, mini[of])
            own, pick, back = np.unique(own, return_index=True, return_inverse=True)
            times = np.bincount(back, copies[of]).astype(np.int64)
            for a in range(0, len(pick), 20_000):
                p = pick[a : a + 20_000]
                cells = [hashed[x : x + n].tobytes() for x, n in zip(at[p], size[p], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(own[a : a + 20_000]), pa.array(times[a : a + 20_000]), pa.array(cells, pa.binary())], names=["key", "h1", "copies", "words"])

    return texts.mapInArrow(run, "key long, h1 long, copies long, words binary")


#: An interval of a segment: its first window, and how many windows in a row are repeated.
SPAN = np.dtype([("first", "<i4"), ("windows", "<i4")])


def repeated(pieces: DataFrame, shards: int) -> DataFrame:
    """Intervals of each piece whose windows stand at two places or more: h1, copies, spans (see SPAN)."""

    def run(tbl: pa.Table) -> pa.Table:
        # Windows of hot minimizers come from several tasks: equal ones are one piece.
        h1, pick, back = np.unique(tbl.column("h1").to_numpy(), return_index=True, return_inverse=True)
        copies = np.bincount(back, tbl.column("copies").to_numpy()).astype(np.int64)
        cells = tbl.column("words").take(pa.array(pick)).to_pylist()
        words = np.frombuffer(b"".join(cells), np.uint64)
        sizes = np.fromiter((len(c) // 8 for c in cells), np.int64, len(cells))
        del cells
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        index = FMIndex(words, offsets, copies)
        piece, start, n = index.intervals(offsets, WINDOW)
        spans = np.zeros(len(piece), SPAN)
        spans["first"], spans["windows"] = start - offsets[piece], n
        rows, first = np.unique(piece, return_index=True)
        bounds = np.append(first, len(spans))
        out = {"h1": pa.array(h1[rows], pa.int64()), "copies": pa.array(copies[rows], pa.int64()), "spans": pa.array([spans[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())}
        release()
        return pa.table(out)

    return pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(run, "h1 long, copies long, spans binary")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """rk1, rk2, first, spans of every segment with repeated windows (columns of docs: text, rk1, rk2)."""
    # Text is cut into words and segments once; minimizers are counted in what was found.
    each = written(all_segments(docs), "dedup-all-segments")
    often = written(minimizer_counts(each), "dedup-minimizers")
    n_some = often.agg(F.sum("n")).first()[0] or 0
    place = F.struct("rk1", "rk2", "first")
    some = written(counted_join(each, often, ["mini"], "n", n_some, place), "dedup-segments")
    forget(each)
    kinds = written(some.groupBy("mini", "h1").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rk1", "rk2", "first", "windows")).alias("at")), "dedup-kinds")
    minis = kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("n"))
    heavy = written(minis.filter(F.col("kinds") > HOT), "dedup-hot-minimizers")
    n_kinds = heavy.agg(F.sum("kinds")).first()[0]
    cold = kinds.select("at.*", "mini", "h1", "copies", F.lit(False).alias("hot"))
    hot = None
    if n_kinds:
        cold = cold.join(heavy.select("mini"), "mini", "left_anti").select(cold.columns)
        hot = counted_join(some, heavy.select("mini", "n"), ["mini"], "n", heavy.agg(F.sum("n")).first()[0], place)
        hot = written(hot.select("rk1", "rk2", "first", "windows", "mini", "h1", F.lit(1).cast("long").alias("copies"), F.lit(True).alias("hot")), "dedup-hot")
    pieces = cold if hot is None else cold.unionByName(hot)
    n_words = pieces.agg(F.sum(F.when(F.col("hot"), F.col("windows") * WINDOW).otherwise(F.col("windows") + WINDOW - 1))).first()[0] or 0
    marks = written(repeated(cut_pieces(pieces, docs), int(n_words // SHARD_WORDS) + 1), "dedup-marks")
    found = counted_join(some, marks, ["h1"], "copies", n_some, place).select("rk1", "rk2", "first", "spans")
    if hot is None:
        return found
    return found.unionByName(counted_join(hot_windows(hot, docs), marks, ["h1"], "copies", n_some, place).select("rk1", "rk2", "first", "spans"))


def hot_windows(hot: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows of hot segments with the hash that names them as pieces: rk1, rk2, first, h1."""
    listed = hot.groupBy("rk1", "rk2").agg(F.collect_list(F.struct("first", "windows")).alias("wanted"))
    texts = pack_texts(docs, "rk1", "rk2").join(listed, ["rk1", "rk2"]).select("packed", "rk1", "rk2", "wanted")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpack_batches(batches):
            starts, code, words = words_of(part.column(0))
            lists = part.column(3)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            first, windows = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), windows)
            at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
            own = Runs(hashes_of(words)[code]).of(starts[doc] + at, WINDOW).view(np.int64)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(at, pa.int32()), pa.array(own)], names=["rk1", "rk2", "first", "h1"])

    return texts.mapInArrow(run, "rk1 long, rk2 long, first int, h1 long")


def substring_dedup(docs: DataFrame, columns: list[str], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The given columns, n_words, n_removed, kept_sha256, spans removed (first word, words) and kept_text of every row."""
    keyed = docs.select("*", *row_key(*dict.fromkeys([*(["doc_id"] if "doc_id" in docs.columns else []), text_col])))
    once = keyed.select(F.col(text_col).alias("text"), "rk1", "rk2")
    found = repeated_windows(once)
    per_doc = found.groupBy("rk1", "rk2").agg(F.collect_list(F.struct("first", "spans")).alias("hits"))
    kept = [c for c in columns if c not in ("n_words", "n_removed", "kept_sha256", "spans", "kept_text")]
    packed = pack_texts(keyed.select(F.col(text_col).alias("text"), *kept, "rk1", "rk2"), *kept, "rk1", "rk2")
    joined = packed.join(per_doc, ["rk1", "rk2"], "left").select("packed", "hits", *kept)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n_words long, n_removed long, kept_sha256 string, spans array<struct<first:bigint,words:bigint>>", *["kept_text string"] * keep_text])
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpack_batches(batches):
            texts = part.column(0).to_pylist()
            starts, code, words = words_of(part.column(0))
            gone = _covered(starts, part.column(1))
            parts = np.array(words.cast(pa.large_binary()).to_pylist() + [b""], object)
            n_words, n_removed, said, spans, left = np.diff(starts), [], [], [], []
            for k in range(len(texts)):
                a, z = starts[k], starts[k + 1]
                out = gone[a:z]
                body = b" ".join(parts[code[a:z][~out]])
                edge = np.diff(np.concatenate(([0], out.astype(np.int8), [0])))
                first = np.flatnonzero(edge == 1)
                n_removed.append(int(out.sum()))
                said.append(hashlib.sha256(body).hexdigest())
                spans.append([{"first": int(f), "words": int(e - f)} for f, e in zip(first, np.flatnonzero(edge == -1), strict=True)])
                if keep_text:
                    left.append(texts[k] if not n_removed[-1] else body.decode())
            out = [*part.columns[2:], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(said, pa.string()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(left, pa.string())] * keep_text, names=[*kept, "n_words", "n_removed", "kept_sha256", "spans", *["kept_text"] * keep_text])

    return joined.mapInArrow(run, schema)


def _covered(starts: np.ndarray, hits: pa.Array) -> np.ndarray:
    """Which words lie in a repeated window."""
    sizes = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = hits.flatten()
    edge = np.zeros(int(starts[-1]) + 1, np.int64)
    if len(flat):
        cells = flat.field(1).to_pylist()
        spans = np.frombuffer(b"".join(cells), SPAN)
        of = np.repeat(np.repeat(starts[:-1], sizes) + flat.field(0).to_numpy(zero_copy_only=False), [len(c) // SPAN.itemsize for c in cells])
        np.add.at(edge, of + spans["first"], 1)
        np.add.at(edge, of + spans["first"] + spans["windows"] + WINDOW - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows: counts and digest."""
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], keep_text=False).drop("spans")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
#: A word goes if one of the 35 windows that hold it starts at a place whose words also start elsewhere.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, k, array_to_string(list_slice(w, k, k + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d) x),
hit AS (SELECT win.r, win.k FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) m ON win.s = m.s),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
gone AS (SELECT word.r, word.i, word.word, max(CASE WHEN hit.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.r ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS g
  FROM word LEFT JOIN hit ON hit.r = word.r AND hit.k = word.i),
told AS (SELECT r, sum(g) AS n, string_agg(CASE WHEN g = 0 THEN word END, ' ' ORDER BY i) AS kept FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(told.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(told.kept, '')) AS kept_sha256
FROM d LEFT JOIN told ON told.r = d.r"""
ORACLE = {"op1_substring_dedup": SQL}

"""Language-model scoring with a Brown class model: exchange clustering, class transitions and word emissions.

Counts cover every training text and every word. Texts are numbered in chunks; a chunk is a file in the shared folder
with its words, sorted by how often it has them, and its texts as packed codes. Tokens never move again: what is shuffled
is a row per distinct word of a chunk.

Every training word gets a class by exchange. The HEAD most frequent words are exchanged one by one between classes while
that raises the likelihood of the class bigrams; all other words stand as one item meanwhile. Then each other word joins
the class that raises the likelihood most, by the classes before and after all its occurrences in the corpus (the gain is
taken to first order in its counts, which are small against those of a class). Rows of a word meet sorted in one task,
where only sums are kept, so no word is too frequent.

A word is scored as P(class | class before) * P(word | class): transitions are smoothed towards the class frequencies, a
word's emission is its share of its class. Half the mass of the words seen once goes to words never seen, class by class;
a word never seen is then in the class of a word seen once, by their shares.

Defined results: a null text has the end token only; a null id is a training row; equal ids and repeated rows each give a
row; very long texts are one part of their own; without training rows every score is 0; an empty table gives no rows;
other columns are ignored. Ties among head words go by their hash, among classes to the first. Which words are the HEAD
ones is told from the most frequent 4 * HEAD of each chunk.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_rows, hashes_of, lean, shared_dir, slices, table, words_of, written
from .langid import fold
from .token_files import SIZES, pack, unpack

#: Words that are exchanged one by one, classes, rounds of exchange at most, and the weight of the class frequencies in a transition.
HEAD, CLASSES, ROUNDS, SMOOTH = 1000, 64, 12, 2.0
#: Bytes of text in a chunk, tokens that are looked at together, and rows that go out together.
CHUNK, BLOCK, ROWS = 16 << 20, 1 << 18, 50_000
#: Texts, codes, words, bytes of control and of data, at the start of a chunk's file.
HEADER = "<5Q"
#: Class of words without a training occurrence, in tables.
NONE = 0xFFFF
#: A class before or after a word, with how often it stands there.
TIMES = np.dtype([("context", "<u2"), ("n", "<u4")])


def _file(uri: str, chunk: int) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, f"{path}/{chunk:016x}.texts"


def chunk_texts(docs: DataFrame, uri: str, head: int = HEAD) -> DataFrame:
    """Write the chunk files of columns text, doc_id, held_out; a row per chunk: chunk, n_words, ends (training texts), top, top_n.

    Codes number the chunk's words by falling frequency. Files of tasks that didn't finish are in no row.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                starts, code, words = words_of(part.column(0), lower=True)
                hashed, same = np.unique(hashes_of(words), return_inverse=True)
                del words
                code = same[code] if len(code) else code
                held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                sizes = np.diff(starts)
                order = np.argsort(-np.bincount(code, minlength=len(hashed)), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                seen = np.bincount(code[np.repeat(~held, sizes)], minlength=len(hashed))[order]
                control, data = pack(rank[code]) if len(code) else (b"", b"")
                own, ids = hashed[order].view(np.int64), part.column(1)
                chunk = uuid.uuid4().int >> 65
                fs, path = _file(uri, chunk)
                fs.create_dir(path.rpartition("/")[0])
                with fs.open_output_stream(path) as out:
                    out.write(struct.pack(HEADER, len(sizes), len(code), len(own), len(control), len(data)))
                    out.write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    out.write(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                    out.write(held.astype(np.uint8).tobytes())
                    for cell in (sizes.astype("<u4").tobytes(), own.astype("<i8").tobytes(), seen.astype("<u4").tobytes(), control, data):
                        out.write(cell)
                top = np.argsort(-seen, kind="stable")[: 4 * head]
                top = top[seen[top] > 0]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(own)]), pa.array([int((~held).sum())]), pa.array([own[top].tobytes()], pa.binary()), pa.array([seen[top].astype("<i8").tobytes()], pa.binary())], names=["chunk", "n_words", "ends", "top", "top_n"])

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), "held_out")
    return written(rows.mapInArrow(run, "chunk long, n_words long, ends long, top binary, top_n binary"), "lm-chunks")


class Chunk:
    """A chunk's file, read whole: doc_ids, null, held, sizes, words, seen, and the texts in blocks."""

    def __init__(self, uri: str, chunk: int):
        fs, path = _file(uri, chunk)
        with fs.open_input_stream(path) as src:
            raw = src.read()
        texts, self.n_codes, words, n_control, n_data = struct.unpack_from(HEADER, raw)
        at = struct.calcsize(HEADER)
        for name, kind, n in (("doc_ids", "<i8", texts), ("null", "u1", texts), ("held", "u1", texts), ("sizes", "<u4", texts), ("words", "<i8", words), ("seen", "<u4", words), ("control", "u1", n_control), ("data", "u1", n_data)):
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.held, self.null, self.sizes = self.held.astype(bool), self.null.astype(bool), self.sizes.astype(np.int64)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """The texts, some at a time: which they are, codes with -1 as end token, and where each text begins."""
        ends = np.cumsum(self.sizes)
        a = used = 0
        while a < len(self.sizes):
            low = int(ends[a] - self.sizes[a])
            z = max(a + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
            high = int(ends[z - 1])
            mine = self.control[low // 4 : -(-high // 4)]
            shift = low % 4
            taken = int(SIZES[mine].ravel()[shift : shift + high - low].sum())
            # Values of a shared control byte that belong to the block before have no data here.
            codes = unpack(mine, self.data[used : used + taken], high - low, shift).astype(np.int32) if high > low else np.zeros(0, np.int32)
            used += taken
            yield slice(a, z), np.insert(codes, ends[a:z] - low, -1), ends[a:z] - self.sizes[a:z] - low + np.arange(z - a)
            a = z

    def tokens(self, values: np.ndarray, end: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """blocks(), and the value (by code; `end` for the end token) of each token and of the one before it; before a text stands an end."""
        ext = np.append(values, values.dtype.type(end))
        for which, codes, begin in self.blocks():
            now = ext[codes]
            yield which, codes, begin, now, np.concatenate((ext[-1:], now[:-1]))

    def training(self, which: slice, begin: np.ndarray, n: int) -> np.ndarray:
        """Which tokens of a block are those of training texts."""
        return np.repeat(~self.held[which], np.diff(np.append(begin, n)))


def _tasks(df: DataFrame, chunks: int) -> DataFrame:
    """Chunks dealt to tasks: eight each, fewer where there are few."""
    return df.repartition(max(1, chunks // 8, min(chunks, 4 * df.sparkSession.sparkContext.defaultParallelism)))


def head_words(chunks: DataFrame, head: int) -> np.ndarray:
    """Hashes of the most frequent words by the sums of what the chunks' lists tell; `head` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, "<i8")), pa.array(np.frombuffer(n, "<i8"))], names=["word", "n"])

    counts = chunks.select("top", "top_n").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(head).toPandas()["word"].to_numpy(np.int64)


class Lookup:
    """Values of known words by their hashes; others have the value of `rest`."""

    def __init__(self, words: np.ndarray, values: np.ndarray, rest: int):
        order = np.argsort(words)
        self.words, self.values, self.rest = words[order], values[order], rest

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.rest, self.values.dtype)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at], self.values.dtype.type(self.rest))


def _sum_pairs(rows: DataFrame, size: int) -> np.ndarray:
    """A vector from rows (pair, n); as many rows as it has places come to the driver at most."""
    found = rows.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[found["pair"]] = found["n"]
    return out


def bigrams(chunks: DataFrame, uri: str, n_chunks: int, items: Lookup, n_items: int) -> np.ndarray:
    """How often each item follows each other in training texts. Item 0 is the end token."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_items * n_items, np.int64)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                c = Chunk(uri, chunk)
                for which, codes, begin, now, before in c.tokens(items.of(c.words), 0):
                    total += np.bincount((before.astype(np.int64) * n_items + now)[c.training(which, begin, len(codes))], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = _tasks(chunks.select("chunk"), n_chunks).mapInArrow(run, "pair long, n long")
    return _sum_pairs(rows, n_items * n_items).reshape(n_items, n_items)


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(n: np.ndarray, fixed: dict[int, int], classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each item: start by frequency, then move items one by one to the class that raises the likelihood most.

    n: how often each item follows each other. fixed: items that keep a class (from `classes` on, or 0) to themselves.
    """
    size, n_all = len(n), 1 + max([classes - 1, *fixed.values()])
    often = n.sum(axis=0)
    order = [i for i in np.argsort(-often, kind="stable") if i not in fixed]
    cls = np.zeros(size, np.int64)
    for i, k in fixed.items():
        cls[i] = k
    for k, i in enumerate(order):
        cls[i] = 1 + k % max(classes - 1, 1)
    hot = np.zeros((size, n_all))
    hot[np.arange(size), cls] = 1
    out, into = n @ hot, (hot.T @ n).T
    c = hot.T @ out
    closed = [0, *(k for k in fixed.values())]
    for _ in range(rounds):
        moved = 0
        for w in order:
            self_n, old = n[w, w], cls[w]
            if not out[w].any() and not into[w].any():
                continue
            o, i = out[w].copy(), into[w].copy()
            o[old] -= self_n
            i[old] -= self_n
            c[old, :] -= o
            c[:, old] -= i
            c[old, old] -= self_n
            row, col = c.sum(axis=1), c.sum(axis=0)
            by_row, by_col = _f(c + o[None, :]) - _f(c), _f(c + i[:, None]) - _f(c)
            diag = np.diagonal(c)
            gain = by_row.sum(axis=1) - np.diagonal(by_row) + by_col.sum(axis=0) - np.diagonal(by_col)
            gain += _f(diag + o + i + self_n) - _f(diag)
            gain -= _f(row + o.sum() + self_n) - _f(row) + _f(col + i.sum() + self_n) - _f(col)
            gain[closed] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            c[new, :] += o
            c[:, new] += i
            c[new, new] += self_n
            if new != old:
                moved += 1
                cls[w] = new
                out[:, old] -= n[:, w]
                out[:, new] += n[:, w]
                into[:, old] -= n[w]
                into[:, new] += n[w]
        if not moved:
            break
    return cls


def gains(c: np.ndarray, classes: int) -> np.ndarray:
    """What an occurrence adds to the likelihood in each class: a row per context (class before, then class after).

    c: bigrams of classes 0 to `classes`, the last of which are the words that have none yet. The gain of a word is the
    derivative of the class-bigram likelihood along its counts, with counts smoothed towards independence.
    """
    total = max(c.sum(), 1)
    row, col = c.sum(axis=1) + 1e-9, c.sum(axis=0) + 1e-9
    smooth = c + SMOOTH * row[:, None] * col[None, :] / total
    before = np.log(smooth[:, :classes] / col[None, :classes])
    after = np.log(smooth[:classes, :] / row[:classes, None]).T
    out = np.concatenate((before, after))
    out[:, 0] = -np.inf
    return out


def place_words(chunks: DataFrame, uri: str, n_chunks: int, known: Lookup, gain: np.ndarray, classes: int) -> DataFrame:
    """The words of each chunk with what the whole corpus tells of them: chunk, counts, classes, first (compressed cells, by code).

    known: classes of the head words; gain: see gains(). first marks words of which no chunk with a lesser number knows.
    """
    n_ctx = 2 * (classes + 1)

    @lean
    def seen_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per word of a chunk: word, chunk, code, n, and its contexts as those that occur once and the others."""
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                c = Chunk(uri, chunk)
                own = known.of(c.words)
                keys = []
                for which, codes, begin, now, before in c.tokens(own, 0):
                    mine = c.training(which, begin, len(codes)) & (codes >= 0) & (now == classes)
                    after = np.append(now[1:], now.dtype.type(0))
                    at = codes[mine].astype(np.int64) * n_ctx
                    keys += [at + before[mine], at + classes + 1 + after[mine]]
                key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
                del keys
                code, context = key // n_ctx, key % n_ctx
                lone = n == 1
                many = np.zeros(int((~lone).sum()), TIMES)
                many["context"], many["n"] = context[~lone], n[~lone]
                ones, bounds = context[lone].astype("<u2"), np.arange(len(c.words) + 1)
                at_one, at_many = np.searchsorted(code[lone], bounds), np.searchsorted(code[~lone], bounds)
                for a in range(0, len(c.words), ROWS):
                    z = min(a + ROWS, len(c.words))
                    cells = [binary_rows(v[at[a] : at[z]], at[a : z + 1] - at[a]) for v, at in ((ones, at_one), (many, at_many))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.words[a:z]), pa.array(np.full(z - a, chunk)), pa.array(np.arange(a, z, dtype=np.int32)), pa.array(c.seen[a:z].astype(np.int64)), *cells], names=["word", "chunk", "code", "n", "ones", "many"])

    rows = _tasks(chunks.select("chunk"), n_chunks).mapInArrow(seen_by, "word long, chunk long, code int, n long, ones binary, many binary")

    def told(word, chunk, code, group, n, sums) -> pa.RecordBatch:
        """Rows of whole words: group numbers the word of each row, n and sums are those of the words."""
        cls = known.of(word).astype(np.int64)
        placed = np.where(cls == classes, np.argmax(sums @ np.where(np.isfinite(gain), gain, -1e300), axis=1), cls)
        placed = np.where(n > 0, placed, NONE).astype(np.int32)
        first = np.full(len(word), np.iinfo(np.int64).max)
        np.minimum.at(first, group, chunk)
        return pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(code), pa.array(n[group]), pa.array(placed[group]), pa.array(first[group] == chunk)], names=["chunk", "code", "n", "cls", "first"])

    @lean
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word. Of a word that may go on in the next batch the sums are kept, and 12 bytes of each row."""
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            word, chunk, code, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            kinds, group = np.unique(word, return_inverse=True)
            total = np.bincount(group, n, len(kinds)).astype(np.int64)
            sums = np.zeros(len(kinds) * n_ctx)
            for k, kind in ((4, np.dtype("<u2")), (5, TIMES)):
                cells = batch.column(k)
                size = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]) // kind.itemsize
                flat = np.frombuffer(b"".join(cells.to_pylist()), kind)
                context, times = (flat["context"], flat["n"]) if kind is TIMES else (flat, np.ones(len(flat)))
                sums += np.bincount(np.repeat(group, size) * n_ctx + context, times, len(sums))
            sums = sums.reshape(-1, n_ctx)
            if left is not None:
                if left[0] == kinds[0]:
                    total[0] += left[3]
                    sums[0] += left[4]
                    chunk, code, group = np.concatenate((left[1], chunk)), np.concatenate((left[2], code)), np.concatenate((np.zeros(len(left[1]), np.int64), group))
                else:
                    yield told(np.array([left[0]]), left[1], left[2], np.zeros(len(left[1]), np.int64), np.array([left[3]]), left[4][None])
            last = len(kinds) - 1
            cut = int(np.searchsorted(group, last))
            if last:
                yield told(kinds[:last], chunk[:cut], code[:cut], group[:cut], total[:last], sums[:last])
            left = (kinds[last], chunk[cut:].copy(), code[cut:].copy(), int(total[last]), sums[last].copy())
        if left is not None:
            yield told(np.array([left[0]]), left[1], left[2], np.zeros(len(left[1]), np.int64), np.array([left[3]]), left[4][None])

    placed = rows.repartition("word").sortWithinPartitions("word").mapInArrow(decide, "chunk long, code int, n long, cls int, first boolean")

    @lean
    def pack_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk and code; a chunk has as many as it has words."""
        zip_ = zstandard.ZstdCompressor(1).compress
        kept: list[tuple] = []

        def cells() -> pa.RecordBatch:
            n, cls, first = (np.concatenate([k[i] for k in kept]) for i in (1, 2, 3))
            row = [zip_(n.astype("<i8").tobytes()), zip_(cls.astype("<u2").tobytes()), zip_(first.astype("u1").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([kept[0][0]]), *(pa.array([x], pa.binary()) for x in row)], names=["chunk", "counts", "classes", "first"])

        for batch in batches:
            chunk, _, n, cls, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            begin = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else []
            for a, z in zip(begin, np.append(begin[1:], len(chunk)), strict=True):
                if kept and kept[0][0] != chunk[a]:
                    yield cells()
                    kept = []
                kept.append((int(chunk[a]), n[a:z].copy(), cls[a:z].copy(), first[a:z].copy()))
        if kept:
            yield cells()

    by_chunk = placed.repartition("chunk").sortWithinPartitions("chunk", "code")
    made = by_chunk.mapInArrow(pack_cells, "chunk long, counts binary, classes binary, first binary")
    # A chunk without a word has no rows above.
    none = zstandard.ZstdCompressor(1).compress(b"")
    empty = chunks.filter("n_words = 0").select("chunk", *(F.lit(none).alias(c) for c in ("counts", "classes", "first")))
    return written(made.unionByName(empty), "lm-words")


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk, counts, classes, first of each row of the word table."""
    unzip = zstandard.ZstdDecompressor().decompress
    for k in range(batch.num_rows):
        chunk, counts, classes, first = (c[k].as_py() for c in batch.columns)
        yield chunk, np.frombuffer(unzip(counts), "<i8"), np.frombuffer(unzip(classes), "<u2"), np.frombuffer(unzip(first), "u1").astype(bool)


class Model:
    """log10 transitions between classes, and what emissions need. Class `classes` stands for words never seen."""

    def __init__(self, c: np.ndarray, once: np.ndarray, total: int, kinds: int):
        """c: class bigrams; once: words seen once, by class; total, kinds: tokens and distinct tokens, the end included."""
        n = len(c)
        self.total, self.kinds, self.classes = total, kinds, n
        share = (c.sum(axis=0) + 1) / (c.sum() + n)
        step = (c + SMOOTH * share[None, :]) / (c.sum(axis=1, keepdims=True) + SMOOTH)
        self.mass = np.maximum(c.sum(axis=0), 1)
        if once.any():
            new, of = once / 2 / self.mass, once / once.sum()
        else:
            new, of = np.full(n, 0.5 / max(total, 1)), share
        into = step @ new
        full = np.zeros((n + 1, n + 1))
        full[:n, :n], full[:n, n], full[n, :n], full[n, n] = step, into, of @ step, of @ into
        self.step = np.log10(full)

    def emission(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a word seen once has half its mass, a word never seen is all of its class."""
        shown = np.where(counts == 1, 0.5, np.maximum(counts, 1))
        return np.where(counts > 0, np.log10(shown / self.mass[np.minimum(cls, self.classes - 1)]), 0.0)


@dataclass
class Trained:
    """Chunk files (folder and how many), the table of their words, and the model."""

    uri: str
    n_chunks: int
    words: DataFrame
    model: Model
    ends: int


def train(docs: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Trained:
    """The model of the rows of (doc_id, text, held_out) that are not held out, with all rows in chunk files."""
    uri = shared_dir(docs.sparkSession, "lm-texts")
    chunks = chunk_texts(docs, uri, head)
    sums = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends")).first()
    n_chunks, ends = sums["n"], int(sums["ends"] or 0)
    top = head_words(chunks, head)
    # Items: the end, all words that are not head words, the head words.
    n = bigrams(chunks, uri, n_chunks, Lookup(top, np.arange(2, 2 + len(top)), 1), 2 + len(top))
    cls = exchange(n, {0: 0, 1: classes}, classes)
    hot = np.zeros((len(n), classes + 1))
    hot[np.arange(len(n)), cls] = 1
    known = Lookup(top, cls[2:], classes)
    words = place_words(chunks, uri, n_chunks, known, gains(hot.T @ n @ hot, classes), classes)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class bigrams, then words seen once by class, then the number of words."""
        total = np.zeros(classes * classes + classes + 1, np.int64)
        for batch in batches:
            for chunk, counts, own, first in _cells(batch):
                c, known_once = Chunk(uri, chunk), first & (counts == 1)
                for which, codes, begin, now, before in c.tokens(own.astype(np.int64), 0):
                    total[:-classes - 1] += np.bincount((before * classes + now)[c.training(which, begin, len(codes))], minlength=classes * classes)
                total[-classes - 1 : -1] += np.bincount(own[known_once], minlength=classes)
                total[-1] += int((first & (counts > 0)).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    found = _sum_pairs(_tasks(words, n_chunks).mapInArrow(run, "pair long, n long"), classes * classes + classes + 1)
    c = found[: classes * classes].reshape(classes, classes)
    model = Model(c, found[classes * classes : -1], int(c.sum()), int(found[-1]) + (ends > 0))
    return Trained(uri, n_chunks, words, model, ends)


def word_classes(trained: Trained) -> DataFrame:
    """word (hash), n, cls of every training word."""
    uri = trained.uri

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, counts, own, first in _cells(batch):
                some = first & (counts > 0)
                yield pa.RecordBatch.from_arrays([pa.array(Chunk(uri, chunk).words[some]), pa.array(counts[some]), pa.array(own[some].astype(np.int32))], names=["word", "n", "cls"])

    return trained.words.mapInArrow(run, "word long, n long, cls int")


def score(trained: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    uri, ends = trained.uri, trained.ends
    shared = trained.words.sparkSession.sparkContext.broadcast(trained.model)  # CLASSES squared numbers

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        floor = np.log10(m.total + m.kinds + 1)
        for batch in batches:
            for chunk, counts, own, _ in _cells(batch):
                c = Chunk(uri, chunk)
                cls = np.where(counts > 0, own, m.classes).astype(np.int64)
                emit, counts = np.append(m.emission(cls, counts), 0.0), np.append(counts, ends)
                base, known = np.log10(counts + 1) - floor, (counts > 0).astype(np.int64)
                for which, codes, begin, now, before in c.tokens(cls, 0):
                    values = m.step[before, now] + emit[codes] if m.total else np.zeros(len(codes))
                    size = np.diff(np.append(begin, len(codes)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c.doc_ids[which], mask=c.null[which]), pa.array(c.held[which]), pa.array(size, pa.int64()), pa.array(np.add.reduceat(known[codes], begin)),
                        pa.array(np.full(len(size), m.total, np.int64)), pa.array(np.add.reduceat(base[codes], begin)), pa.array(np.add.reduceat(values, begin)),
                    ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _tasks(trained.words, trained.n_chunks).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """Train on the rows of (doc_id, text, held_out) that are not held out, and score all."""
    return score(train(docs, head, classes))


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those that are not held out."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7, 2)))


QUERIES = {"op10_brown": op10_brown}
ORACLE: dict[str, str] = {}

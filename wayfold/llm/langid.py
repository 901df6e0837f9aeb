"""Language identification with language-bitmask n-gram filters.

The filter is a Bloom filter whose cells hold a bitmask of languages instead of a bit (bit-sliced: bit l of all cells is
the Bloom filter of language l). The AND of an n-gram's cells is the set of languages that contain it. A text's n-grams
vote by popcount per language; each count is corrected for the false positives that the filter's fill predicts, and the
language with the largest corrected share wins.

N-grams are taken inside words (lower case, with word marks), so distinct words are looked up once per batch. The
filter learns from all training texts: counts are summed per language over the corpus, and all n-grams that a language
has at least MIN_COUNT times enter. The number of cells follows from the largest language's number of n-grams.

Defined results: a text that is null or has no letter gives ``und`` and 0; a text whose n-grams are all unknown gives
the language with the most training n-grams, with score 0; ties go to the first language in sorted order; training
rows with null text or language are left out; without any training language everything is ``und``; a null id counts as
a training row; repeated rows each count and each give a row; very long texts are read whole; of columns named lang_pred
or score the result's own stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix, slices, table, words_of, written

#: Lengths of n-grams in characters, and how often one must occur in a language.
LENGTHS, MIN_COUNT = (2, 3, 4), 3
#: Cells of the filter at least (a power of two), cells for each n-gram of a language at least, and hash functions.
CELLS, ROOM, HASHES = 1 << 21, 16, 3
MARK = np.uint32(0x110000)


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each distinct word, and the word of each."""
    lowered = pc.utf8_lower(words.cast(pa.large_string()))
    sizes = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    points = np.frombuffer("".join(f"\x00{w}\x00" for w in lowered.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))
    out, of = [], []
    for n in LENGTHS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[at + k])
        out.append(h)
        of.append(owner[at])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Masks:
    """Cells of language bits: one column for each 64 languages, of the narrowest integers that hold them."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray
    fallback: int

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], weights: dict[str, int]) -> Masks:
        languages = sorted(grams)
        size = max(CELLS, 1 << (ROOM * max(map(len, grams.values()), default=0)).bit_length())
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.iinfo(t).bits), np.uint64)
        cells = np.zeros((size, max(1, -(-len(languages) // 64))), kind)
        for k, lang in enumerate(languages):
            for at in cls.places(grams[lang], size):
                cells[at, k // 64] |= kind(1 << k % 64)
        fill = np.array([np.count_nonzero(cells[:, k // 64] & kind(1 << k % 64)) / size for k in range(len(languages))])
        order = sorted(range(len(languages)), key=lambda k: (-weights[languages[k]], languages[k]))
        return cls(languages, cells, fill**HASHES, order[0] if order else -1)

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        return [(mix(h + np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """The language bits of each n-gram."""
        out = None
        for at in self.places(h, len(self.cells)):
            out = self.cells[at] if out is None else out & self.cells[at]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        starts, code, words = words_of(texts)
        n = len(texts)
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n)
        h, owner = grams_of(words) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        total = np.bincount(owner, minlength=len(words)).astype(np.float64)
        bits = self.languages_of(h)

        def per_text(by_word: np.ndarray) -> np.ndarray:
            run = np.concatenate(([0.0], np.cumsum(by_word[code]))) if len(code) else np.zeros(1)
            return run[starts[1:]] - run[starts[:-1]]

        grams = per_text(total)
        share = np.zeros((n, len(self.languages)))
        for k, rate in enumerate(self.false_rate):
            hit = (bits[:, k // 64] & self.cells.dtype.type(1 << k % 64) > 0).astype(np.float64)
            count = per_text(np.bincount(owner, hit, minlength=len(words)))
            share[:, k] = (count - rate * grams) / (max(1 - rate, 1e-9) * np.maximum(grams, 1))
        best = np.argmax(share, axis=1)
        score = np.clip(share[np.arange(n), best], 0, 1)
        best = np.where(score > 0, best, self.fallback)
        score = np.where(lettered, score, 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def learn(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Masks:
    """The filter from all rows with a text and a language. N-grams are counted within each task before they are shuffled."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                langs = part.column(1).dictionary_encode()
                starts, code, words = words_of(part.column(0))
                if not len(code):
                    continue
                h, owner = grams_of(words)
                ends = np.cumsum(np.bincount(owner, minlength=len(words)))
                order = np.argsort(owner, kind="stable")
                h, sizes = h[order], np.diff(np.concatenate(([0], ends)))
                doc_lang = langs.indices.to_numpy(zero_copy_only=False)
                of_word = np.repeat(doc_lang, np.diff(starts))
                kinds, back = np.unique(h, return_inverse=True)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(code[of_word == k], minlength=len(words))
                    n = np.bincount(back, np.repeat(times, sizes)).astype(np.int64)
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * int(some.sum()), pa.string()), pa.array(kinds[some].astype(np.int64)), pa.array(n[some])], names=["lang", "gram", "n"])

    rows = texts.select(text_col, lang_col).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    counts = written(counts, "langid-grams")
    weights = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # All n-grams come at once, ten bytes each: the filter is made on the driver.
    languages = sorted(weights)
    code = F.create_map(*(x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k)))) if languages else None
    found = counts.select(code[F.col("lang")].cast("short").alias("k"), "gram").toArrow() if languages else None
    own = {k: found.column("k").to_numpy() == k for k in range(len(languages))}
    grams = {lang: found.column("gram").to_numpy()[own[k]].view(np.uint64) for k, lang in enumerate(languages)}
    return Masks.build(grams, weights)


def identify(docs: DataFrame, model: Masks, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns and lang_pred, score. Only the text enters the prediction."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a byte for each cell and 8 languages, up to 64
    kept = [c for c in columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string", "score double"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "read_text"):
                langs, score = shared.value.predict(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.select(F.col(text_col).alias("read_text"), *kept).mapInArrow(run, schema)


def fold(id_col: str, folds: int, held: int) -> Column:
    """Whether the row is held out: the CRC-32 of its id as text leaves this remainder. A null id is not."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == held, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3, 1))
    return identify(docs, learn(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])


QUERIES = {"op7_langid": op7_langid}
ORACLE: dict[str, str] = {}

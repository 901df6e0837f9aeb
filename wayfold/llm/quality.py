"""Quality rules: base rules and gradient-boosted trees over document statistics.

Statistics are counted in Arrow and numpy for a batch of texts at a time. The trees are grown here, with histograms,
on a bounded sample of labelled documents (TRAIN_ROWS, those with the smallest hash of their id), with monotonic
constraints on chosen statistics, and flattened into node arrays that score a batch level by level.

Defined results: a null or empty text has no words, fails the base rules and is not kept; without labels, or with one
class only, the trees keep whatever passes the base rules; labels with a null id or quality are left out; of several
labels of one id each counts as a row; repeated rows each give a row; very long texts are read whole; of columns named
like one that is added the added one stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, hashes_of, lean, slices, table, words_of

#: Labelled rows that the trees are grown on, at most; a bound on memory of the driver, not on what is scored.
TRAIN_ROWS = 20_000
#: Bytes of text whose statistics are counted at a time; a bound on memory of a worker, not on what is read.
PART = 1 << 20
#: Words in a window that counts as repeated, and the base rules' bounds.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Verdict of the trees: kept from this probability of good quality on.
KEEP_FROM = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see. A rise of one marked -1 can only lower the probability of good quality, +1 only raise it.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_lines_per_line": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": 0, "digit_share": 0, "exclaim_per_word": -1, "stop_per_word": 0, "comma_per_word": 0, "lines_per_word": 0, "bar_per_word": -1, "ascii_share": 0,
}


def _per_doc(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts of each text, and the matrix of FEATURES."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n_docs = len(texts)
    starts, code, words = words_of(texts)
    n_words = np.diff(starts)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = _per_doc(sizes[code], starts)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    n_symbols = count(r"[#*$%&|<>]")
    # Lines with a word that equal an earlier one: all such lines less the distinct ones.
    lists = pc.split_pattern(texts, "\n")
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    lines = lists.flatten().dictionary_encode()
    lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
    has_word = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line, of = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n_docs), np.diff(at))
    worded = has_word[line] if len(line) else np.zeros(0, bool)
    n_lines = np.bincount(of[worded], minlength=n_docs)
    distinct = np.unique(of[worded] * (len(lines.dictionary) + 1) + line[worded])
    n_dup_lines = n_lines - np.bincount(distinct // (len(lines.dictionary) + 1), minlength=n_docs)
    n_repeat_words = repeated_words(starts, hashes_of(words)[code] if len(code) else np.zeros(0, np.uint64))
    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True))
    kinds = np.bincount(np.unique(np.repeat(np.arange(n_docs), n_words) * (len(words) + 1) + code) // (len(words) + 1), minlength=n_docs) if len(code) else np.zeros(n_docs, np.int64)
    w, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    matrix = np.column_stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / w, kinds / w, count("[A-Z]") / chars, count("[0-9]") / chars,
        count("!") / w, count(r"\.") / w, count(",") / w, n_lines / w, count(r"\|") / w, count(r"[\x21-\x7E]") / chars,
    ]).astype(np.float64)
    return base, matrix


def repeated_words(starts: np.ndarray, hashed: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a window of words found twice or more in that document."""
    n_docs = len(starts) - 1
    sizes = np.diff(starts)
    owner, grams = gram_hashes(starts, hashed, window)
    if not len(grams):
        return np.zeros(n_docs, np.int64)
    order = np.lexsort((grams, owner))
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    n_grams = np.maximum(sizes - window + 1, 0)
    first = np.cumsum(n_grams) - n_grams
    at = np.arange(len(grams)) - np.repeat(first, n_grams) + np.repeat(starts[:-1], n_grams)
    edge = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return _per_doc((np.cumsum(edge)[:-1] > 0).astype(np.int64), starts)


@dataclass
class Trees:
    """Boosted trees as node arrays: all trees lie one after the other; a leaf points to itself."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality; all trees go down a level at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.bound[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Trees | None:
    """Second-order boosting of the logistic loss on binned statistics.

    A split on a constrained statistic must order the values of its sides by the sign, and their middle bounds all that
    grows below, so the whole model is monotonic in it.
    """
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, np.inf, 0, 0, 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value = float(np.clip(-g / (h + ridge), low, high))
            nodes[node] = [0, np.inf, node, node, rate * value]
            best = (1e-6, None)
            if level < depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.bincount(binned[rows, f], grad[rows], len(e) + 1).cumsum()[:-1]
                    hs = np.bincount(binned[rows, f], hess[rows], len(e) + 1).cumsum()[:-1]
                    a, b = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(hs < least) | (h - hs < least) | (signs[f] * (b - a) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, float(a[k]), float(b[k])))
            if best[1] is None:
                margin[rows] += rate * value
                continue
            f, k, a, b = best[1]
            go_left = binned[rows, f] <= k
            kids = [len(nodes), len(nodes) + 1]
            nodes += [[0, np.inf, kid, kid, 0.0] for kid in kids]
            nodes[node] = [f, float(edges[f][k]), *kids, 0.0]
            middle = (a + b) / 2
            for kid, part, right in ((kids[0], rows[go_left], False), (kids[1], rows[~go_left], True)):
                up = signs[f] if right else -signs[f]
                todo.append((kid, part, level + 1, max(low, middle) if up > 0 else low, min(high, middle) if up < 0 else high))
    cols = [np.array(c) for c in zip(*nodes, strict=True)]
    return Trees(cols[0], cols[1], cols[2], cols[3], cols[4], np.array(roots), depth, bias)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees grown on at most the given number of labelled documents; ids beyond a full sample are not looked at."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).select("doc_id", F.col(target).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                x = statistics(part.column(0))[1]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", "y", *FEATURES])

    # At most `rows` short rows are broadcast.
    sample = docs.select("text", "doc_id").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "y")
    found = sample.mapInArrow(run, "doc_id long, y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["doc_id", "y"])
    return grow(found[list(FEATURES)].to_numpy(), (found["y"].to_numpy() > 0).astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, keep_from: float = KEEP_FROM, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs and the counts, base_failed, score and kept of each row. One pass without a shuffle."""
    columns = ["doc_id"] if columns is None else columns
    added = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "quality_score": "double", "kept": "boolean"}
    kept = [c for c in columns if c not in added]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {t}" for k, t in added.items())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "judged_text", PART):
                base, x = statistics(part.column(0))
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                score = model.score(x) if model else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(base[b], pa.int64()) for b in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))], names=[*kept, *added])

    return docs.select(F.col("text").alias("judged_text"), *kept).mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality": op4_quality}
ORACLE: dict[str, str] = {}

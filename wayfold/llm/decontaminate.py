"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman alignment scores them.

A seed is a run of SEED words of an item. How often each occurs in the documents is counted, and of every STRETCH
neighbouring seeds of an item the rarest stays: any SEED + STRETCH - 1 words in a row that a copy leaves unedited hold a
kept seed, however large the corpus and however common its words are. A document that shares a seed with an item is
aligned with it, words as letters, around the places where seeds match, unless too few of the item's words stand there
for any alignment to reach SHARE; the score is the alignment score over that of the item with itself, so edited and
paraphrased copies score high and chance matches low.

Items are taken in blocks of BLOCK_BYTES of text, kept as files in the shared folder; a task reads one block after the
other for each batch of documents, so memory is bounded for any benchmark, every document meets every item in one pass,
and no rows are joined or shuffled. Items shorter than a seed are one seed as a whole.

Defined results: null or empty texts and items, and items without an id, match nothing; matching folds A-Z and drops
punctuation at the ends of words; equal items of different ids are each reported, repeated item rows once; repeated
documents each give a row; very long texts are searched whole; of id columns named contaminated or matches the result's
own stay; an empty benchmark contaminates nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, hashes_of, lean, mix, shared_dir, slices, table, written

#: Words of a seed, neighbouring seeds of which the rarest stays, bytes of items in a block, and seed hits that are looked at together.
SEED, STRETCH, BLOCK_BYTES, HITS = 3, 2, 16 << 20, 1 << 20
#: Bytes of text that are read at once, words that are hashed at once; regions, and cells of a row of their matrices, that are aligned at once.
TEXT_BYTES, WORDS, REGIONS, CELLS = 2 << 20, 1 << 18, 4096, 1 << 17
#: Scores of an alignment: equal words, different words, a word left out or put in; and the share that makes a match.
MATCH, MISMATCH, GAP, SHARE = 2, -1, -1, 0.5
_EDGE = " ,.;:!?\"'()[]{}|#*$%&<>-_"


#: By byte: A-Z folded; 0 in white space, 1 at the ends of words that are punctuation, 2 elsewhere.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = bytes(0 if c == 32 or 9 <= c <= 13 else 1 if chr(c) in _EDGE else 2 for c in range(256))
#: Bytes that stay of a word's eight when so many are left; rounds of eight bytes, beyond which a word is hashed by itself; ends of words that are trimmed one byte at a time for all.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ROUNDS, _TRIMS = 4, 16


def _trimmed(begins: np.ndarray, ends: np.ndarray, kind: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation at their ends; a word that is punctuation only stays as it is."""
    edge, first, last = _EDGE.encode(), begins.copy(), ends.copy()
    some = np.flatnonzero(kind[first] == 1)
    for _ in range(_TRIMS):
        first[some] += 1
        some = some[first[some] < last[some]]
        some = some[kind[first[some]] == 1]
    for k in some:
        first[k] = last[k] - len(data[first[k] : last[k]].lstrip(edge))
    some = np.flatnonzero((first < last) & (kind[last - 1] == 1))
    for _ in range(_TRIMS):
        last[some] -= 1
        some = some[kind[last[some] - 1] == 1]
    for k in some:
        last[k] = first[k] + len(data[first[k] : last[k]].rstrip(edge))
    none = first == last
    return np.where(none, begins, first), np.where(none, ends, last)


def _word_hashes(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all words at a time; data goes on for 8 bytes after the last word."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left, at, some = last - first, first, slice(None)
    with np.errstate(over="ignore"):
        out = left.astype(np.uint64) * ODD
        for k in range(_ROUNDS):
            if k:
                some = np.flatnonzero(left > 8 * k)
            chunk = eights[at[some] + 8 * k] & _LEFT[np.minimum(left[some] - 8 * k, 8)]
            out[some] = mix((out[some] * ODD if k else out) + chunk)
    long = np.flatnonzero(left > 8 * _ROUNDS)
    out[long] = hashes_of(pa.array([data[a:z] for a, z in zip(first[long], last[long], strict=True)], pa.large_binary()))
    return out


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and word hashes of each text; a word that is punctuation only stays as it is. All words at once, byte by byte: no Python object is made of a word."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    _, offsets, chars = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = chars[int(bounds[0]) : int(bounds[-1])].to_pybytes() if bounds[-1] > bounds[0] else b""
    bounds = bounds - bounds[0]
    kind = np.frombuffer(data.translate(_KIND), np.uint8)
    begin, end = kind > 0, kind > 0
    begin[1:] &= kind[:-1] == 0
    end[:-1] &= kind[1:] == 0
    cut = bounds[(bounds > 0) & (bounds < len(data))]  # words end with their text
    begin[cut], end[cut - 1] = kind[cut] > 0, kind[cut - 1] > 0
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end)
    ends += 1
    del begin, end
    data = data.translate(_FOLD) + bytes(8 * _ROUNDS)
    hashed = np.empty(len(begins), np.uint64)
    for a in range(0, len(begins), WORDS):
        here = slice(a, a + WORDS)
        hashed[here] = _word_hashes(data, *_trimmed(begins[here], ends[here], kind, data))
    return np.searchsorted(begins, bounds), hashed


def _grams(starts: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts: hash, and place among all words. A text of fewer words, but one at least, is one n-gram as a whole."""
    sizes, factors = np.diff(starts), mix(np.arange(1, SEED + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(len(hashed) - SEED + 1, 0)
    whole = np.ones(len(hashed), bool)
    for k in range(1, SEED):
        whole[starts[1:][sizes >= k] - k] = False
    with np.errstate(over="ignore"):
        grams = np.full(n, SEED, np.uint64)
        for k in range(SEED):
            grams += hashed[k : k + n] * factors[k]
        at = np.flatnonzero(whole[:n])
        if len(at) < n:
            grams = grams[at]
        few = np.flatnonzero((sizes > 0) & (sizes < SEED))
        short = sizes[few].astype(np.uint64)
        for k in range(SEED - 1):
            has = np.flatnonzero(sizes[few] > k)
            short[has] += hashed[starts[few[has]] + k] * factors[k]
    return (np.concatenate((grams, short)), np.concatenate((at, starts[few]))) if len(few) else (grams, at)


def _texts_at(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text, and place in it, of places among all words."""
    owner = np.searchsorted(starts, at, side="right") - 1
    return owner, at - starts[owner]


def _alignments(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each item with its text, and where it begins and ends in the text: a row each.

    A row of all matrices is computed at once: a gap along the row is a running maximum. Items come longest first, so
    that those that go on are the first ones. Places after a shorter text's end match nothing; no score begins there,
    and one that goes on there is no higher than the same at the text's end, which is found first.
    """
    high, wide = np.array([len(i) for i in items]), np.array([len(t) for t in texts])
    n = int(wide.max())
    words, text = np.zeros((len(items), int(high.max())), np.uint64), np.zeros((len(items), n), np.uint64)
    for k, (i, t) in enumerate(zip(items, texts, strict=True)):
        words[k, : len(i)], text[k, : len(t)] = i, t
    inside = np.arange(n) < wide[:, None]
    places, match, mismatch, gap = np.arange(n + 1, dtype=np.int32), np.int32(MATCH), np.int32(MISMATCH), np.int32(GAP)
    step = places * -gap
    above, origin = np.zeros((len(items), n + 1), np.int32), np.tile(places, (len(items), 1))
    out = np.zeros((len(items), 3), np.int64)
    for a in range(words.shape[1]):
        on = int((high > a).sum())
        above, origin = above[:on], origin[:on]
        diagonal = above[:, :-1] + np.where((text[:on] == words[:on, a : a + 1]) & inside[:on], match, mismatch)
        down = above[:, 1:] + gap
        row, source = np.zeros((on, n + 1), np.int32), np.zeros((on, n + 1), np.int32)
        np.maximum(np.maximum(diagonal, down), 0, out=row[:, 1:])
        source[:, 1:] = np.where(diagonal >= down, origin[:, :-1], origin[:, 1:])
        source = np.where(row > 0, source, places)
        lifted = row + step
        peak = np.maximum.accumulate(lifted, axis=1)
        at = np.maximum.accumulate(np.where(lifted == peak, places, np.int32(0)), axis=1)
        above, origin = peak - step, np.take_along_axis(source, at, 1)
        k = np.argmax(above, axis=1)
        top = above[np.arange(on), k]
        better = np.flatnonzero(top > out[:on, 0])
        out[better] = np.stack((top[better], origin[better, k[better]], k[better]), axis=1)
    return out


def local_alignments(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each item with its text, and where it begins and ends in the text: a row each. Those of like lengths go together, CELLS words at a time."""
    out, high = np.zeros((len(items), 3), np.int64), np.array([len(i) for i in items], np.int64)
    size = np.maximum(np.array([len(t) + 1 for t in texts], np.int64), high)
    order, a = np.argsort(size, kind="stable"), 0
    while a < len(order):
        z = a + 1
        while z < len(order) and (z + 1 - a) * size[order[z]] <= CELLS:
            z += 1
        group = order[a:z][np.argsort(-high[order[a:z]], kind="stable")]
        out[group] = _alignments([items[k] for k in group], [texts[k] for k in group])
        a = z
    return out


def local_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The same of one item and one text."""
    return tuple(int(x) for x in local_alignments([item], [text])[0])


def _shared(item: np.ndarray, text: np.ndarray) -> int:
    """How many words of the item the text has."""
    if len(item) * len(text) > 1 << 16:
        return int(np.isin(item, text).sum())
    return int((item[:, None] == text).any(axis=1).sum())


def rarest(owner: np.ndarray, at: np.ndarray, rank: np.ndarray, stretch: int) -> np.ndarray:
    """Which seeds stay: of every `stretch` neighbours in an item that of the least rank, the first of equals; all of an item with fewer."""
    order = np.lexsort((at, owner))
    item, value = owner[order], rank[order]
    size = np.bincount(item)[item] if len(item) else item
    keep = size < stretch
    for a in range(max(len(item) - stretch + 1, 0)):
        if item[a] == item[a + stretch - 1]:
            keep[a + int(np.argmin(value[a : a + stretch]))] = True
    out = np.zeros(len(owner), bool)
    out[order] = keep
    return out


class Items:
    """A block of items: ids, words of each, and seeds sorted by hash (seed, its item, its place there)."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, words: np.ndarray, seed: np.ndarray, seed_item: np.ndarray, seed_at: np.ndarray):
        self.ids, self.starts, self.words, self.seed, self.seed_item, self.seed_at = ids, starts, words, seed, seed_item, seed_at
        self.sizes = np.diff(starts)
        # The high bits of seeds, 16 places a seed: most n-grams that are no seeds are told by one look.
        bits = min(max(int(16 * len(seed)).bit_length(), 12), 24)
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(seed >> self.shift).view(np.int64)] = True

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        starts, words = _tokens(pa.array(texts, pa.large_string()))
        grams, at = _grams(starts, words)
        order = np.argsort(grams, kind="stable")
        return cls(np.array(ids, np.int64), starts, words, grams[order], *_texts_at(starts, at[order]))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which n-grams are seeds: their places, the first seed equal to each, and how many are."""
        some = np.flatnonzero(self.sieve[(grams >> self.shift).view(np.int64)])
        low, high = np.searchsorted(self.seed, grams[some], "left"), np.searchsorted(self.seed, grams[some], "right")
        hit = high > low
        return some[hit], low[hit], (high - low)[hit]

    def thinned(self, kinds: np.ndarray, counts: np.ndarray, stretch: int) -> Items:
        """Without seeds that have a rarer neighbour. kinds, counts: sorted seeds, and how often the documents have them."""
        n = counts[np.searchsorted(kinds, self.seed)] if len(kinds) else np.zeros(len(self.seed), np.int64)
        keep = rarest(self.seed_item, self.seed_at, n, stretch)
        return Items(self.ids, self.starts, self.words, self.seed[keep], self.seed_item[keep], self.seed_at[keep])

    def text(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.starts[k + 1]]

    def save(self, uri: str, name: str) -> None:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, starts=self.starts, words=self.words, seed=self.seed, seed_item=self.seed_item, seed_at=self.seed_at)
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/{name}") as to:
            to.write(out.getvalue())

    @classmethod
    def load(cls, uri: str, name: str) -> Items:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(f"{path}/{name}") as src:
            return cls(**np.load(io.BytesIO(src.read())))


def _blocks(uri: str, names: list[str]):
    """A function that gives the blocks one by one; a lone block is read once."""
    kept: list[Items] = []

    def each() -> Iterator[Items]:
        if len(names) == 1:
            kept or kept.append(Items.load(uri, names[0]))
            yield kept[0]
        else:
            for name in names:
                yield Items.load(uri, name)

    return each


def seed_counts(texts: DataFrame, uri: str, names: list[str]) -> DataFrame:
    """block, seed, n: how often the texts (column read_text) have each seed, by its number among the sorted seeds of its block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(uri, names)
        for batch in batches:
            grams = [_grams(*_tokens(part.column(0)))[0] for part in slices(batch, "read_text", TEXT_BYTES)]
            for k, items in enumerate(blocks()):
                number = np.cumsum(np.append(False, items.seed[1:] != items.seed[:-1]))  # of each seed, among the sorted ones
                total = np.zeros(number[-1] + 1, np.int64)
                for part in grams:
                    total += np.bincount(number[items.hits(part)[1]], minlength=len(total))
                some = np.flatnonzero(total)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(total[some])], names=["block", "seed", "n"])

    return written(texts.mapInArrow(run, "block long, seed long, n long").groupBy("block", "seed").agg(F.sum("n").alias("n")), "bench-seeds")


def _matches(texts: tuple[np.ndarray, np.ndarray], items: Items, out: list[list[dict]]) -> None:
    """Adds the matches of texts (offsets, word hashes) with a block of items to out."""
    starts, hashed = texts
    if not len(items.seed) or not len(hashed):
        return
    grams, at = _grams(starts, hashed)
    hit, low, many = items.hits(grams)
    if not len(hit):
        return
    order = np.argsort(at[hit], kind="stable")
    low, many = low[order], many[order]
    owner, at = _texts_at(starts, at[hit[order]])
    # Hits of whole documents, so that regions stay whole, about HITS at a time.
    ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
    upto, a = np.cumsum(many), 0
    while a < len(owner):
        base = upto[a - 1] if a else 0
        z = int(ends[max(np.searchsorted(upto[ends - 1], base + HITS, side="right") - 1, np.searchsorted(ends, a, side="right"))])
        _align(many[a:z], low[a:z], owner[a:z], at[a:z], starts, hashed, items, out)
        a = z


def _align(many, low, owner, at, starts, hashed, items: Items, out) -> None:
    """Adds the matches that these hits of seeds lead to; owner, at: text of each and place there, low, many: the seeds equal to it."""
    which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    doc, item = np.repeat(owner, many), items.seed_item[which]
    begin = np.repeat(at, many) - items.seed_at[which]  # where the item would begin
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    # Hits of an item whose places lie within its length of each other are one region.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > items.sizes[item[1:]])
    a = np.flatnonzero(new)
    d, k, b = doc[a], item[a], np.append(a[1:], len(doc)) - 1
    size = items.sizes[k]
    first = np.maximum(begin[a] - (size // 2 + SEED), 0)
    stop = np.minimum(begin[b] + size + size // 2 + SEED, np.diff(starts)[d])
    for at in range(0, len(a), REGIONS):
        regions = []
        for r in range(at, min(at + REGIONS, len(a))):
            own, text = items.text(k[r]), hashed[starts[d[r]] + first[r] : starts[d[r]] + stop[r]]
            # Each matching word of the item adds MATCH at most, so below this no alignment reaches SHARE.
            if _shared(own, text) >= SHARE * len(own):
                regions.append((r, own, text))
        scores = local_alignments([own for _, own, _ in regions], [text for _, _, text in regions])
        for (r, own, _), (best, origin, end) in zip(regions, scores.tolist(), strict=True):
            score = best / (MATCH * len(own))
            if score >= SHARE:
                name, here, there = int(items.ids[k[r]]), int(first[r]), out[d[r]]
                found = next((m for m in there if m["item_id"] == name), None)
                if found is None:
                    there.append({"item_id": name, "score": score, "first": here + origin, "last": here + end - 1})
                elif score > found["score"]:
                    found.update(score=score, first=here + origin, last=here + end - 1)


def contamination(docs: DataFrame, benchmark: DataFrame, id_cols: list[str], text_col: str = "text", block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH) -> DataFrame:
    """A row per document: the given columns, contaminated, matches (item_id, score, first and last word; by item_id)."""
    spark = docs.sparkSession
    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    uri, names = shared_dir(spark, "bench-items"), [f"{k:06d}.npz" for k in range(n_blocks)]
    texts = docs.select(F.col(text_col).alias("read_text"))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    for k, name in enumerate(names):
        # Blocks by hash of the row, of bounded size; each comes to the driver alone.
        own = sorted((r["item_id"], r["text"]) for r in blocks.filter(F.col("block") == k).collect())
        Items.of([i for i, _ in own], [t for _, t in own]).save(uri, f"all-{name}")
    counted = seed_counts(texts, uri, [f"all-{name}" for name in names])
    for k, name in enumerate(names):
        items = Items.load(uri, f"all-{name}")
        kinds = np.unique(items.seed)
        found, n = counted.filter(F.col("block") == k).toPandas(), np.zeros(len(kinds), np.int64)
        n[found["seed"]] = found["n"]
        items.thinned(kinds, n, stretch).save(uri, name)
    kept = [c for c in id_cols if c not in ("contaminated", "matches")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "matches array<struct<item_id:bigint,score:double,first:bigint,last:bigint>>"])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(uri, names)
        for batch in batches:
            parts = list(slices(batch, "read_text", TEXT_BYTES))
            read = [_tokens(part.column(0)) for part in parts]
            found: list[list[list[dict]]] = [[[] for _ in range(part.num_rows)] for part in parts]
            for items in blocks():
                for words, out in zip(read, found, strict=True):
                    _matches(words, items, out)
            for part, out in zip(parts, found, strict=True):
                for one in out:
                    one.sort(key=lambda m: m["item_id"])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, kind)], names=[*kept, "matches"])

    found = docs.select(F.col(text_col).alias("read_text"), *kept).mapInArrow(run, schema)
    return found.select(*kept, (F.size("matches") > 0).alias("contaminated"), "matches")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: doc_id, contaminated, item_ids, best_score."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "contaminated", F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("best_score"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE: dict[str, str] = {}

"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

The sketch fills COORDINATES bins in rounds: in each of the first COORDINATES rounds every shingle is hashed to one bin
of its choice, in the following ones to the bin of the round's number, and a bin keeps the least (round, value) it has
seen. So every coordinate is filled after 2 * COORDINATES rounds at most, usually after a few, and the share of equal
coordinates is concentrated around the similarity. Bands of ROWS coordinates make buckets; a pair at the threshold
shares no bucket with probability (1 - 0.85^4)^25, about 1e-8.

Texts with equal shingle sets are one class from the start, so exact copies never meet. Buckets with the same members
are one. Each bucket has a centre, the member with the least hash; near copies share it in most of their buckets. First
every member is compared with the centres of its buckets on the full sets, which joins nearly all that belongs together
by one comparison for each. Only buckets whose members are still apart go on: there members of different components are
compared by sketch, in blocks of bounded size, and pairs that may reach the threshold (down to ERRORS standard errors
below it) are confirmed on the full sets. Members that are joined already are never compared again, so no connection is
lost and n near copies cost about n comparisons. A pair is confirmed in the bucket of the first band that it shares.
Rows of a comparison group come sorted to one task, which holds one group at a time.

Defined results: a null or empty text has no shingles, is linked with nothing and kept; a text with fewer words than a
shingle is one shingle; unlike texts stay apart whatever their ids; a component is named by its least id, by null if no
row has one; repeated rows and equal ids each give a row; very long texts are compared as whole sets; an empty table
gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes, sets by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import binary_rows, counted_join, gram_hashes, hashes_of, lean, mix, row_key, slices, table, words_of, written

#: Sketch size, rows of a band, similarity in percent, and standard errors below it that a confirmed pair's sketches may be.
COORDINATES, ROWS, PERCENT, ERRORS = 100, 4, 85, 5.5
BANDS = COORDINATES // ROWS
#: Rows that are compared with one centre in a group, members of a block, and bytes of sets in either, about.
STAR, BLOCK, GROUP_BYTES = 500, 1000, 8 << 20


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the offsets of each text."""
    starts, code, words = words_of(texts, lower=True)
    owner, grams = gram_hashes(starts, hashes_of(words)[code] if len(code) else np.zeros(0, np.uint64), n, short=True)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))))


def sketches(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of COORDINATES 16-bit values for each set; all sets fill their bins in the same rounds."""
    n, t = len(at) - 1, COORDINATES
    best = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    live = np.diff(at) > 0
    for r in range(2 * t):
        mine = live[owner]
        h = mix(grams[mine] ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if r < t else np.full(len(h), r - t)
        value = np.uint64(r) << np.uint64(40) | h & np.uint64((1 << 40) - 1)
        np.minimum.at(best, owner[mine] * t + bins, value)
        live = live & (best.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
        if not live.any():
            break
    return (mix(best) >> np.uint64(48)).astype(np.uint16).reshape(n, t)


def features(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, rk1, rk2, n_shingles, s1, s2 (digest of the set), sketch, of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                grams, at = shingle_sets(part.column(0), shingle)
                raw = memoryview(grams.tobytes())
                sums = [xxhash.xxh3_128_intdigest(raw[8 * a : 8 * z]) for a, z in zip(at[:-1], at[1:], strict=True)]
                low = np.fromiter((s & (2**64 - 1) for s in sums), np.uint64, len(sums)).view(np.int64)
                high = np.fromiter((s >> 64 for s in sums), np.uint64, len(sums)).view(np.int64)
                sketch = binary_rows(sketches(grams, at).ravel(), np.arange(len(at)) * COORDINATES)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(at), pa.int64()), pa.array(low), pa.array(high), sketch], names=["doc_id", "rk1", "rk2", "n_shingles", "s1", "s2", "sketch"])

    return docs.select("text", "doc_id", "rk1", "rk2").mapInArrow(run, "doc_id long, rk1 long, rk2 long, n_shingles long, s1 long, s2 long, sketch binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """key, band, cid, size: a row for each band of each class; size is that of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, COORDINATES)
            quads = np.ascontiguousarray(sketch[:, : BANDS * ROWS]).view(np.uint64)  # ROWS 16-bit values are one 64-bit integer
            keys = mix(mix(quads) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
            each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), batch.column(0).take(each), batch.column(2).take(each)], names=["key", "band", "cid", "size"])

    return classes.select("cid", "sketch", "size").mapInArrow(run, "key long, band int, cid long, size long")


def bucket_members(classes: DataFrame) -> DataFrame:
    """cid, size, key, bands, n, centre: the members of buckets of two or more classes; buckets with the same members are one, which stands for all their bands."""
    keys = written(band_keys(classes), "near-keys")
    members = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid") % (1 << 40)).alias("sum1"), F.sum(F.xxhash64(F.lit(5), "cid") % (1 << 40)).alias("sum2"), F.min(F.struct(F.xxhash64(F.lit(11), "cid").alias("h"), "cid")).alias("c")
    buckets = keys.groupBy("key", "band").agg(*members).filter("n > 1")
    same = buckets.groupBy("n", "sum1", "sum2").agg(F.min("key").alias("key"), F.bit_or(F.expr("shiftleft(1L, band)")).alias("bands"), F.min("c.cid").alias("centre"))
    kept = written(same.select("key", "n", F.struct("bands", "n", "centre").alias("b")), "near-buckets")
    rows = keys.select("key", "cid", "size")
    total = kept.agg(F.sum("n")).first()[0] or 0
    return written(counted_join(rows, kept, ["key"], "n", total, F.col("cid")).select("cid", "size", "key", "b.*"), "near-members")


class Joined:
    """Union-find over the members of one group, from what is joined already."""

    def __init__(self, component: np.ndarray):
        self.root = np.unique(component, return_index=True, return_inverse=True)
        self.root = self.root[1][self.root[2]]

    def of(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def all(self) -> np.ndarray:
        while ((up := self.root[self.root]) != self.root).any():
            self.root = up
        return self.root


def alike(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets reach the threshold with one set; all are sorted and not empty."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    ok = 100 * np.minimum(sizes, len(one)) >= percent * np.maximum(sizes, len(one))
    some = np.flatnonzero(ok)
    if len(some):
        flat = np.concatenate([others[k] for k in some])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        hit = np.concatenate(([0], np.cumsum(one[at] == flat)))
        ends = np.cumsum(sizes[some])
        both = hit[ends] - hit[ends - sizes[some]]
        ok[some] = 100 * both >= percent * (sizes[some] + len(one) - both)
    return ok


def links_in(cids: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray, component: np.ndarray, bands: int, percent: int) -> list[tuple[int, int]]:
    """Links that join members of a bucket: confirmed on full sets, row by row, never within what is joined already.

    side: 1 and 2 for members of two blocks, 3 if they are one; pairs within a side are another group's unless it is 3.
    bands: bits of the bands that this bucket stands for; a pair is looked at if the first band that it shares is one.
    """
    n = len(cids)
    joined, out = Joined(component), []
    quads = np.ascontiguousarray(sketch[:, : BANDS * ROWS]).view(np.uint64)
    mine = np.array([bands >> b & 1 for b in range(BANDS)], bool)
    least = COORDINATES * percent / 100 - ERRORS * np.sqrt(COORDINATES * percent / 100 * (1 - percent / 100))
    for x in range(n - 1):
        rest = np.arange(x + 1, n)
        root = joined.all()
        rest = rest[(root[rest] != root[x]) & ((side[rest] != side[x]) | (side[x] == 3))]
        if len(rest):
            rest = rest[(sketch[rest] == sketch[x]).sum(axis=1) >= least]
        if len(rest):
            same = quads[rest] == quads[x]
            rest = rest[mine[np.argmax(same, axis=1)] & same.any(axis=1)]
        if not len(rest):
            continue
        for y in rest[alike(sets[x], [sets[y] for y in rest], percent)]:
            a, b = joined.of(x), joined.of(int(y))
            if a != b:
                joined.root[max(a, b)] = min(a, b)
                out.append((int(cids[x]), int(cids[y])))
    return out


def compared(docs: DataFrame, classes: DataFrame, places: DataFrame, shingle: int, percent: int) -> DataFrame:
    """src, dst: the links in groups of classes. places has cid, key, i, j (which name the group), side, component, bands.

    A group with bands is a block pair of a bucket (see links_in). Without, its centre has side 0 and is compared with
    all others. The sets of a class are made once for each task and sent to each of its groups; groups are dealt to
    tasks by their names.
    """
    place = F.struct("key", "i", "j", "side", "component", "bands")
    listed = places.groupBy("cid").agg(F.collect_list(place).alias("places"))
    ready = listed.join(classes.select("cid", "rk1", "rk2", "sketch"), "cid")
    texts = docs.select("text", "rk1", "rk2").join(ready, ["rk1", "rk2"]).select("text", "cid", "sketch", "places")

    @lean
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            cid = batch.column(1).to_numpy(zero_copy_only=False)
            first = np.sort(np.unique(cid, return_index=True)[1])  # a text that stands in several rows comes once
            first = first[cid[first] != before] if before is not None else first
            before = cid[-1] if len(cid) else before
            for part in slices(batch.take(pa.array(first)), "text", 4 << 20):
                grams, at = shingle_sets(part.column(0), shingle)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), binary_rows(grams, at)], names=["cid", "sketch", "places", "grams"])

    kind = "array<struct<key:bigint,i:int,j:int,side:int,component:bigint,bands:bigint>>"
    rows = texts.mapInArrow(sets_of, f"cid long, sketch binary, places {kind}, grams binary")
    rows = rows.select("cid", "sketch", "grams", F.explode("places").alias("p")).select("p.*", "cid", "sketch", "grams")

    @lean
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, side and class. The centre of a star comes first; only it is kept."""
        name, centre, kept = None, None, []

        def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["src", "dst"])

        def close() -> list[tuple[int, int]]:
            if len(kept) < 2:
                return []
            side, component, bands, cid, sketch, sets = zip(*kept, strict=True)
            table = np.frombuffer(b"".join(sketch), np.uint16).reshape(-1, COORDINATES)
            return links_in(np.array(cid), table, list(sets), np.array(side), np.array(component), bands[0], percent)

        for batch in batches:
            key, i, j, side, component, bands, cid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            begin = np.flatnonzero(new)
            for a, z in zip(begin, np.append(begin[1:], len(key)), strict=True):
                if name != (key[a], i[a], j[a]):
                    if found := close():
                        yield links(found)
                    name, centre, kept = (key[a], i[a], j[a]), None, []
                sets = [np.frombuffer(g, np.uint64) for g in batch.column(8).slice(a, z - a).to_pylist()]
                if bands[a] == 0:
                    if side[a] == 0:
                        centre = (int(cid[a]), sets[0])
                    ok = alike(centre[1], sets, percent) & (cid[a:z] != centre[0])
                    yield links([(centre[0], int(c)) for c in cid[a:z][ok]])
                    continue
                sketch = batch.column(7).slice(a, z - a).to_pylist()
                for k in range(z - a):
                    if not kept or kept[-1][3] != cid[a + k]:
                        kept.append((side[a + k], component[a + k], int(bands[a + k]), int(cid[a + k]), sketch[k], sets[k].copy()))
        if found := close():
            yield links(found)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")
    return written(dealt.mapInArrow(solve, "src long, dst long").distinct(), "near-links")


def star_places(members: DataFrame) -> DataFrame:
    """Groups of a centre and some of the members that meet it, as places (see compared)."""
    pairs = members.filter("cid <> centre").select("cid", "size", "centre").distinct()
    sums = written(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes")), "near-centres")
    parts = F.greatest(F.ceil(F.col("n") / STAR), F.ceil(F.col("sizes") * 8 / GROUP_BYTES)).cast("int")
    centres = sums.select("centre", "n", parts.alias("parts"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    none = F.lit(0).cast("long")
    spoke = counted_join(pairs, centres, ["centre"], "n", total, F.col("cid")).select("cid", F.col("centre").alias("key"), F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("parts")).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), none.alias("component"), none.alias("bands"))
    hub = centres.select(F.col("centre").alias("cid"), F.col("centre").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), none.alias("component"), none.alias("bands"))
    return spoke.unionByName(hub)


def apart_places(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Block pairs of the buckets whose members are in several components, as places (see compared).

    Large components have blocks of their own, which needn't be compared with each other; members of small ones share blocks.
    """
    labelled = members.filter("n > 2").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    per = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("here"), F.sum("size").alias("sizes"))
    per = per.withColumn("own", F.when((F.col("here") > BLOCK / 2) | (F.col("sizes") * 8 > GROUP_BYTES / 2), F.greatest(F.ceil(F.col("here") / BLOCK), F.ceil(F.col("sizes") * 8 / GROUP_BYTES))).otherwise(0).cast("int"))
    small = F.col("own") == 0
    shared = F.greatest(F.ceil(F.sum(F.when(small, F.col("here"))) / BLOCK), F.ceil(F.sum(F.when(small, F.col("sizes"))) * 8 / GROUP_BYTES))
    large = F.array_sort(F.collect_list(F.when(~small, F.struct("component", "own"))))
    buckets = per.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.sum("here").alias("m"), F.coalesce(shared, F.lit(0)).cast("int").alias("shared"), large.alias("large")).filter("components > 1")
    before = F.aggregate("large", F.struct(F.col("shared").alias("at"), F.array().cast("array<struct<component:bigint,first:int,own:int>>").alias("spans")), lambda s, x: F.struct((s["at"] + x["own"]).alias("at"), F.concat(s["spans"], F.array(F.struct(x["component"].alias("component"), s["at"].alias("first"), x["own"].alias("own")))).alias("spans")))
    buckets = written(buckets.withColumn("b", before).select("key", "m", "shared", F.col("b.at").alias("blocks"), F.col("b.spans").alias("spans")), "near-apart")
    total = buckets.agg(F.sum("m")).first()[0] or 0
    rows = counted_join(labelled.select("key", "cid", "bands", "component"), buckets, ["key"], "m", total, F.col("cid"))
    span = F.get(F.filter("spans", lambda s: s["component"] == F.col("component")), F.lit(0))
    rows = rows.withColumn("span", span).withColumn("h", F.xxhash64(F.lit(3), "cid"))
    block = F.when(F.col("span").isNull(), F.pmod("h", "shared")).otherwise(F.col("span.first") + F.pmod("h", "span.own")).cast("int")
    rows = rows.withColumn("block", block)
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("span").isNull() | (j < F.col("span.first")) | (j >= F.col("span.first") + F.col("span.own")))
    rows = rows.select("key", "cid", "bands", "component", "block", F.explode(others).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return rows.select("cid", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "component", "bands")


def class_components(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, component: the components of classes under links; classes without a link are left out."""
    members = bucket_members(classes)
    parts = connected_components(compared(docs, classes, star_places(members), shingle, percent))
    parts = written(parts, "near-parts")
    more = compared(docs, classes, written(apart_places(members, parts), "near-places"), shingle, percent)
    if more.isEmpty():
        return parts
    # The components themselves are linked now.
    of = lambda side: more.withColumnRenamed(side, "node").join(parts, "node", "left").select("*", F.coalesce("component", "node").alias(f"{side}_part")).withColumnRenamed("node", side).drop("component")
    more = of("src")
    more = of("dst")
    joined = written(connected_components(more, "src_part", "dst_part"), "near-joined").select(F.col("node").alias("part"), F.col("component").alias("whole"))
    known = parts.unionByName(joined.select(F.col("part").alias("node"), F.col("part").alias("component")).join(parts.select("node"), "node", "left_anti"))
    return known.join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, rk1, rk2, n_shingles, component (null without shingles), component_id (its least id), kept."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key("doc_id", "text"))
    found = written(features(keyed, shingle), "near-features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk1", "rk2", "sketch")).alias("m")
    classes = found.filter("n_shingles > 0").groupBy("s1", "s2").agg(first, F.max("n_shingles").alias("size"))
    # A class goes by the digest of its set: unlike texts may share an id or have none.
    classes = written(classes.select("s1", "s2", F.col("s1").alias("cid"), F.col("m.doc_id").alias("least"), "m.rk1", "m.rk2", "m.sketch", "size"), "near-classes")
    parts = written(class_components(keyed, classes, shingle, percent).withColumnRenamed("node", "cid"), "near-components")
    low = parts.join(classes.select("cid", "least"), "cid").groupBy("component").agg(F.min("least").alias("low"))
    of_class = classes.select("s1", "s2", "cid", "least").join(parts.join(low, "component"), "cid", "left")
    of_class = of_class.select("s1", "s2", F.coalesce("component", "cid").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("low")).alias("low"))
    out = found.select("doc_id", "rk1", "rk2", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("low"))
    out = out.select("doc_id", "rk1", "rk2", "n_shingles", "component", component_id.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents with three-word shingles and 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, PERCENT).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op3_minhash": op3_minhash}
#: All pairs of unlike sets with a common shingle, and all that can be reached from each set.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(list_slice(w, k, k + 2), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0) x),
doc AS (SELECT r, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS c FROM sh GROUP BY r),
cls AS (SELECT c, min(r) AS r, min(n) AS n FROM doc GROUP BY c),
own AS (SELECT cls.r, cls.n, sh.s FROM cls JOIN sh ON sh.r = cls.r),
link AS (SELECT a.r AS x, b.r AS y FROM own a JOIN own b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, a.n, b.r, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT r AS x, r AS y FROM cls UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
least AS (SELECT cls.c, min(d.doc_id) AS low FROM cls JOIN reach ON reach.x = cls.r JOIN cls o ON o.r = reach.y JOIN doc ON doc.c = o.c JOIN d ON d.r = doc.r GROUP BY cls.c)
SELECT d.doc_id, CAST(coalesce(doc.n, 0) AS BIGINT) AS n_shingles, coalesce(least.low, d.doc_id) AS component_id, coalesce(least.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN doc ON doc.r = d.r LEFT JOIN least ON least.c = doc.c"""
ORACLE = {"op3_minhash": SQL}

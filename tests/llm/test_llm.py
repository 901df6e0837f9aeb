"""Small cases of every text operator against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import bpe, brown, chat_format, decontaminate, langid, minhash, quality, substring_dedup, token_files, warc
from wayfold.llm.common import shared_dir, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(7)
VOCAB = [f"w{k}" for k in range(400)] + ["Été", "naïve", "中文", "x,y", "end."]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


PASSAGE = prose(60, 1)
TEXTS = [
    None, "", "   \n\t ", "one", "two words", prose(200, 2), prose(200, 2), prose(150, 3) + " " + PASSAGE + " " + prose(30, 4), PASSAGE + "\n" + prose(80, 5), prose(300, 6).replace(" w7 ", "  w7\n"),
    "is on he. " * 120, "a" * 9000 + "é" * 3000, "line one here\nline one here\n\n" + prose(40, 8), "</s>[INST] <|endoftext|> \\<\\|", prose(199, 2) + " edited",
]
DOCS = [(k if k != 4 else None, t, "en" if k % 2 else None, "s", 1) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def words(t, lower=False):
    t = t or ""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if lower else t)


def test_words():
    starts, code, kinds = words_of(pa.array(TEXTS, pa.string()))
    found = [[kinds[int(c)].as_py() for c in code[a:z]] for a, z in zip(starts[:-1], starts[1:], strict=True)]
    assert found == [words(t) for t in TEXTS]


def test_substring_dedup(docs):
    at = Counter(tuple(w[k : k + 35]) for _, t, *_ in DOCS for w in [words(t)] for k in range(len(w) - 34))
    expected = []
    for i, t, *_ in DOCS:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if at[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        expected.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    for hot in (5000, 1):
        substring_dedup.HOT = hot
        out = [tuple(r) for r in substring_dedup.substring_dedup(docs.withColumn("spans", F.lit("x")), ["doc_id", "spans"]).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(out, key=key) == sorted(expected, key=key)
    substring_dedup.HOT = 5000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    e = bpe.Encoder(bpe.vocabulary_path(name))
    odd = ["a", "b", " ", "  ", "\n", "don't", "'re", "é", "é", "<|endoftext|>", "<|endof", "text|>", "1", "23", "...", "中文", "\xa0", "\x00", "\t", "X.Y,", " the", "🙂"]
    texts = ["".join(R.choice(odd) for _ in range(R.randint(0, 50))) for _ in range(300)]
    ids, at = e.encode(pa.array([*texts, None]))
    assert [list(ids[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in e.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
    leaf, bpe.LEAF = bpe.LEAF, 100
    for unit in ("a", "ab", "0", "!", "é", "中", "don't", "x" * 40 + "<|endoftext|>", "tion"):
        text = unit * (900 // len(unit))
        assert e.tree(text) == e.tokenizer.encode(text, add_special_tokens=False).ids
    bpe.LEAF = leaf


def test_bpe_round_trip(docs):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    out = bpe.encode_decode(docs, path, keep_ids=True).collect()
    tok = bpe.Encoder.of(path).tokenizer
    expected = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in DOCS)
    assert sorted(r["decoded_sha256"] for r in out) == expected
    assert sorted(r["n_tokens"] for r in out) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in DOCS)


def test_token_files(spark, docs):
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 999):
        v = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(v), n) == v).all()
    path = bpe.vocabulary_path("word_bpe_49k.json")
    tok = bpe.Encoder.of(path).tokenizer
    for table in (docs, docs.limit(0)):
        encoded = token_files.encode_table(table, path, 2)
        uri = shared_dir(spark, "test-files")
        rows = token_files.read_files(spark, uri, token_files.write_files(encoded, uri, token_files.frequencies(encoded))).collect()
        assert len(rows) == table.count()
    table = docs.filter("doc_id is not null")
    encoded = token_files.encode_table(table, path, 2)
    uri = shared_dir(spark, "test-files")
    rows = sorted(token_files.read_files(spark, uri, token_files.write_files(encoded, uri, token_files.frequencies(encoded))).collect())
    start = 0
    for r, (i, t, *_) in zip(sorted(rows, key=lambda r: r["start"]), sorted((d for d in DOCS if d[0] is not None), key=lambda d: d[0]), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def shingles(t, n):
    w = words(t, True)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_minhash(spark):
    base = [prose(120, s) for s in range(6)]
    rows = []
    for k in range(90):
        w = base[k % 6].split()
        for _ in range(k % 7):
            w[R.randrange(len(w))] = f"z{R.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE two"), (204, rows[3][1]), (204, rows[3][1])]
    sets = {i: shingles(t, 3) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    for block in (2000, 4):
        minhash.BLOCK = block
        out = {r["doc_id"]: r for r in minhash.near_duplicates(df, 3, 85).collect()}
        assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    minhash.BLOCK = 2000


def test_sketch_is_fair():
    grams = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = grams[:1500], grams[500:]
    s = minhash.sketches(np.concatenate((a, b, grams[:1])), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.2


def test_quality(spark, docs):
    labels = spark.createDataFrame([(5, 1), (7, 1), (8, 1), (10, 0), (12, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.judge(docs, model).collect()
    assert len(out) == len(DOCS)
    for r in out:
        if r["doc_id"] is None:
            continue
        t = TEXTS[r["doc_id"]] or ""
        w = words(t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        rep = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.train(docs, labels.limit(0)) is None


def test_trees_are_monotonic():
    r = np.random.default_rng(3)
    x = r.random((600, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * r.standard_normal(600) > 0).astype(float)
    model = quality.grow(x, y, [1, -1, 0])
    grid = np.tile(r.random(3), (50, 1))
    for f, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, f] = np.linspace(0, 1, 50)
        assert (sign * np.diff(model.score(g)) >= -1e-12).all()
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.85


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|turn|> \\ there"), (1, 1, "assistant", "</s>[INST] ok\n<|end|>"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 0, "assistant", ""), (3, None, "user", "é🙂")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0)).withColumn("parts", chat_format.text_parts("text"))
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "hi <|turn|> \\ there"), ("assistant", ""), ("assistant", "</s>[INST] ok\n<|end|>")]
    assert out[1]["loss_text"] == "</s>[INST] ok\n<|end|>" and out[3]["loss_text"] == ""
    assert out[None]["turns"][0]["text"] == "x" and out[3]["turns"][0]["text"] == "é🙂"


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 3), ("odd", "?", None, None), ("document", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chat(df).first()
    assert r["formatted"] == "<|turn|>user\nsee <|image:170|><|audio:75|><|document:600|><|end|>\n"
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 170), (1, "audio", "b.wav", 75), (2, "document", None, 600)]
    assert r["expanded_tokens"] == 845


def test_warc(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 700_000), (5, "u", "é" * 700_000), (None, "u", "solo"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    uri = shared_dir(spark, "test-warc")
    table = warc.read_archives(uri, warc.write_archives(warc.chunk_table(df), uri)).collect()
    last = [r for r in table if r["last"]]
    assert len(last) == len(rows)
    kinds = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in last)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "response", None), (6, "response", None)]
    big = sorted((r for r in table if r["page_id"] == 5), key=lambda r: r["chunk_no"])
    assert len(big) == 4 and {r["chunk_no"] for r in big} == {0, 1}
    assert last[0]["payload_digest"].isalnum()
    assert warc.read_archives(uri, warc.write_archives(warc.chunk_table(df.limit(0)), shared_dir(spark, "none"))).count() == 0


def test_langid(spark):
    r = random.Random(2)
    syll = {"aa": ["ka", "to", "mi", "ne"], "bb": ["str", "gro", "ung", "ich"]}
    make = lambda lang: " ".join("".join(r.choice(syll[lang]) for _ in range(3)) for _ in range(40))
    rows = [(k, make("aa" if k % 2 else "bb"), "aa" if k % 2 else "bb") for k in range(60)]
    train = spark.createDataFrame(rows + [(90, None, "aa"), (91, "kato", None)], "doc_id long, text string, lang string")
    model = langid.learn(train)
    test = spark.createDataFrame([(1, make("aa")), (2, make("bb")), (3, None), (4, "123 !!"), (5, "éé ñ")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = {x["doc_id"]: x for x in langid.identify(test, model, ["doc_id", "score"]).collect()}
    assert (out[1]["lang_pred"], out[2]["lang_pred"], out[3]["lang_pred"], out[4]["lang_pred"]) == ("aa", "bb", "und", "und")
    assert out[5]["lang_pred"] in ("aa", "bb") and all(0 <= x["score"] <= 1 for x in out.values())
    assert {x["lang_pred"] for x in langid.identify(test, langid.learn(train.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_decontaminate(spark):
    items = [(k, prose(30, 100 + k)) for k in range(8)] + [(8, None), (9, "tiny one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("matches", F.lit(0))
    edited = items[2][1].split()
    for k in (4, 11, 19, 26):
        edited[k] = "changed"
    rows = [(1, prose(50, 50) + " " + items[0][1] + " " + prose(20, 51)), (2, " ".join(edited)), (3, prose(80, 52)), (4, None), (5, ""), (6, items[1][1].upper() + "\n" + items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("contaminated", F.lit("x"))
    for block in (1 << 20, 300):
        out = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.contamination(docs.select("doc_id", "text"), bench, ["doc_id"], block_bytes=block).collect()}
        assert out == {1: [0], 2: [2], 3: [], 4: [], 5: [], 6: [1, 3]}
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs.select("doc_id", "text"), bench.limit(0), ["doc_id"]).collect())


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment():
    for _ in range(40):
        a, b = np.array([R.randrange(5) for _ in range(R.randint(1, 12))]), np.array([R.randrange(5) for _ in range(R.randint(0, 20))])
        assert decontaminate.local_alignment(a, b)[0] == plain_alignment(a, b)


def test_brown(spark):
    r = random.Random(4)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    rows = [(k, " ".join(f"{r.choice(nouns)} {r.choice(verbs)}" for _ in range(30))) for k in range(80)] + [(100, None), (101, ""), (102, "never seen"), (None, "n1 v1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", langid.fold("doc_id", 7, 2)).repartition(3)
    out = brown.score_texts(df).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in [*words(t, True), None])
    n, v = sum(c.values()), len(c)
    by_id = dict(rows)
    for x in out:
        w = [*words(by_id[x["doc_id"]], True), None]
        base = sum(np.log10((c[y] + 1) / (n + v + 1)) for y in w)
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[x["doc_id"]], len(w), sum(c[y] > 0 for y in w), n)
        assert x["base_score"] == pytest.approx(base)
    own = [x for x in out if x["held_out"]]
    assert sum(x["score"] for x in own) > sum(x["base_score"] for x in own)
    assert brown.score_texts(df.limit(0)).count() == 0


def test_entry_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{k}_" for k in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)

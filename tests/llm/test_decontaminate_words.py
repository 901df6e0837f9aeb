"""Decontamination reads words and aligns regions many at a time: calls do not grow with words, results are those of one by one."""

from __future__ import annotations

import random
import re
import sys

import numpy as np
import pyarrow as pa

from wayfold.llm import decontaminate


def calls(run):
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_no_call_for_a_word():
    few, many = (pa.array([" ".join(f"({k}a{w}," for w in range(n)) for k in range(20)]) for n in (20, 400))
    decontaminate._tokens(few)
    assert calls(lambda: decontaminate._tokens(many)) < 2 * calls(lambda: decontaminate._tokens(few))


def test_no_call_for_a_region():
    r = random.Random(3)
    item = [f"w{k}" for k in range(30)]
    items = decontaminate.Items.of([7], [" ".join(item)])

    def match(n):
        rr = random.Random(n)
        texts = [" ".join(w if rr.random() < 0.9 else "edited" for w in item) for _ in range(n)]
        read, out = decontaminate._tokens(pa.array(texts)), [[] for _ in texts]
        made = calls(lambda: decontaminate._matches(read, items, out))
        assert all([m["item_id"] for m in one] == [7] for one in out)
        return made

    match(r.randint(2, 5))
    assert match(200) < 20 * match(2)


def test_words():
    odd = ["a", "Ab", "ab", "x" * 8, "x" * 9, "y" * 31, "y" * 32, "y" * 33, "Y" * 33, "z" * 70, "é", "É", "(a)", "...", "-", "_" * 17, "." * 40 + "a" + "!" * 40, "a.b", "a\0", "\0", "\x1c", "\x85a", "日本。", "((" + "q" * 8 + "))"]
    r = random.Random(5)
    texts = ["".join(r.choice(odd) + r.choice([" ", "\t", "\r\n", "\x0b", "  "]) for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)] + [None, "", " ", "end", "to end"]
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    plain = [[fold(w.strip(decontaminate._EDGE) or w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    starts, hashed = decontaminate._tokens(pa.array(texts))
    assert np.diff(starts).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, hashed.tolist(), strict=True))) == len(set(flat)) == len(set(hashed.tolist()))
    again = decontaminate._tokens(pa.array(["before it", *texts]).slice(1))
    assert again[0].tolist() == starts.tolist() and again[1].tolist() == hashed.tolist()


def test_alignments_together(monkeypatch):
    r = np.random.default_rng(6)
    items, texts = ([r.integers(0, 5, r.integers(least, 30)).astype(np.uint64) for _ in range(60)] for least in (1, 0))
    alone = [decontaminate.local_alignment(i, t) for i, t in zip(items, texts, strict=True)]
    for cells in (1, 300, 1 << 17):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        assert [tuple(x) for x in decontaminate.local_alignments(items, texts).tolist()] == alone

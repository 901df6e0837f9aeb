"""The stages of the corpus pipeline on small tables."""

from __future__ import annotations

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def near(text, at=60):
    """A copy with one word changed: about 0.95 of its five-word shingles are the same."""
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


def test_near_dedup_goes_by_text(spark):
    a, b, c, d, e, f = (prose(200, s) for s in range(6))
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, near(e)), (None, near(d)), (None, f), (None, near(f)), (9, near(f, 120)), (None, a), (None, a), (3, near(b))]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], SCHEMA).repartition(3)
    out = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert out == {(None, a), (3, near(b)), (None, c), (7, d), (7, e), (9, near(f, 120))}

"""Decontamination finds edited copies of items whose words are all common in the corpus."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wayfold.llm import decontaminate


def plain_share(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max() / (2 * len(a))


@pytest.mark.parametrize("hits", [1 << 20, 40])
def test_common_words(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits, raising=False)
    r = random.Random(11)
    vocab = [f"c{k}" for k in range(12)]
    items = [[r.choice(vocab) for _ in range(24)] for _ in range(2)]
    texts = [items[0][:k] + ["edited"] + items[0][k + 1 :] for k in range(24)]
    for _ in range(8):
        w = list(items[1])
        for k in r.sample(range(24), 4):
            w[k] = "edited"
        texts.append([r.choice(vocab) for _ in range(10)] + w)
    texts += [[r.choice(vocab) for _ in range(40)] for _ in range(60)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    out = {x["doc_id"]: [m["item_id"] for m in x["matches"]] for x in decontaminate.contamination(docs, bench, ["doc_id"]).collect()}
    assert out == {k: [i for i, item in enumerate(items) if plain_share(item, t) >= 0.5] for k, t in enumerate(texts)}
    assert all(out[k] for k in range(32))

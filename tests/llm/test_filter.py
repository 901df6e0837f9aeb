"""The language filter holds every n-gram that its training texts have often enough."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from wayfold.llm import langid


def test_no_ngram_is_left_out(spark):
    r = random.Random(3)
    large = ["".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(4)) for _ in range(16_000)]
    rows = [(k, " ".join(large[k % 8 :: 8]), "zh") for k in range(24)] + [(100, "kato mine " * 3, "aa")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    grams = np.unique(langid.grams_of(pa.array(large))[0])
    k = model.languages.index("zh")
    assert len(grams) > 140_000
    assert (model.languages_of(grams)[:, 0] >> k & 1 == 1).all()
    assert len(model.cells) >= langid.ROOM * len(grams)
    assert model.false_rate[k] < 0.01

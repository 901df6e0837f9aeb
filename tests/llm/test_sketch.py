"""The sketch pre-filter follows the similarity that is asked for."""

from __future__ import annotations

import numpy as np

from wayfold.llm import minhash


def test_prefilter_follows_percent():
    shared = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate((shared, np.arange(1000 * k, 1000 * k + 10, dtype=np.uint64))) for k in range(1, 4)]  # 100 / 120 alike
    sketch = np.tile(np.arange(100, dtype=np.uint16), (3, 1))
    for k in range(3):
        sketch[k, 60:] = 1000 * (k + 1) + np.arange(40)
    found = minhash.links_in(np.arange(3), sketch, sets, np.full(3, 3), np.arange(3), 1, 80)
    assert len(found) == 2


def test_default_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for b in range(4):
        base = [f"w{x}" for x in r.integers(0, 300, 150)]
        for k in range(15):
            w = list(base)
            for at in r.choice(150, k % 5, replace=False):
                w[at] = f"z{r.integers(10**6)}"
            rows.append((100 * b + k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == root

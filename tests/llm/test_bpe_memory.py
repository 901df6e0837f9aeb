"""What a worker holds while it encodes and decodes: bounded, whatever a batch holds."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from wayfold.llm import bpe


class Rows:
    """Stands for a table of doc_id and text; gives the function that encode_decode runs on its batches."""

    class schema:
        def __class_getitem__(cls, _):
            return type("Field", (), {"dataType": type("Long", (), {"simpleString": staticmethod(lambda: "long")})})

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def peak_of(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_spread_of_short_empty_and_long_slices(monkeypatch):
    monkeypatch.setattr(bpe, "SPAN", 10, raising=False)
    r = np.random.default_rng(1)
    values = r.integers(0, 1000, 500).astype(np.uint32)
    for sizes in ([3, 0, 0, 25, 1, 10, 0, 11], [0, 0], [40], [0, 10, 10, 0], r.integers(0, 14, 300)):
        sizes = np.array(sizes, np.int64)
        starts = r.integers(0, 500 - sizes.max(), len(sizes))
        plain = [values[a : a + n] for a, n in zip(starts, sizes, strict=True)]
        out = bpe.spread(values, starts, sizes)
        assert out.dtype == values.dtype and out.tolist() == np.concatenate(plain).tolist()
    assert len(bpe.spread(values, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_spread_takes_little_more_than_its_result():
    values, n = np.arange(256, dtype=np.uint8), 1_000_000
    out, peak = peak_of(lambda: bpe.spread(values, np.zeros(n, np.int64), np.full(n, 8)))
    assert len(out) == 8 * n
    assert peak < 40_000_000  # 8 MB of result and 8 of ends; all places at once took 64 MB more for each copy


def test_a_batch_of_many_bytes_takes_bounded_memory():
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(50_000)) for _ in range(48)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = bpe.encode_decode(Rows(), bpe.vocabulary_path("byte_bpe_50k.json"))
    rows, peak = peak_of(lambda: [x for part in run(iter([batch])) for x in part.to_pylist()])
    assert [x["doc_id"] for x in rows] == [*range(len(texts))]
    assert [x["decoded_sha256"] for x in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert peak < 110_000_000, peak


def test_memory_of_pieces_keeps_those_that_come_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 1000)
    encoder = bpe.Encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    common = [f"often{k}" for k in range(300)]
    for at in range(8):
        text = " ".join(["x", *common, *(f"once{at}x{k}" for k in range(300))])
        ids, to = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and to.tolist() == [0, len(ids)]
        known = set(encoder.known.to_pylist())
        assert len(known) <= 1000 and set(common) <= known

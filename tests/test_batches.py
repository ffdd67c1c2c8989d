"""Functions over Arrow batches hold a few texts at once."""

import pyarrow as pa

from jobscope.functions import batches, keywords


def test_texts_come_in_parts_of_bounded_rows_and_bytes():
    texts = pa.array(["é" * (1 << 20), None, "b" * (3 << 20), ""] + ["x"] * 1000)
    sizes = [len(p) for p in batches.parts(texts)]
    assert sum(sizes) == len(texts) and max(sizes) <= batches.ROWS and sizes[0] == 2
    assert batches.mapped(texts, lambda t: len(t or ""), pa.int64()).to_pylist() == [len(t or "") for t in texts.to_pylist()]
    assert batches.mapped(pa.array([], pa.string()), len, pa.int64()).to_pylist() == []


def test_grams_come_in_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(keywords, "HELD", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, None]), pa.array(["ABCD", None, "xyzxyz", "abc"])], ["id", "text"])
    out = list(keywords.gram_rows(iter([batch])))
    rows = [(r["id"], r["gram"]) for b in out for r in b.to_pylist()]
    assert rows == [(7, "abc"), (7, "bcd"), (9, "xyz"), (9, "yzx"), (9, "zxy"), (None, "abc")] and len(out) > 1

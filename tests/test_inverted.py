"""Posting lists made in batches against plain Python."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcatlas.functions.text import folded, tokens
from srcatlas.operators import inverted

BITS = 2
ROWS = [(k, 3 + k % 4, k % 3, 1 + k % 2, ["\x01pa", "\x01kb"][: k % 3], ["red"] * (k % 3), ["en", f"f{k % 5}", "en"], ["bolt", "red", "É", "red"][: k % 5]) for k in [*range(11), *range(1 << 33, (1 << 33) + 6)]]
NAMES = ["row", "n_tokens", "type", "level", "marks", "name_t", "file_t", "content_t"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.string())] * 4]


def batches(rows, size, names=NAMES, types=TYPES):
    for a in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + size], strict=True), types, strict=True)], names)


@pytest.mark.parametrize("size", [1, 3, 4, 5, 100])
def test_lists_of_whole_blocks(size):
    """However rows come in batches: one list for each term of a block, with each row's positions, and with the most and the least."""
    want = defaultdict(dict)
    for row, n, kind, level, marks, *columns in ROWS:
        for term in {*marks, *(t for c in columns for t in c)}:
            want[term, row >> BITS][row & 3] = (n, kind, level, *([i for i, t in enumerate(c) if t == term] for c in columns))
    made = [r for b in inverted.postings(BITS)(batches(ROWS, size)) for r in b.to_pylist()]
    assert sorted((r["term"], r["block"]) for r in made) == sorted(want)
    for r in made:
        rows = want[r["term"], r["block"]].values()
        assert [r[f"{c}_n"] for c in ("name", "file", "content")] == [max(len(x[k]) for x in rows) for k in (3, 4, 5)]
        assert r["least"] == min(x[0] for x in rows)
        bits = [sum(1 << k for k in range(3) if x[3 + k]) for x in rows]
        assert [r[f"m{m}"] for m in range(1, 8)] == [bits.count(m) for m in range(1, 8)]
    stored = pa.RecordBatch.from_arrays([pa.array([1] * len(made), pa.int32()), *(pa.array([r[c] for r in made], t) for c, t in (("block", pa.int64()), ("term", pa.string()), ("entries", pa.binary())))], ["segment", "block", "term", "entries"])
    got = defaultdict(dict)
    for b in inverted.opened([stored]):
        for r in b.to_pylist():
            got[r["term"], r["block"]][r["off"]] = tuple(r[c] for c in ("n_tokens", "type", "level", "name", "file", "content"))
    assert got == want


def test_rows_that_hold_a_term():
    rows = [(k % 2 + 1, marks, *columns) for k, (*_, marks, a, b, c) in enumerate(ROWS) for columns in [(a, b, c)]]
    got = defaultdict(int)
    for b in inverted.counts(batches(rows, 4, ["segment", *NAMES[4:]], [pa.int32(), *TYPES[4:]])):
        for r in b.to_pylist():
            for m in range(1, 8):
                got[r["segment"], r["term"], m] += r[f"m{m}"]
    want = defaultdict(int)
    for segment, _, *columns in rows:
        for term in {t for c in columns for t in c}:
            want[segment, term, sum(1 << k for k, c in enumerate(columns) if term in c)] += 1
    assert {k: n for k, n in got.items() if n} == want


def test_folded_texts_give_the_tokens_of_a_scan(spark):
    """Letters of all kinds, marks, private use and empty texts, in one batch and in slices of it."""
    every = "".join(chr(c) + (" " if c % 7 == 0 else "") for c in range(1, 0x3000) if chr(c).isprintable() or c < 0x20)
    texts = [None, "", "red_bolt", "Éan ǢǾ Ǯx", "áb", "x-\U0001f600y\U00010400", "x" * 50, "...", every, *every.split(" ")]
    df = spark.createDataFrame([(k, t, "f.py", "") for k, t in enumerate(texts)], "row int, name string, file string, content string").coalesce(1)
    want = [r.t for r in df.select("row", tokens(F.col("name")).alias("t")).orderBy("row").collect()]
    batch = df.select("row", *(folded(F.col(c)).alias(f"{c}_t") for c in ("name", "file", "content"))).orderBy("row").toArrow().combine_chunks().to_batches()[0]
    got = [r for a in range(0, len(texts), 7) for b in inverted.words([batch.slice(a, 7)]) for r in b.to_pylist()]
    assert [r["name_t"] for r in got] == want
    assert [r["n_tokens"] for r in got] == [len(t) + 2 for t in want]


def test_sizes_of_a_task_and_of_segments():
    """The rows and tokens of an index come from the pass that makes the lists."""
    texts = [("red bolt", "f.py", ""), ("", "g", "é"), ("red", "f.py", "a b c")]
    columns = [pa.array(c) for c in zip(*texts, strict=True)]
    head = [pa.array(list(range(3)), pa.int64()), pa.array([0] * 3, pa.int32()), pa.array([0] * 3, pa.int32()), pa.array([[]] * 3, pa.list_(pa.string()))]
    batch = pa.RecordBatch.from_arrays([*head, *columns], ["row", "type", "level", *NAMES[4:]])
    sizes = [(r["m1"], r["m2"]) for b in inverted.sized(BITS)(iter([batch])) for r in b.to_pylist() if r["term"] == inverted.SIZE]
    assert sizes == [(3, 12)]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 2, 4], pa.int32()), head[-1], *columns], ["segment", *NAMES[4:]])
    sizes = {r["segment"]: (r["m1"], r["m2"]) for b in inverted.sized_counts(iter([batch])) for r in b.to_pylist() if r["term"] == inverted.SIZE}
    assert sizes == {4: (2, 10), 2: (1, 2)}

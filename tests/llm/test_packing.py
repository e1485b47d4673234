import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcatlas.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


def check_plan(lengths, counts, capacity):
    plan = packing.solve(np.array(lengths), np.array(counts), capacity)
    used = Counter()
    for times, ls, multiple in plan:
        assert times > 0 and int(ls @ multiple) <= capacity
        for a, m in zip(ls.tolist(), multiple.tolist(), strict=True):
            used[a] += times * m
    assert used == Counter(dict(zip(lengths, counts, strict=True)))
    return sum(t for t, _, _ in plan)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 300), min_size=1, max_size=20))
def test_plans_use_every_piece_once(h):
    check_plan(list(h), list(h.values()), 60)


def test_few_sequences():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(6.2, 1.0, 20000).astype(int) + 1, 4096)
    a, n = np.unique(sizes, return_counts=True)
    made = check_plan(a.tolist(), n.tolist(), 4096)
    assert made <= 1.004 * -(-int(sizes.sum()) // 4096)
    assert check_plan([2049], [50], 4096) == 50
    assert check_plan([2048, 1024], [10, 20], 4096) == 10


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = np.unique(rng.integers(2, 12, 4))
        price = rng.random(len(a))
        table = packing.knapsack(a, price, 23)
        best = np.zeros(24)
        for c in range(1, 24):
            best[c] = max([best[c - 1], *(best[c - x] + p for x, p in zip(a, price, strict=True) if x <= c)])
        assert np.allclose(table[0], best)
        at, m, room = packing.layout(table, a, price, np.full(len(a), 30), np.ones(len(a)), rng)
        assert int(m @ a[at]) + room == 23 and m @ price[at] >= (1 - packing.LOSS) * best[23] - 1e-9


def test_query_over_all_documents(spark, sf_dir):
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.query(spark, sf_dir).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(own) == set(docs)
    for i, text in docs.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(own[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 4096))
        for r in parts:
            assert r.length == min(4096, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in rows) // 4096) + 1


def test_odd_rows(spark):
    path = bpe.default_vocabulary()
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (3, "word " * 9000, 0), (3, "word " * 9000, 0), (4, "a", 0)], "doc_id long, text string, length int")
    out = packing.pack(df, path, with_ids=True).collect()
    assert sorted(r.length for r in out) == [1, 1, 2, 809, 809, 4096, 4096, 4096, 4096]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and len({r.sequence_id for r in out}) == 5
    assert packing.pack(df.limit(0), path).count() == 0


def best_fit(lengths, counts, capacity, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(packing, "ROUNDS", 0)
        plan, _, share = packing.solved(lengths, counts, capacity)
    assert share == 0
    return sum(t for t, _, _ in plan)


def test_many_lengths_without_fillers(monkeypatch):
    for lo, hi, pieces, capacity in ((225, 475, 1500, 1024), (900, 1900, 6000, 4096)):
        a, n = np.unique(np.random.default_rng(3).integers(lo, hi, pieces), return_counts=True)
        made = check_plan(a.tolist(), n.tolist(), capacity)
        _, bound, share = packing.solved(a, n, capacity)
        assert -(-int(a @ n) // capacity) <= bound <= made <= 1.04 * bound and share > 0.85
        assert made <= 0.95 * best_fit(a, n, capacity, monkeypatch)


def test_the_linear_program_places_nearly_all(monkeypatch):
    """Lengths of real documents, once and a hundredfold."""
    import os

    import duckdb

    if not os.path.exists("/root/testdata/sf0.01/documents.parquet"):
        pytest.skip("no test tables")
    e = bpe.encoder_of(bpe.file_content(bpe.default_vocabulary()), library=True)
    found = Counter()
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        n = len(e.encode((text or "").encode())) // 4 + 1
        found.update([4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0))
    a, n = np.array(sorted(found)), np.array([found[k] for k in sorted(found)])
    for times in (1, 100):
        plan, bound, share = packing.solved(a, times * n)
        made = sum(t for t, _, _ in plan)
        assert share > 0.98 and made <= best_fit(a, times * n, 4096, monkeypatch) and made <= 1.001 * bound + 1


def test_never_more_sequences_than_best_fit():
    """Also where layouts leave much room, and where the fullest layouts use up what the rest needs."""
    rng = np.random.default_rng(0)
    sets = {
        "room in every layout": [1366] * 300 + [1025] * 200 + [2049] * 250,
        "few fillers": 4 * np.clip(rng.lognormal(5.8, 0.6, 1500).astype(int) + 1, 1, 1024),
        "no fillers": 16 * rng.integers(63, 127, 1500),
    }
    for name, lengths in sets.items():
        a, n = np.unique(lengths, return_counts=True)
        made = check_plan(a.tolist(), n.tolist(), 4096)
        plain = packing.best_fit(a.astype(np.int64), n.astype(np.int64).copy(), 4096)
        assert made <= sum(t for t, _, _ in plain), name

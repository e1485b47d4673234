import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from srcatlas.llm import toxicity

SCHEMA = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int, quality int"
BAD = ["grumbok", "zarfling", "snorvil"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "re") for b in ("ka", "so", "ne", "vu", "") for c in ("n", "r", "s", "lt", "")]
    docs = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic = int(rng.random() < 0.15)
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((k, " ".join(w), toxic))
    return docs


def test_held_out_accuracy(spark):
    docs = corpus(1500)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], SCHEMA)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in docs], LABELS)
    truth = {i: y for i, _, y in docs}
    out = toxicity.score(df, labels).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97


def test_held_out_labels_are_not_learned(spark):
    docs = corpus(300)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], SCHEMA)
    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = [(i, y, 0) for i, _, y in docs]
    flipped = [(i, 1 - y if i in held else y, 0) for i, _, y in docs]
    one, two = ({r.doc_id: r.score for r in toxicity.score(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert one == two


def test_score_depends_on_text_alone(spark):
    docs = corpus(300)
    extra = [(9001, docs[3][1], "a"), (9002, docs[3][1], None), (None, docs[3][1], "b"), (9003, None, ""), (9004, "", ""), (9005, "?!", "")]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + extra, SCHEMA)
    out = toxicity.score(df, spark.createDataFrame([(i, y, 0) for i, _, y in docs] + [(None, 1, 0), (5, None, 0), (6, 7, 0)], LABELS)).collect()
    score = {r.doc_id: r.score for r in out}
    assert score[9001] == score[9002] == score[None] == score[3]
    assert score[9003] == score[9004] == score[9005]
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b c", ""), (2, None, "")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in toxicity.score(df, none).collect()] == [0, 0]
    assert toxicity.score(df.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, one).collect())


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = corpus(200)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], SCHEMA)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in docs], LABELS)
    small = {r.doc_id: r.score for r in toxicity.score(df, labels).collect()}
    monkeypatch.setattr(toxicity, "LABELS_BROADCAST", 10)
    assert {r.doc_id: r.score for r in toxicity.score(df, labels).collect()} == small


def spread(n, seed=5):
    """Toxic rows hold words of their own, and ordinary rows others that are as rare: each is seen in about two training rows."""
    rng = random.Random(seed)
    names = [f"{z}{a}{b}{c}" for z in ("zu", "qo", "fi", "wa", "hy") for a in "bdfgk" for b in "aeiou" for c in "lmnprst"]
    rng.shuffle(names)
    cut = len(names) // 5
    docs = []
    for i, text, _ in corpus(n, seed):
        toxic = int(i % 5 == 0)
        docs.append((i, " ".join([*text.split()[:20], *(rng.choice(names[:cut] if toxic else names[cut:]) for _ in range(3))]), toxic))
    return docs


def test_rare_markers_are_evidence(spark):
    docs = spread(700)
    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    out = toxicity.score(spark.createDataFrame([(i, t, "x") for i, t, _ in docs], SCHEMA), spark.createDataFrame([(i, y, 0) for i, _, y in docs], LABELS)).collect()
    got = {r.doc_id: r.predicted for r in out}
    toxic = [got[i] for i, _, y in docs if y and i in held]
    clean = [got[i] for i, _, y in docs if not y and i in held]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.1


@pytest.mark.parametrize("bits", [28, 3])
def test_counts_are_exact_over_chunks_and_cells(bits, monkeypatch):
    monkeypatch.setattr(toxicity, "KEY_BITS", bits)  # with 3 bits nearly every key that is asked for has several candidates
    rng = np.random.default_rng(4)
    words = np.concatenate([np.zeros(1, np.uint64), np.unique(rng.integers(1, 2**44, 3000).astype(np.uint64))])
    held, truth = [], Counter()
    for k in range(3):
        seq = rng.integers(1, len(words), 20000).astype(np.uint32)
        first, groups = np.arange(0, 20001, 100), rng.integers(-1, 4, 200).astype(np.int32)
        keys, seq = np.unique(seq, return_inverse=True)
        seq, times = seq + 1, np.bincount(seq)
        own = np.concatenate([[0], keys])  # index in this chunk to index in words
        rank = np.empty(len(keys), np.uint32)
        rank[np.argsort(-times, kind="stable")] = np.arange(1, len(keys) + 1)
        row = {"chunk": k, "keys": toxicity.ascending(words[keys]), "times": toxicity.packed(times.astype(np.uint32)), "seq": toxicity.packed(rank[seq - 1]), "first": toxicity.packed(np.diff(first).astype(np.uint32)), "groups": toxicity.packed(groups), "rows": b""}
        seq = own[seq]
        held.append(row)
        for at, w in enumerate(seq.tolist()):
            if groups[at // 100] >= 0:
                truth[0 if at % 100 == 0 else int(seq[at - 1]), w, int(groups[at // 100])] += 1
    parts = 7
    cells = pa.Table.from_batches(list(toxicity.pairs(parts)(iter([pa.RecordBatch.from_pylist(held)]))))
    merged = [r for c in set(cells["cell"].to_pylist()) for r in toxicity.add_pairs(parts)(cells.filter(pc.equal(cells["cell"], c))).to_pylist()]
    at = {int(h): k for k, h in enumerate(words.tolist())}
    for row in held:
        chunk = toxicity.Chunk(row, parts)
        answers = {r["part"]: r for r in merged if r["kind"] == "a" and r["chunk"] == row["chunk"]}
        mine = chunk.counts()
        for cell, a, b in toxicity.cuts(chunk.cell):
            n = toxicity.counts_of_pairs(chunk, a, b, answers[cell], mine)
            assert all(n[g, k - a] == truth[at[int(chunk.words[chunk.v[k]])], at[int(chunk.words[chunk.w[k]])], g] for k in range(a, b) for g in range(4))
    continuations = Counter()
    for r in merged:
        if r["kind"] == "w":
            n = toxicity.unpacked(r["value"], np.int64).reshape(4, -1)
            for k, h in enumerate(toxicity.ascended(r["words"]).tolist()):
                continuations[at[h]] += int(n[3, k])
    assert continuations == Counter(w for _, w in {(v, w) for v, w, g in truth if g % 2})


def test_discounts_stay_below_their_counts():
    d = toxicity.discounts(np.array([[100, 40, 20, 12, 90, 500], [0, 0, 0, 0, 0, 0], [5, 0, 9, 1, 9, 40]]))
    assert (d[:, 1:] > 0).all() and (d[:, 1:] < [1, 2, 3]).all()
    y = 100 / 180
    assert np.allclose(d[0, 1:], [1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6])


def test_a_pair_of_the_same_key_changes_nothing(spark):
    """The pairs "ano amz" and "adi bhu" have the last 32 bits of their hashes in common."""
    docs = corpus(300)
    asked = next(i for i in range(10000, 10100) if zlib.crc32(str(i).encode()) % 4 == 2)
    got = []
    for pair in ("ano amz", "ano awz"):
        rows = [(i, f"{t} {pair}" if y and zlib.crc32(str(i).encode()) % 4 != 2 else t, "x") for i, t, y in docs] + [(asked, "adi bhu", "x")]
        out = toxicity.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, y, 0) for i, _, y in docs], LABELS)).collect()
        got.append(next(r.score for r in out if r.doc_id == asked))
    assert abs(got[0] - got[1]) < 1e-9  # the rows of the fit come in another order


def by_hand(docs):
    """Scores from dictionaries of counts, word by word."""
    rest = {i: zlib.crc32(str(i).encode()) % 4 for i, _, _ in docs}
    texts = {i: t.split() for i, t, _ in docs}
    pairs = {i: list(zip(["", *w[:-1]], w)) for i, w in texts.items()}
    every = Counter(w for t in texts.values() for w in t)
    tokens, vocabulary = sum(every.values()), len(every)

    def model(rows, toxic):
        n = Counter(p for i, _, y in docs if i in rows and y == toxic for p in pairs[i])
        before, after, times = Counter(w for _, w in n), {}, Counter()
        for (v, _), x in n.items():
            after.setdefault(v, Counter())[min(x, 3)] += 1
            times[v] += x

        def discount(values):
            c = [sum(x == j for x in values) for j in (1, 2, 3, 4)]
            y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
            return [0.0] + [min(max(j - (j + 1) * y * c[j] / c[j - 1] if c[j - 1] else y, 0.05), 0.95 * j) for j in (1, 2, 3)]

        d, low = discount(n.values()), discount(before.values())
        free, total = sum(low[min(x, 3)] for x in before.values()), sum(before.values())

        def p(v, w):
            base = (every[w] + 0.5) / (tokens + 0.5 * vocabulary)
            lower = (before[w] - low[min(before[w], 3)] + free * base) / total
            if not times[v]:
                return lower
            return (n[v, w] - d[min(n[v, w], 3)]) / times[v] + sum(d[j] * after[v][j] for j in (1, 2, 3)) / times[v] * lower

        return p

    def features(i, toxic, ordinary):
        r = [math.log(toxic(*x)) - math.log(ordinary(*x)) for x in pairs[i]]
        k = toxicity.PASSAGE
        passages = [r[a : a + k] for a in range(max(len(r) - k, 0) + 1)]
        worst = sorted(r)[::-1][:5]
        return [sum(r) / len(r), max(sum(x) / len(x) for x in passages), sum(worst) / len(worst), max(r), math.log1p(len(r))]

    early, full = ([model({i for i in rest if rest[i] in own}, y) for y in (1, 0)] for own in ((0, 1), (0, 1, 3)))
    seen = [(features(i, *early), y) for i, _, y in docs if rest[i] == 3]
    x, y = np.array([f for f, _ in seen]), np.array([y for _, y in seen], float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    beta = toxicity.fit((x - centre) / scale, y)
    return {i: 1 / (1 + math.exp(-(beta[0] + (np.array(features(i, *full)) - centre) / scale @ beta[1:]))) for i in rest}


def test_scores_equal_those_counted_by_hand(spark):
    docs = corpus(240, seed=8) + [(5000, " ".join(["talon mi grumbok"] * 4000), 0)]  # a long text, and repeated rows below
    docs += [(6000, docs[7][1], docs[7][2])]
    want = by_hand(docs)
    out = toxicity.score(spark.createDataFrame([(i, t, "x") for i, t, _ in docs], SCHEMA), spark.createDataFrame([(i, y, 0) for i, _, y in docs], LABELS)).collect()
    assert len(out) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-4 for r in out)


def test_rounds_leave_little_on_disk(spark, monkeypatch):
    """No write of answers holds most of them, and chunks and answers go as they are used."""
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    folders, written, left = [], {}, []

    def watched(make):
        def run(df, name, *args, **kw):
            if name == "toxicity":
                left.append(sum(map(size, folders)))
            out = make(df, name, *args, **kw)
            if name != "toxicity":
                folders.append(out._scratch)
            written.setdefault(name, []).append(size(out._scratch))
            return out

        return run

    monkeypatch.setattr(toxicity, "materialize", watched(toxicity.materialize))
    monkeypatch.setattr(toxicity, "bucketed", watched(toxicity.bucketed))
    docs = corpus(400)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], SCHEMA).repartition(8)
    assert toxicity.score(df, spark.createDataFrame([(i, y, 0) for i, _, y in docs], LABELS)).count() == len(docs)
    for name in ("toxicity-pairs", "toxicity-words", "toxicity"):
        assert max(written[name]) < 0.5 * sum(written[name]), name
    assert left[-1] < 0.5 * left[0] and not sum(map(size, folders))


def test_rounds_send_every_pair_once():
    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(1, 2**44, 500).astype(np.uint64))
    seq = np.concatenate([np.arange(len(words)), rng.integers(0, len(words), 4000)])
    times = np.bincount(seq)
    rank = np.empty(len(words), np.uint32)
    rank[np.argsort(-times, kind="stable")] = np.arange(1, len(words) + 1)
    row = {"chunk": 1, "keys": toxicity.ascending(words), "times": toxicity.packed(times.astype(np.uint32)), "seq": toxicity.packed(rank[seq]), "first": toxicity.packed(np.array([len(seq) - 100, 0, 100], np.uint32)), "groups": toxicity.packed(np.array([2, -1, -1], np.int32)), "rows": b""}
    sent = lambda parts, *cells: [r for b in toxicity.pairs(parts, *cells)(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
    for parts in (2, 7, 16):  # with 2 cells some rounds have none
        assert [r for k in range(toxicity.ROUNDS) for r in sent(parts, toxicity.part_of(parts, k))] == sent(parts)

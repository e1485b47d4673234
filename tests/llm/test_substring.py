import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from srcatlas.llm import substring
from tests.oracle import same

SCHEMA = "doc_id long, text string, n_words string, id int"


def brute(docs, window=20):
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone[s : s + window] = [True] * window
            seen.add(g)
        kept = " ".join(x for x, d in zip(w, gone, strict=True) if not d)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.h) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()}


def made(seed):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [[rng.choice(words) for _ in range(rng.randint(0, 40))]]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), [rng.choice(words) for _ in range(rng.randint(0, 25))]]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(x for p in parts for x in p)))
    docs += [(60, "same " * 100), (61, "same " * 45), (62, "a b " * 60), (63, docs[5][1]), (64, docs[5][1] + " tail"), (65, None), (66, ""), (67, " ".join(words[:19])), (68, " ".join(words[:19]))]
    return docs


def test_query_equals_sql(spark, sf_dir):
    same(substring.query(spark, sf_dir), substring.SQL, sf_dir)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = made(seed)
        df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], SCHEMA)
        assert found(substring.dedup(df, batch_bytes=4000)) == brute(docs)


def test_spans_and_carried_columns(spark):
    docs = made(3)
    df = spark.createDataFrame([(i, t, f"n{i}", 3) for i, t in docs], SCHEMA)
    for r in substring.dedup(df, carry=("text",), batch_bytes=4000).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        gone = {k for s in r.removed for k in range(s.start, s.end)}
        assert len(gone) == r.n_removed and " ".join(x for k, x in enumerate(w) if k not in gone) == r.kept_text


def test_index_over_calls(spark, tmp_path, monkeypatch):
    """Loads one by one; runs are compacted, and their ranges split."""
    docs = made(5)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], SCHEMA)
    index = substring.FingerprintIndex(spark, f"{tmp_path}/{time.time()}")
    got = {}
    for lo, hi in [(0, 20), (20, 35), (35, 45), (45, 99)]:
        got |= found(substring.dedup(df.filter(f"doc_id >= {lo} and doc_id < {hi}"), batch_bytes=4000, index=index))
        monkeypatch.setattr(substring, "RANGE", 20)
    assert len(index.live()) == 2 and index.manifest()["bits"] > 5
    index.compact()
    assert len(index.live()) == 1 and got == brute(docs)
    again = substring.dedup(df, index=index)
    assert all(r.n_removed == r.n_words for r in again.collect() if r.n_words >= 20)


def test_words_that_a_polynomial_takes_for_equal(spark):
    """Thue-Morse words have one value under any polynomial with an odd base modulo 2**64."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"h{k}" for k in range(19))
    df = spark.createDataFrame([(1, f"{head} {one}", "", 0), (2, f"{head} {two}", "", 0)], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring.dedup(df).collect()} == {1: 0, 2: 0}


def test_one_id_of_several_batches(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(rng.choice(base) for _ in range(60)), "", 0) for _ in range(3)]
    hot = [" ".join(base[k : k + 40]) for k in (0, 50, 0, 100, 5)]
    rows += [(5, t, "", 0) for t in hot * 4] + [(None, hot[0], "", 0), (None, hot[0], "", 0), (7, hot[1], "", 0)]
    # One id: row 5.. starts five words into row 0, so only windows that start later than their first occurrence go.
    for size in (150, 400, 10**6):
        out = substring.dedup(spark.createDataFrame(rows, SCHEMA), batch_bytes=size, loads=2, carry=("text",)).collect()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_removed) for r in out if r.doc_id != 1)
        want = [(False, 5, t, 0 if t != hot[0] else 35) for t in hot * 4] + [(True, 0, hot[0], 40)] * 2 + [(False, 7, hot[1], 40)]
        assert got == sorted(want)


def test_layout_stays_where_nothing_is_removed(spark):
    long = " ".join(f"x{k}" for k in range(50000))
    rows = [(1, "a \n b", "", 0), (2, None, "", 0), (3, long, "", 0), (4, "y " + long, "", 0)]
    got = {r.doc_id: r.kept_text for r in substring.dedup(spark.createDataFrame(rows, SCHEMA), layout=True).collect()}
    assert got == {1: "a \n b", 2: None, 3: long, 4: "y"}


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = " ".join(f"x{k}" for k in range(25))
    df = spark.createDataFrame([(None, text, "", 1), (7, text, "", 1), (7, text, "", 1), (9, text, "", 1)], SCHEMA)
    out = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring.dedup(df).collect())
    assert out == [(False, 7, 0), (False, 7, 0), (False, 9, 25), (True, 0, 25)]
    assert substring.dedup(df.limit(0)).count() == 0

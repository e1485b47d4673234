import random
from collections import Counter, defaultdict

from srcatlas.llm import jaccard

SCHEMA = "doc_id long, text string, class_id long, n_links string"


def brute(docs, k=5, t=0.8):
    """doc -> (copy_of, class_id, n_copies, n_links), by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = (text or "").split()
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else None
    copies = defaultdict(list)
    for i, s in sets.items():
        copies[s if s is not None else i].append(i)
    reps = [(min(v), s) for s, v in copies.items() if isinstance(s, frozenset)]
    parent = list(range(len(reps)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    links, index = Counter(), defaultdict(list)
    for i, (_, s) in enumerate(reps):
        shared = Counter(j for g in s for j in index[g])
        for j, n in shared.items():
            if n / (len(s) + len(reps[j][1]) - n) >= t - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
        for g in s:
            index[g].append(i)
    low = {}
    for i in range(len(reps)):
        low[root(i)] = min(low.get(root(i), 1 << 60), reps[i][0])
    out = {i: (i, i, 1, 0) for i in sets}
    for i, (rep, s) in enumerate(reps):
        for d in copies[s]:
            out[d] = (rep, low[root(i)], len(copies[s]), links[i])
    return out


def found(df):
    return {r.doc_id: (r.copy_of, r.class_id, r.n_copies, r.n_links) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(jaccard.query(spark, sf_dir)) == brute(docs)


def test_groups_of_near_copies(spark, monkeypatch):
    """Groups beyond one tile, chains of copies, and a passage that all share."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    docs, n = [], 0
    passage = [f"p{k}" for k in range(12)]
    for _ in range(4):
        base = [rng.choice(words) for _ in range(90)]
        for _ in range(45):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((n, " ".join(own + (passage if rng.random() < 0.5 else []))))
            n += 1
    chain = [rng.choice(words) for _ in range(120)]
    for k in range(30):  # neighbours are near, the ends are not
        chain[4 * k] = f"c{k}"
        docs.append((n, "\n ".join(chain)))
        n += 1
    for _ in range(40):
        docs.append((n, " ".join([rng.choice(words) for _ in range(60)] + passage)))
        n += 1
    df = spark.createDataFrame([(i, t, None, "x") for i, t in docs], SCHEMA)
    assert found(jaccard.near_duplicates(df)) == brute(docs)


def test_odd_texts(spark):
    long = " ".join(f"a{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "two one"), (7, long), (8, long + " end"), (9, "a b c d e"), (None, "one two"), (9, "a b c d e")]
    df = spark.createDataFrame([(i, t, 5, "y") for i, t in rows], SCHEMA)
    out = jaccard.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.copy_of, r.class_id, r.n_copies, r.n_links) for r in out}
    assert got[1] == (1, 1, 1, 0) and got[2] == (2, 2, 1, 0) and got[3] == (3, 3, 1, 0)
    assert got[5] == (4, 4, 2, 0) and got[6] == (6, 6, 1, 0)
    assert got[8] == (8, 7, 1, 1) and got[9] == (9, 9, 2, 0) and got[None][1] is None
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_posterior():
    for n in (16, 64, 160):
        m = jaccard.least_matches(n, 0.8, 1e-7)
        # Beta(m + 1, n - m + 1) tail by numeric integration
        import numpy as np

        x = np.linspace(0, 1, 200001)[1:-1]

        def tail(k):
            logp = k * np.log(x) + (n - k) * np.log(1 - x)
            p = np.exp(logp - logp.max())
            return p[x >= 0.8].sum() / p.sum()

        assert tail(m) >= 1e-7 * 0.9 and (m == 0 or tail(m - 1) < 1e-7 * 1.1)


def test_words_that_a_polynomial_takes_for_equal(spark):
    """Thue-Morse words have one value under any polynomial with an odd base modulo 2**64."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    out = jaccard.near_duplicates(spark.createDataFrame([(1, one, None, ""), (2, two, None, "")], SCHEMA)).collect()
    assert {r.doc_id: (r.copy_of, r.class_id, r.n_copies, r.n_links) for r in out} == {1: (1, 1, 1, 0), 2: (2, 2, 1, 0)}


def test_exact_sets_do_not_hash():
    import pyarrow as pa

    texts = ["a b c d e f", "a b c d e f a b c d e", None, "", "x y", "x  y", "b c d e f a", "a b c d e"]
    sets = [set(s.tolist()) for s in jaccard.exact_sets(pa.array(texts), 5)]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    for a, x in zip(sets, shingles, strict=True):
        for b, y in zip(sets, shingles, strict=True):
            assert len(a & b) == len(x & y) and len(a) == len(x)


def test_ids_with_several_texts(spark):
    """All rows of an id are in one class, whichever rows there are beside them, and runs agree."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (5, c + " tail")]
    runs = []
    for order in (rows, rows[::-1]):
        out = jaccard.near_duplicates(spark.createDataFrame([(i, t, None, "") for i, t in order], SCHEMA)).collect()
        assert len(out) == len(rows)
        runs.append(sorted((r.doc_id, r.copy_of, r.class_id, r.n_copies, r.n_links) for r in out))
    assert runs[0] == runs[1] and len({x for x in runs[0] if x[0] == 1}) == 1
    assert {x[2] for x in runs[0] if x[0] in (4, 5)} == {4} and len({x[2] for x in runs[0] if x[0] in (2, 3)} & {1}) == 1


def test_recall_at_size(spark):
    """2000 documents with a planted copy each, at similarities around the threshold: links as by brute force."""
    rng = random.Random(11)
    docs = []
    for i in range(0, 4000, 2):
        w = [f"{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120))]
        docs.append((i, " ".join(w)))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i + 1, " ".join(w)))
    assert found(jaccard.near_duplicates(spark.createDataFrame([(i, t, None, "") for i, t in docs], SCHEMA))) == brute(docs)

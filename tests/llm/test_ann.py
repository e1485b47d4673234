import numpy as np

from srcatlas.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(ids, x, q, k):
    i = int(np.flatnonzero(ids == q)[0])
    s = (x * x[i]).sum(axis=1)
    other = ids != q
    order = np.lexsort((ids[other], -s[other]))[:k]
    return list(zip(ids[other][order].tolist(), s[other][order].tolist(), strict=True))


def test_recall_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    found = ann.query(spark, sf_dir).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        want, got = brute(ids, x, q, 20), found[found.query_id == q].sort_values("rank")
        assert list(got["rank"]) == list(range(1, len(want) + 1))
        hits, total = hits + len({a for a, _ in want} & set(got.vec_id)), total + len(want)
        exact = dict(zip(ids.tolist(), (x * x[ids == q][0]).sum(axis=1), strict=True))
        assert all(abs(exact[v] - s) < 1e-12 for v, s in zip(got.vec_id, got.score, strict=True))
        assert all((-a[1], a[0]) <= (-b[1], b[0]) for a, b in zip(got[["vec_id", "score"]].values, got[["vec_id", "score"]].values[1:]))
    assert hits / total >= 0.9


def test_recall_on_many_vectors():
    """Vectors without any structure, the hardest case, in blocks as the operator makes them; 7 % of each block are reranked."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, q = np.arange(50000), np.arange(0, 50000, 400)
    pivots = x[rng.permutation(50000)[: ann.PIVOTS]]
    parts = [ann.search_block(q, x[q], ids[b::2], x[b::2], pivots, 20, ann.SHARE, ann.LEAST) for b in (0, 1)]
    of, vec, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    hits = 0
    for i in q:
        mine = of == i
        got = vec[mine][np.lexsort((vec[mine], -score[mine]))[:20]]
        hits += len({a for a, _ in brute(ids, x, i, 20)} & set(got.tolist()))
    assert hits / (20 * len(q)) >= 0.9


def test_inverted_files():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    orders = ann.nearest_pivots(x, x[:40], 10)
    files = ann.inverted_files(orders, 40)
    assert sum(len(v) for v, _ in files) == 300 * 10
    assert all(orders[v, k] == p for p, (vector, place) in enumerate(files) for v, k in zip(vector, place, strict=True))


def test_copies_and_rows_that_take_no_part(spark):
    v = [float(k % 7 - 3) for k in range(8)]
    rows = [(k, v, "x") for k in range(60)]  # one vector for all
    rows += [(100, None, None), (101, [0.0] * 8, ""), (102, [None, *v[1:]], ""), (103, [float("nan"), *v[1:]], ""), (104, [float("inf"), *v[1:]], ""), (105, v[:3], ""), (None, v, ""), (0, v, "again"), (106, [], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ann.knn(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {0, 20, 40}
    for q in (0, 20, 40):
        assert [r.vec_id for r in out if r.query_id == q] == [k for k in sorted([0, *range(21)]) if k != q][:20]  # two rows have id 0


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [2.0, 1.0], ""), (20, [-1.0, 0.0], "")], SCHEMA)
    out = ann.knn(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
    assert ann.knn(df.limit(0), df, 5).count() == 0

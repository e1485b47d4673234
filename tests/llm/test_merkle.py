import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from srcatlas.llm import merkle
from srcatlas.llm.merkle import TOP, Forest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, part long"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    """All levels of a tree, by plain recursion."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, index):
    out = []
    for level in tree[:-1]:
        run = level[index // 16 * 16 : index // 16 * 16 + 16]
        out.append((index % 16, run[: index % 16] + run[index % 16 + 1 :]))
        index //= 16
    return out


def brute(docs):
    """The query's rows, by the definition."""
    leaf = lambda d, text: h(*map(field, (*d[:4], text)))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, leaf(d, d[4]), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, d) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, k)
            bad = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            now = leaf(d, lower(d[4])) if bad else own
            for place, others in steps:
                now = h(*others[:place], now, *others[place:])
            out.append((d[0], own, trees[s][-1][0], top[-1][0], h(*(x for _, o in steps for x in o)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    return query_rows(merkle.hashed(df))


def query_rows(leaves):
    proven = merkle.manifest(leaves, "source", "doc_id", "leaf", ["suspect"])
    rows = proven.withColumn("folded", merkle.folded(F.coalesce("suspect", "leaf"), F.col("proof"))).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, h(*(p.siblings for p in r.proof)), r.folded, r.folded == r.root) for r in rows), key=repr)


def made(sizes, seed=0):
    rng = random.Random(seed)
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    return [(next(ids), s, rng.choice(["en", "de", None]), rng.randint(0, 99), rng.choice(["Ää Zeile", "plain", "A-Z", "", None]) and f"T {rng.random()}") for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"hot": 700, None: 3, "é": 257, "z": 256, "": 2, **{f"s{i}": 1 + i % 19 for i in range(40)}}])
def test_equals_brute_force(spark, sizes):
    docs = made(sizes)
    assert found(spark, docs) == brute(docs)


def test_odd_rows(spark):
    docs = [(None, None, None, None, None), (None, "a", "en", 3, "X"), (5, "a", "en", 3, "same"), (5, "a", "en", 3, "same"), (5, "a", "en", 3, "other"), (-7, "a", None, None, ""), (9, "", "en", 1, "Ä" * 300_000), (0, "b", "en", 1, "ABC\x00\n")]
    assert found(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_many_copies_are_cut_apart(spark, monkeypatch):
    """A third of all rows are one row; a part takes a share of them, and rounds of merges follow."""
    monkeypatch.setattr(merkle, "PART_ROWS", 40)
    docs = made({"a": 600, "b": 5}) + [(3, "a", "en", 1, "copy")] * 300
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    leaves = merkle.hashed(df)
    parts = merkle._parts(leaves.select(F.concat(F.lit("s"), "source").alias("__group"), F.col("doc_id").alias("__key"), "leaf"))
    counts = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(counts) > 16 and max(counts) < 200
    assert query_rows(leaves) == brute(docs)


def test_merge_is_associative_and_commutative():
    rng = random.Random(1)
    sizes = {0: 300, 1: 1, 2: 16, 3: 33}
    leaves = [(t, i, h(f"{t}/{i}")) for t, n in sizes.items() for i in range(n)]
    want = levels([levels([x for t, _, x in leaves if t == k])[-1][0] for k in sizes])[-1][0]
    for _ in range(5):
        rng.shuffle(leaves)
        cuts = sorted(rng.sample(range(len(leaves)), 9))
        forests = []
        for lo, hi in zip([0, *cuts], [*cuts, len(leaves)], strict=True):
            f = Forest(len(sizes))
            for t, i, x in leaves[lo:hi]:
                f.add(t, sizes[t], 0, i, x)
            forests.append(f.settle())
        while len(forests) > 1:
            a = forests.pop(rng.randrange(len(forests)))
            b = forests.pop(rng.randrange(len(forests)))
            forests.append(a.merge(b))
        assert forests[0].nodes == {(TOP, 1, 0): want}


def test_open_nodes_are_few():
    """A stretch of a large tree leaves at most 15 nodes at either end of each level."""
    n, lo, hi = 16**5, 70_001, 91_234
    f = Forest(3)
    for i in range(lo, hi):
        f.add(1, n, 0, i, str(i))
    f.settle()
    assert len(f.nodes) <= 2 * 15 * 4 and len(f.above()) <= 2 * 5 + 1


def test_query_equals_sql(spark, sf_dir):
    from tests.oracle import same

    same(merkle.query(spark, sf_dir), merkle.SQL, sf_dir)

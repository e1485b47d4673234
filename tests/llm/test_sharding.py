import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcatlas.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_feistel_is_a_permutation(n, seed):
    f = sharding.Feistel(n, seed)
    p = f.apply(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    assert (f.invert(p) == np.arange(n)).all()


def test_places_are_computable():
    n, shards = 1003, 8
    for row in (0, 1, 17, 1002):
        s, slot = sharding.shard_of(n, shards, row, seed=17)
        assert sharding.row_at(n, shards, s, slot, seed=17) == row


def test_query_over_all_documents(spark, sf_dir):
    rows = sharding.query(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_places_follow_values_not_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs.repartition(1), ["doc_id"], 4, seed=3).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs.repartition(7), ["doc_id"], 4, seed=3).collect()}
    assert one == two
    n = len(one)
    numbers = {r.doc_id: r.row_number for r in sharding.number_rows(docs, ["doc_id"]).collect()}
    assert sorted(numbers.values()) == list(range(n))
    assert all(one[d] == sharding.shard_of(n, 4, k, seed=3) for d, k in numbers.items())


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, None, None), (2, "", 1)], "doc_id long, text string, slot int")
    out = sharding.shard(df, ["doc_id", "text"], 3).collect()
    assert len(out) == 4 and len({(r.shard, r.slot) for r in out}) == 4
    assert sharding.shard(df.limit(0), ["doc_id"], 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, ["doc_id"], 0)

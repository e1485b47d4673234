"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from values alone: rows are dealt to buckets by a hash, buckets
are counted, and a row's number is its bucket's offset plus its place in the
bucket's order. So a lost executor's rows get the same numbers again, and nothing
is sorted globally. The permutation p of 0..n-1 then gives shard p % shards and
slot p // shards, which any process can compute, either way, from (n, seed) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas import ship

ROUNDS = 6


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64(key)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(32))) & mask


class Feistel:
    """A keyed permutation of 0..n-1: a balanced network on 2**(2h) >= n points, walked until it lands inside."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS) -> None:
        if n < 0:
            raise ValueError("n must not be negative")
        self.n, self.h = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.h) - 1)
        self.keys = [int(k) for k in np.random.default_rng(seed).integers(1, 2**63, rounds, dtype=np.uint64)]

    def _pass(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        h = np.uint64(self.h)
        left, right = x >> h, x & self.mask
        for key in keys:
            left, right = (right ^ _round(left, key, self.mask), left) if back else (right, left ^ _round(right, key, self.mask))
        return (left << h) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._pass(np.asarray(x, np.uint64), keys, back)
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = self._pass(out[outside], keys, back)
        return out.astype(np.int64)

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, back=False)

    def invert(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, back=True)


def shard_of(n: int, shards: int, row: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(Feistel(n, seed).apply(np.array([row]))[0])
    return p % shards, p // shards


def row_at(n: int, shards: int, shard: int, slot: int, seed: int = 0) -> int:
    """The row number in a shard's slot."""
    return int(Feistel(n, seed).invert(np.array([slot * shards + shard]))[0])


def number_rows(df: DataFrame, order: list[str], buckets: int = 4096, out: str = "row_number") -> DataFrame:
    """Add a gapless global row number from 0 (long), which depends on the values of `order` alone.

    `buckets` bounds the table of offsets that is broadcast. Rows equal in all of
    `order` are interchangeable and numbered in any order. Nulls count as a value.
    """
    bucket, place, offset = "__bucket", "__place", "__offset"
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(bucket).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # over at most `buckets` rows
    offsets = counts.select(bucket, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(offset))
    placed = dealt.withColumn(place, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return placed.join(F.broadcast(offsets), bucket).withColumn(out, F.col(offset) + F.col(place) - 1).drop(bucket, place, offset)


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Deal all rows to shards whose row counts differ by one at most (the law `rows`).

    Returns df with row_number long, shard int and slot long (gapless from 0 in each
    shard). An empty table gives an empty result; repeated rows each get a slot of
    their own; other columns, null or not, pass unchanged. Columns of df that are
    named like these three are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    ship.ensure(df.sparkSession)
    df = df.drop("row_number", "shard", "slot")
    n = df.count()
    numbered = number_rows(df, order, buckets)

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = Feistel(n, seed)
        for rows in batches:
            yield pd.Series(network.apply(rows.to_numpy()))

    placed = numbered.withColumn("__p", permuted("row_number"))
    return placed.withColumns({"shard": F.pmod("__p", F.lit(shards)).cast("int"), "slot": F.floor(F.col("__p") / F.lit(shards)).cast("long")}).drop("__p")


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    text = F.coalesce("text", F.lit(""))
    # The digests are taken before anything is moved, so texts stay where they are read.
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = shard(docs, ["doc_id", "size", "text_crc32"], shards=8, seed=17)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

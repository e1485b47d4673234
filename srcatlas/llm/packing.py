"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token pieces of at most `capacity`. Only the histogram of piece
lengths, at most `capacity` counts, goes to the driver. There multiplicative weights
solve the configuration LP, a cover of all counts by sequence layouts: each step prices
the lengths, a knapsack by dynamic programming finds what a layout can be worth, layouts
worth nearly that are read off its table and used, and the prices of the lengths they
cover fall, until every length is covered. Layouts are rounded to whole uses, the fullest
first, and the LP is solved again over what that leaves, as long as its layouts are
nearly full; only the rest goes best fit. Prices also prove how few sequences any plan
can have. The plan says which ranks of each length go where; every piece finds its place
from its length and rank.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm import bpe
from srcatlas.llm._store import bound_batches, materialize, release

CAPACITY, END_ID = 4096, 1
#: Pricing steps of an LP at most, layouts read off each table, and LPs over what rounding leaves at most.
STEPS, LAYOUTS, ROUNDS = 12, 64, 80
#: How hard prices fall with a length's cover, by how much of the best value a layout may be worth less.
RATE, LOSS = 0.1, 0.002
#: Seeds of what is drawn among equals; the next is tried where a plan is farther than GAP above its bound.
SEEDS, GAP = (7, 8, 9), 0.0005
#: An LP that places less than this share of its pieces has done what it can for layouts this full; the room that a layout may leave is then doubled, up to this share of the capacity.
STALLED, ROOM = 0.05, 1 / 32
#: Pieces for each of the buckets over which the ranks of one length are counted, so that a hot length is spread.
BUCKET = 1 << 16


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """What the most valuable layout of each size is worth, and how many of the lengths (ascending) fit in each size."""
    best, fits = np.zeros(capacity + 1), np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        best[c] = max(best[c - 1], (best[c - lengths[: fits[c]]] + prices[: fits[c]]).max())
    return best, fits


def layout(table: tuple[np.ndarray, np.ndarray], lengths: np.ndarray, prices: np.ndarray, left: np.ndarray, need: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """(indices, multiplicities, room left) of a layout of what is left, read off a knapsack's table: of the lengths that lose next to no value, one is drawn by what it still needs."""
    best, fits = table
    c, slack, held, left = len(best) - 1, LOSS * best[-1], {}, left.copy()
    while fits[c]:
        n = fits[c]
        value = best[c - lengths[:n]] + prices[:n]
        there = left[:n] > 0
        near = np.flatnonzero(there & (value >= best[c] - slack))
        if len(near):
            pick = int(near[np.argmax(need[near] * rng.random(len(near)))])
        elif there.any():
            there = np.flatnonzero(there)
            pick = int(there[np.argmax(value[there])])
        else:
            break
        slack = max(0.0, slack - max(0.0, best[c] - value[pick]))
        held[pick] = held.get(pick, 0) + 1
        left[pick] -= 1
        c -= int(lengths[pick])
    return np.fromiter(held, np.int64), np.fromiter(held.values(), np.int64), c


def cover(lengths: np.ndarray, demand: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[list[tuple[int, float, np.ndarray, np.ndarray]], float]:
    """Multiplicative weights: (room left, uses, indices, multiplicities) of layouts that together cover the demand, and the lower bound on any cover that the prices prove."""
    prices, covered, bound = lengths / capacity, np.zeros(len(lengths)), 0.0
    found: dict[tuple[bytes, bytes], list] = {}
    for _ in range(STEPS):
        table = knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ demand / table[0][-1]))  # these prices, over the dearest layout, are feasible for the dual
        for _ in range(LAYOUTS):
            need = np.maximum(demand - covered, 0) / demand + 1e-3
            at, m, room = layout(table, lengths, prices, demand, need, rng)
            uses = float(np.min(demand[at] // m))
            found.setdefault((at.tobytes(), m.tobytes()), [room, 0.0, at, m])[1] += uses
            covered[at] += m * uses
        share = covered / demand
        if share.min() >= 1:
            break
        prices = lengths / capacity * np.exp(-RATE * np.minimum(share, 20))
    return [tuple(x) for x in found.values()], bound


def solved(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int, float]:
    """A plan of (times, lengths, multiplicities) of each layout, which together use every piece once; a lower bound on the sequences of any plan; and the share of the pieces that the LPs placed."""
    order = np.argsort(lengths)
    lengths, left = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    lengths, left = lengths[left > 0], left[left > 0]
    if not len(lengths):
        return [], 0, 1.0
    tried: list[tuple[int, list, int, float]] = []
    for seed in SEEDS:
        plan, bound, share = attempt(lengths, left.copy(), capacity, np.random.default_rng(seed))
        bound = math.ceil(max(bound, float(lengths @ left) / capacity) - 1e-6)
        tried.append((sum(t for t, _, _ in plan), plan, bound, share))
        if tried[-1][0] <= (1 + GAP) * bound:
            break
    if min(x[0] for x in tried) > tried[-1][2]:  # no plan is proved the best: none may need more sequences than best fit alone
        plan = best_fit(lengths, left.copy(), capacity)
        tried.append((sum(t for t, _, _ in plan), plan, 0, 0.0))
    _, plan, _, share = min(tried, key=lambda x: x[0])
    return plan, max(x[2] for x in tried), share


def attempt(lengths: np.ndarray, left: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], float, float]:
    """One plan for what is left, ascending lengths, with its bound and its share placed by the LPs."""
    plan: list[tuple[int, np.ndarray, np.ndarray]] = []
    pieces, bound, room = int(left.sum()), 0.0, 0
    for k in range(ROUNDS):
        live = np.flatnonzero(left)
        if not len(live):
            break
        had = int(left.sum())
        found, dual = cover(lengths[live], left[live], capacity, rng)
        bound = max(bound, dual) if not k else bound
        for free, uses, at, m in sorted(found, key=lambda x: (x[0], -x[1])):
            times = min(math.ceil(uses), int(np.min(left[live[at]] // m)))
            if times > 0 and free <= room:
                left[live[at]] -= times * m
                plan.append((times, lengths[np.sort(live[at])], m[np.argsort(at)]))
        if had - int(left.sum()) < STALLED * had:
            if room >= ROOM * capacity:
                break
            room = max(1, 2 * room)
    share = 1 - int(left.sum()) / pieces
    return [*plan, *best_fit(lengths, left, capacity)], bound, share


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The longest left, then the longest that fits beside it, and so on; `left` is used up."""
    plan: list[tuple[int, np.ndarray, np.ndarray]] = []
    while left.any():
        free, held = capacity, np.zeros(len(lengths), np.int64)
        while len(fits := np.flatnonzero((left > held) & (lengths <= free))):
            k = fits[-1]
            n = min(int(left[k] - held[k]), free // int(lengths[k]))
            held[k] += n
            free -= n * int(lengths[k])
        at = np.flatnonzero(held)
        times = int(np.min(left[at] // held[at]))
        left[at] -= times * held[at]
        plan.append((times, lengths[at], held[at]))
    return plan


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return solved(lengths, counts, capacity)[0]


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, plan: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for times, lengths, multiple in plan:
            offset = 0
            for length, m in zip(lengths[::-1].tolist(), multiple[::-1].tolist(), strict=True):
                first = used.get(length, 0)
                rows.append((length << 40 | first, first, m, sequence, offset))
                used[length] = first + times * m
                offset += length * m
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.key, self.first, self.multiple, self.sequence, self.offset = (np.array([r[k] for r in rows], np.int64) for k in range(5))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 40 | rank, "right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.multiple[at], self.offset[at] + nth % self.multiple[at] * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bpe.file_content(vocabulary))
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        e = bpe.encoder_of(shared.value, 2 * bpe.CHUNKS, library=True)  # no decoder runs beside it
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), bpe.texts_of(part.column(1)), strict=True):
                    ids = e.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, PIECES)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece int, start, length, ids_crc32, sequence_id, offset (long), and ids binary (little-endian unsigned 32-bit) if asked for.

    Each document is its ids and end_id; only longer ones are cut, into pieces of
    `capacity`. A null or empty text is end_id alone. Pieces of a sequence follow each
    other without gaps. Repeated rows are packed each; a null id is kept. An empty
    table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    cut = materialize(pieces(docs, vocabulary, id_col, text_col, capacity, end_id, with_ids), "pieces")
    histogram = cut.groupBy("length").count().collect()  # at most `capacity` rows
    plan, bound, share = solved(np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), capacity)
    places = Places(plan)
    logging.getLogger(__name__).info("%d sequences, at least %d needed; %.2f %% of the pieces placed by the linear program, the others best fit", places.sequences, bound, 100 * share)
    buckets = 16 + sum(r["count"] for r in histogram) // BUCKET
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    dealt = cut.withColumn("bucket", bucket)
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(first, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    return pack(table(spark, sf_dir, "documents"), bpe.default_vocabulary())

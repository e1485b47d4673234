"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary training rows, are compared by
length-normalised log-likelihood. Counts of (word before, word) are interpolated with
continuation counts, the numbers of different words before a word, and those with
counts that both models share, gathered over all documents. Discounts are modified
Kneser-Ney: one each for counts of one, two and more, estimated from the counts of
counts, always below the count, so that what was seen once keeps mass.

Counts are exact and keyed by 44-bit word keys; no table is held whole anywhere.
Documents become chunks: distinct words and the sequence of their indices. A chunk
sends the distinct pairs of its training rows with their counts, and a 28-bit key of
each pair that it only wants to know, sorted and as differences, cut into cells by hash.
A cell adds up, answers every chunk with the totals of its pairs, and hands on what the
pairs say about single words. A key only finds candidates: the answer has every pair of
the cell that has it, each with 32 other bits of its hash, by which the chunk takes its
own and no other. These sums meet the chunks' words in ranges in the same
way. A chunk then has all counts that its words need. Cells and ranges grow with the
tokens, so there are at every size less than 3 candidates in a hundred too many.
Cells, then ranges, then chunks are worked off in rounds: what a round has sent is
deleted before the next one, and so is what only that round reads.

A logistic curve over length-normalised log ratios, those of the document, its worst
passage, its five worst words and the worst one, beside the length, makes a probability
of the comparison: a long text may hold few toxic words, and its mean alone would hide
them. It is fitted on at most `sample` training rows, with models that have not seen
these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.llm import words as W
from srcatlas.llm._pack import ascended, ascending, cuts, packed, unpacked
from srcatlas.llm._store import bound_batches, bucketed, discard, drop_part, materialize, release

#: Bytes of text in a chunk, with the columns that it carries (a longer document is one alone), and tokens for each cell of pairs and range of words.
CHUNK, CELL = 16 << 20, 1 << 23
#: Bytes of results that a task holds before it hands them on.
FLUSH = 4 << 20
#: Words of a passage; training rows for the curve; the score from which a document counts as toxic.
PASSAGE, SAMPLE, TOXIC_AT = 24, 20000, 0.3
#: Rounds in which the cells, the ranges and the chunks are worked off.
ROUNDS = 4
#: Label rows up to which they are broadcast; beyond, the join is shuffled.
LABELS_BROADCAST = 1_000_000
#: Groups of counts are 2 * fold + class; models are 2 * (0 early, 1 full) + class.
GROUPS, FEATURES = 4, 5
WORD_BITS, KEY_BITS = 44, 28
CHUNKS = "chunk long, tokens long, keys binary, times binary, seq binary, first binary, groups binary, rows binary, share int"
PAIRS = "cell int, chunk long, words binary, m binary, v binary, n binary, asked binary"
MERGED = "kind string, chunk long, part int, words binary, value binary, hits binary"


def pair_hash(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return W.mix(w * np.uint64(0x9E3779B97F4A7C15) + W.mix(v + np.uint64(0x632BE59BD9B4E019)))


def part_of(parts: int, k: int) -> tuple[int, int]:
    """The cells or ranges of a round: from, to."""
    return -(-parts * k // ROUNDS), -(-parts * (k + 1) // ROUNDS)


def share(chunk: int) -> int:
    """The round in which a chunk gets its answers; a task's chunks are dealt over all of them."""
    return ((chunk >> 32) + (chunk & 0xFFFFFFFF)) % ROUNDS


def shares(parts: int) -> Column:
    """The round that reads a row of MERGED: that of its chunk, or of its range where it is for no chunk."""
    chunk = F.pmod(F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(0xFFFFFFFF), F.lit(ROUNDS))
    return F.when(F.col("kind").isin("w", "v"), F.floor(F.col("part") * ROUNDS / parts)).otherwise(chunk).cast("int")


def ranges(words: np.ndarray, parts: int) -> np.ndarray:
    """The range of each word key; in order of the keys."""
    return ((words >> np.uint64(WORD_BITS - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def chunks(carry: list[str]):
    """Batches of (text, g, ...) to chunks; the columns in `carry` go with them as one Arrow stream."""

    def pack(held: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        found = [(w.hashes(), w.counts()) for w in W.tokenized(t["text"], breaks=W.NOT_LETTER, fold=W.FOLD)]
        h = np.maximum(np.concatenate([x for x, _ in found]) >> np.uint64(64 - WORD_BITS), 1)  # 0 opens a document
        first = np.concatenate([[0], *(n for _, n in found)]).cumsum()
        words, seq, times = np.unique(h, return_inverse=True, return_counts=True)
        by_times = np.argsort(-times, kind="stable")  # common words get small numbers
        rank = np.empty(len(words), np.uint32)
        rank[by_times] = np.arange(1, len(words) + 1, dtype=np.uint32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(carry).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t.select(carry))
        blobs = (ascending(words), packed(times.astype(np.uint32)), packed(rank[seq]), packed(np.diff(first).astype(np.uint32)), packed(t["g"].to_numpy().astype(np.int32)), sink.getvalue().to_pybytes())
        name = TaskContext.get().partitionId() << 32 | k
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(h)]), *(pa.array([b], pa.binary()) for b in blobs), pa.array([share(name)], pa.int32())], ["chunk", "tokens", "keys", "times", "seq", "first", "groups", "rows", "share"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size, k = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= CHUNK:
                yield pack(held, k)
                held, size, k = [], 0, k + 1
        if held:
            yield pack(held, k)

    return task


def vocabulary_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words in order of their keys, 0 before all, and how often each stands in it."""
    return np.concatenate([np.zeros(1, np.uint64), ascended(row["keys"])]), np.concatenate([[0], unpacked(row["times"], np.uint32).astype(np.int64)])


class Chunk:
    """A chunk's tokens, and its distinct pairs in the order of cells; in a cell those of training rows, by word, before the others, by key. With `cells` (from, to) only the tokens whose pairs are in these."""

    def __init__(self, row: dict, parts: int, cells: tuple[int, int] | None = None) -> None:
        self.words, times = vocabulary_of(row)
        by_times = np.concatenate([[0], 1 + np.argsort(-times[1:], kind="stable")])
        seq = by_times.astype(np.uint32)[unpacked(row["seq"], np.uint32)]
        n = unpacked(row["first"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        own = np.repeat(unpacked(row["groups"], np.int32).astype(np.int8), n)
        before = np.zeros_like(seq)
        before[1:] = seq[:-1]
        before[self.first[:-1][n > 0]] = 0
        code = seq.astype(np.uint64)
        code <<= np.uint64(32)
        code |= before
        del seq, before
        if cells:
            inside = np.empty(len(code), bool)
            for k in range(0, len(code), 1 << 18):  # few at a time: memory
                x = code[k : k + (1 << 18)]
                cell = (pair_hash(self.words[x >> np.uint64(32)], self.words[x & np.uint64((1 << 32) - 1)]) >> np.uint64(40)) % np.uint64(parts)
                inside[k : k + len(x)] = (cell >= cells[0]) & (cell < cells[1])
            code, own = code[inside], own[inside]
            del inside
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        at = np.empty(len(code), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        code = code[new]
        w, v = (code >> np.uint64(32)).astype(np.int32), code.astype(np.uint32).astype(np.int32)
        del code, new
        learned = np.zeros(len(w), bool)
        learned[at[own >= 0]] = True
        key = pair_hash(self.words[w], self.words[v])
        cell = (key >> np.uint64(40)) % np.uint64(parts)
        check = (key >> np.uint64(32)).astype(np.uint32)
        key &= np.uint64((1 << KEY_BITS) - 1)
        by = cell << np.uint64(1)
        by |= ~learned
        by <<= np.uint64(32)
        by |= np.where(learned, np.arange(len(w), dtype=np.uint64), key)
        by_cell = np.argsort(by, kind="stable")
        del by
        self.w, self.v, self.key, self.check, self.learned, self.cell = w[by_cell], v[by_cell], key[by_cell], check[by_cell], learned[by_cell], cell[by_cell].astype(np.int32)
        del w, v, key, check, learned, cell
        rank = np.empty(len(by_cell), np.int32)
        rank[by_cell] = np.arange(len(by_cell), dtype=np.int32)
        self.pair, self.own = rank[at], own

    def counts(self) -> np.ndarray:
        """How often each pair stands in rows of each group."""
        out = np.empty((GROUPS, len(self.w)), np.uint32)
        for g in range(GROUPS):
            out[g] = np.bincount(self.pair[self.own == g], minlength=len(self.w))
        return out


def batch_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, one in Python at a time: a chunk's take megabytes. What earlier tasks of this worker had held goes back first."""
    release()
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
            release()


def pairs(parts: int, cells: tuple[int, int] | None = None):
    """The distinct pairs of each chunk by cell; of the cells from, to, or all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            c = Chunk(row, parts, cells)
            n, rows, size = c.counts(), [], 0
            for cell, a, b in cuts(c.cell):
                k = a + int(c.learned[a:b].sum())
                used = np.unique(np.concatenate([c.w[a:k], c.v[a:k]]))  # both words of a pair as places in these
                m = np.bincount(np.searchsorted(used, c.w[a:k]), minlength=len(used)).astype(np.uint32)
                rows.append((cell, row["chunk"], ascending(c.words[used]), packed(m), packed(np.searchsorted(used, c.v[a:k]).astype(np.uint32)), packed(n[:, a:k]), ascending(c.key[k:b])))
                size += sum(map(len, rows[-1][2:]))
                if size >= FLUSH:
                    yield from batch_of(rows, PAIRS).to_batches()
                    rows, size = [], 0
            yield from batch_of(rows, PAIRS).to_batches()
            del c, n, rows

    return task


def asked(parts: int, of: tuple[int, int]):
    """The words of each chunk and how often they stand in it, by range; of the ranges from, to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            words, times = vocabulary_of(row)
            rows = [("q", row["chunk"], p, ascending(words[a:b]), packed(times[a:b]), None) for p, a, b in cuts(ranges(words, parts)) if of[0] <= p < of[1]]
            yield from batch_of(rows, MERGED).to_batches()

    return task


def counts_of_counts(x: np.ndarray) -> np.ndarray:
    """For each model: how many are 1, 2, 3, 4, at least 3, and the sum of all."""
    return np.stack([*((x == k).sum(axis=1) for k in (1, 2, 3, 4)), (x > 2).sum(axis=1), x.sum(axis=1)], axis=1).astype(np.int64)


def summed(keys: np.ndarray, rows: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sums over each of all rows of numbers, which are looked at one by one."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.stack([np.add.reduceat(x[order], at, dtype=np.int64) for x in rows])


def add_pairs(parts: int):
    """One cell: for each chunk what others add to its own pairs, and totals of those that it asks for ('a'), sums over the pairs for words ('w', 'v'), counts of counts ('c')."""

    def merge(t: pa.Table) -> pa.Table:
        release()
        got = t.to_pylist()
        held = [ascended(r["words"]) for r in got]
        known = np.unique(np.concatenate(held))
        code = []
        for x, r in zip(held, got, strict=True):
            place = np.searchsorted(known, x).astype(np.uint64)
            code.append(np.repeat(place << np.uint64(32), unpacked(r["m"], np.uint32)) | place[unpacked(r["v"], np.uint32)])
        code = np.concatenate(code)
        n = np.concatenate([unpacked(r["n"], np.uint32).reshape(GROUPS, -1) for r in got], axis=1)
        del held
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        at = np.flatnonzero(new)
        total = np.stack([np.add.reduceat(x[order], at, dtype=np.int64) for x in n]) if len(code) else n.astype(np.int64)
        own = n
        del n
        back = np.empty(len(code), np.int32)
        back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        code = code[new]
        w, v = known[code >> np.uint64(32)], known[code & np.uint64((1 << 32) - 1)]
        del code, new
        full = pair_hash(w, v)
        key = full & np.uint64((1 << KEY_BITS) - 1)
        by_key = np.argsort(key, kind="stable")
        key, check = key[by_key], (full >> np.uint64(32)).astype(np.uint32)
        del full
        rows, done = [], 0
        for r in got:
            k = len(unpacked(r["v"], np.uint32))
            q = ascended(r["asked"])
            lo = np.searchsorted(key, q)
            found = np.searchsorted(key, q, "right") - lo
            at = by_key[np.repeat(lo - (np.cumsum(found) - found), found) + np.arange(found.sum())]
            hits = np.concatenate([total[:, at].astype(np.uint32), check[None, at]])
            rows.append(("a", r["chunk"], r["cell"], packed(found.astype(np.uint16)), packed((total[:, back[done : done + k]] - own[:, done : done + k]).astype(np.uint32)), packed(hits)))
            done += k
        del got, back, own, key, check, by_key
        total[2:] += total[:2]  # groups become models
        rows.append(("c", -1, -1, None, packed(counts_of_counts(total)), None))
        if len(w):
            times = (f(x) for f in (lambda x: x, lambda x: x == 1, lambda x: x == 2, lambda x: x > 2) for x in total)
            sums = (("w", *summed(w, (x > 0 for x in total))), ("v", *summed(v, times)))
            for kind, keys, values in sums:
                rows += [(kind, -1, p, ascending(keys[a:b]), packed(values[:, a:b]), None) for p, a, b in cuts(ranges(keys, parts))]
        return batch_of(rows, MERGED)

    return merge


def counts_of_pairs(c: Chunk, a: int, b: int, answer: dict, own: np.ndarray) -> np.ndarray:
    """The totals by group of a chunk's pairs a..b, a cell, from the chunk's own counts and the cell's answer, which has what other chunks add."""
    k = int(c.learned[a:b].sum())
    out = np.zeros((GROUPS, b - a), np.uint32)
    out[:, :k] = own[:, a : a + k] + unpacked(answer["value"], np.uint32).reshape(GROUPS, -1)
    found, hits = unpacked(answer["words"], np.uint16), unpacked(answer["hits"], np.uint32).reshape(GROUPS + 1, -1)
    at = k + np.repeat(np.arange(b - a - k), found)
    same = hits[GROUPS] == c.check[a + at]
    out[:, at[same]] = hits[:GROUPS, same]
    return out


def discounts(c: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, for each model, from its counts of counts; each below its count."""
    out = np.zeros((len(c), 4))
    for k, n in enumerate(c[:, :4].astype(float)):
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        for j in (1, 2, 3):
            d = j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else y
            out[k, j] = np.clip(d, 0.05, 0.95 * j)
    return out


def add_words(t: pa.Table) -> pa.Table:
    """One range of words: for each chunk, its words' times as context and how many different words follow once, twice, more often, by model; continuation counts by model; and the shared count."""
    got = [(r["kind"], r["chunk"], r["part"], ascended(r["words"]), unpacked(r["value"], np.int64)) for r in t.to_pylist()]
    words = np.unique(np.concatenate([w for kind, _, _, w, _ in got if kind == "q"]))
    sums = {"q": np.zeros((1, len(words)), np.int64), "w": np.zeros((4, len(words)), np.int64), "v": np.zeros((16, len(words)), np.int64)}
    for kind, _, _, w, value in got:
        sums[kind][:, np.searchsorted(words, w)] += value.reshape(-1, len(w))  # the words of a row differ
    out = np.concatenate([sums["v"], sums["w"], sums["q"]])
    rows = [("u", chunk, part, None, packed(out[:, np.searchsorted(words, w)]), None) for kind, chunk, part, w, _ in got if kind == "q"]
    shared = np.array([[0, 0, 0, 0, (sums["q"] > 0).sum(), sums["q"].sum()]], np.int64)
    rows.append(("c", -1, -1, None, packed(np.concatenate([counts_of_counts(sums["w"]), shared])), None))
    return batch_of(rows, MERGED)


class Models:
    """The global numbers of both classes' early and full models."""

    def __init__(self, of_pairs: np.ndarray, of_words: np.ndarray) -> None:
        self.d, self.low, self.kept = discounts(of_pairs), discounts(of_words[:4]), of_words[:4].astype(float)
        self.vocabulary, self.tokens = (float(x) for x in of_words[4, 4:])
        self.ready = [bool(of_pairs[2 * m : 2 * m + 2, 5].all()) for m in (0, 1)]

    def ratios(self, c: Chunk, n: np.ndarray, u: np.ndarray, m: int) -> np.ndarray:
        """log P(word | word before, toxic) - log P(word | word before, ordinary), for each distinct pair. n: counts by group; u: what add_words says of each word."""
        base = (u[20] + 0.5) / (self.tokens + 0.5 * self.vocabulary)
        p = []
        for k in (2 * m, 2 * m + 1):
            cont, total = u[16 + k], self.kept[k, 5]
            low = base
            if total:
                free = self.low[k, 1:] @ self.kept[k, [0, 1, 4]]
                low = (cont - self.low[k][np.minimum(cont, 3)] + free * base) / total
            times = np.maximum(u[k], 1)
            backoff = np.where(u[k] > 0, sum(self.d[k, j] * u[4 * j + k] for j in (1, 2, 3)) / times, 1.0)
            x = n[k - 2 * m].astype(np.int64) + (n[2 + k - 2 * m] if m else 0)
            p.append((x - self.d[k][np.minimum(x, 3)]) / times[c.v] + backoff[c.v] * low[c.w])
        # Steps of 2^-20 add up exactly, wherever in a chunk a document stands.
        return np.round(np.clip(np.log(p[1]) - np.log(p[0]), -12, 12) * 2**20) / 2**20


def features(r: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document the mean ratio of all its words, of its worst passage, of its five worst words and of the worst one; and log length, as the worst of many is worse."""
    n = np.diff(bounds)
    out = np.zeros((len(n), FEATURES))
    total = np.concatenate([[0.0], np.cumsum(r)])
    at = np.arange(len(r))
    last = np.repeat(bounds[1:], n)
    end = np.minimum(at + PASSAGE, last)
    begin = np.maximum(np.minimum(at, last - PASSAGE), np.repeat(bounds[:-1], n))
    full = np.flatnonzero(n)
    if len(full):
        s = bounds[full]
        out[full, 0] = (total[bounds[full + 1]] - total[s]) / n[full]
        out[full, 1] = np.maximum.reduceat((total[end] - total[begin]) / np.maximum(end - begin, 1), s)
        worst = np.concatenate([[0.0], np.cumsum(r[np.lexsort((-r, np.repeat(np.arange(len(n)), n)))])])
        few = np.minimum(5, n[full])
        out[full, 2] = (worst[s + few] - worst[s]) / few
        out[full, 3] = np.maximum.reduceat(r, s)
        out[full, 4] = np.log1p(n[full])
    return out


def blocks(first: np.ndarray, tokens: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Documents from, to: as many at once as have that many tokens, one at least."""
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + tokens, "right")) - 1)
        yield lo, hi
        lo = hi


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps: intercept and weights."""
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def measure(models: Models, parts: int, names: list[str]):
    """A chunk and the answers to it, to its rows with the features by the full model (x) and by the early one (early)."""

    def task(own: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        row = own.drop_columns(["rows"]).to_pylist()[0]
        c = Chunk(row, parts)
        del row
        n, u = c.counts(), np.zeros((21, len(c.words)), np.int64)
        found = {(kind, part): k for k, (kind, part) in enumerate(zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), strict=True))}
        answer = lambda kind, part: answers.slice(found[kind, part], 1).to_pylist()[0]
        for cell, a, b in cuts(c.cell):
            n[:, a:b] = counts_of_pairs(c, a, b, answer("a", cell), n)
        for part, a, b in cuts(ranges(c.words, parts)):
            u[:, a:b] = unpacked(answer("u", part)["value"], np.int64).reshape(21, -1)
        x = [np.concatenate([features(ratio[c.pair[c.first[a] : c.first[b]]], c.first[a : b + 1] - c.first[a]) for a, b in blocks(c.first)]) for ratio in (models.ratios(c, n, u, m) for m in (1, 0))]
        del c, n, u
        rows = pa.ipc.open_stream(own["rows"][0].as_buffer()).read_all()
        at = pa.array(np.arange(rows.num_rows + 1) * FEATURES, pa.int32())
        return pa.table([*(pa.ListArray.from_arrays(at, pa.array(y.reshape(-1))) for y in x), *rows.columns], ["x", "early", *names])

    return task


def total(tables: list[DataFrame], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the 'c' rows, one from each cell or range."""
    out = np.zeros(shape, np.int64)
    for r in of_kinds(tables, "c").select("value").toLocalIterator():
        out += unpacked(bytes(r.value), np.int64).reshape(shape)
    return out


def of_kinds(tables: list[DataFrame], *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.filter(F.col("kind").isin(*kinds)) for t in tables))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = TOXIC_AT, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out boolean, score double (0 to 1), predicted int, and the columns in `carry`.

    Labels are learned only from rows whose crc32(id) mod 4 is not 2; a document with
    several labels counts as toxic if one says so; null labels are none. The score is a
    function of the text alone. A null or empty text gets the score of a text without
    words. Null ids are never held out nor labelled. Without any label the score is a
    constant below the threshold. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    small = labels.count() <= LABELS_BROADCAST
    rest = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4))
    carried = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carried)
    joined = base.join(F.broadcast(known) if small else known, base["id"] == known["__id"], "left")
    toxic = F.when(rest != 2, F.col("toxic"))
    group = F.when(toxic.isNotNull(), (rest == 3).cast("int") * 2 + toxic).otherwise(F.lit(-1)).cast("int")
    names = ["id", "g", "pick", *(f"c{k}" for k in range(len(carry)))]
    source = joined.select("text", "id", group.alias("g"), F.xxhash64("id", "text").alias("pick"), *names[3:])

    cut = bucketed(source.mapInArrow(chunks(names), CHUNKS), "toxicity_chunks", "chunk", by="share")
    parts = 16 + (cut.agg(F.sum("tokens")).first()[0] or 0) // CELL
    bare = cut.drop("rows", "share")
    of_pairs, of_words, found = [], [], []
    for k in range(ROUNDS):
        merged = bare.mapInArrow(pairs(parts, part_of(parts, k)), PAIRS).groupBy("cell").applyInArrow(add_pairs(parts), MERGED)
        of_pairs.append(materialize(merged.withColumn("share", shares(parts)), "toxicity-pairs", by=["kind", "share"]))
    for k in range(ROUNDS):
        words = bare.mapInArrow(asked(parts, part_of(parts, k)), MERGED).unionByName(of_kinds(of_pairs, "w", "v").filter(F.col("share") == k).drop("share"))
        of_words.append(materialize(words.groupBy("part").applyInArrow(add_words, MERGED).withColumn("share", shares(parts)), "toxicity-words", by=["kind", "share"]))
        for t in of_pairs:
            drop_part(t, f"kind=w/share={k}", f"kind=v/share={k}")
    models = Models(total(of_pairs, (4, 6)), total(of_words, (5, 6)))
    answers = of_kinds(of_pairs + of_words, "a", "u")
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("early", T.ArrayType(T.DoubleType())), *(source.schema[c] for c in names)])
    for k in range(ROUNDS):
        own, told = (t.filter(F.col("share") == k).drop("share").groupBy("chunk") for t in (cut, answers))
        found.append(materialize(own.cogroup(told).applyInArrow(measure(models, parts, names), schema), "toxicity"))
        drop_part(cut, f"share={k}")
        for t in of_pairs + of_words:
            drop_part(t, f"kind=a/share={k}", f"kind=u/share={k}")
    found = reduce(DataFrame.unionByName, found)
    discard(cut, *of_pairs, *of_words)

    rows = found.filter("g >= 2").select("early", (F.col("g") - 2).alias("toxic"), "pick").orderBy("pick", "toxic", "early").limit(sample).collect()
    x, y = np.array([r.early for r in rows]).reshape(-1, FEATURES), np.array([r.toxic for r in rows], float)
    if not models.ready[0] or len(set(y)) < 2:  # too little to fit a curve: the mean ratio alone, from a low start
        centre, scale, beta = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        beta[:2] = (np.log(0.05 / 0.95), 1.0 if models.ready[1] else 0.0)
    else:
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        beta = fit((x - centre) / scale, y)
    z = F.lit(float(beta[0]))
    for k in range(FEATURES):
        z = z + (F.col("x")[k] - float(centre[k])) / float(scale[k]) * float(beta[k + 1])
    scored = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry) if c != "doc_id"))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

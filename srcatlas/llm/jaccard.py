"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each document's set of word shingles gets a digest and a MinHash signature.
   Equal sets are one class of copies; its least document stands for it.
2. Classes that share one of `bands` bands of the signature are candidates. A
   band's bucket is chained to its least member, so a bucket of m classes makes
   m - 1 edges, never m * m, and the components of these edges hold all candidates.
3. Components are cut into tiles of bounded size, so each pair of classes meets in
   one task. There the signatures are compared a few values at a time; a pair is
   dropped as soon as the posterior probability (uniform prior, binomial matches)
   that its similarity reaches the threshold is below the tolerance.
4. Every pair left is verified exactly on its sets of shingles, compared as words: inside
   a tile equal words get equal numbers, and equal sequences of them do, without any hash.

With 32 bands of 5 a pair at similarity 0.8 exactly is missed with probability
3e-6 and one at 0.9 with less than 1e-12.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import words as W
from srcatlas.llm._store import bound_batches, discard, materialize, release
from srcatlas.llm.components import connected_components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS = 32, 5
#: Members on each side of a tile.
TILE = 512

_RNG = np.random.default_rng(314159)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

SIGNED = "doc_id long, mark long, digest binary, signature binary, keys array<long>"


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, its sorted distinct shingle hashes, the same from independent hashes of the words); documents without words are left out."""
    for words in W.tokenized(column):
        doc, h, other = W.shingles(words, k)
        if not len(h):
            continue
        order = np.lexsort((other, h, doc))
        doc, h, other = doc[order], h[order], other[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1]) | (doc[1:] != doc[:-1])
        doc, h, other = doc[new], h[new], other[new]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for d, part, check in zip(doc[at], np.split(h, at[1:]), np.split(other, at[1:]), strict=True):
            yield words.lo + int(d), part, check


def exact_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each document its sorted distinct shingles as numbers that are equal where the words are: no hash takes part."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(column)
    held = list(W.tokenized(column))
    texts = [w.data[a:b].tobytes() for w in held for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    if not texts:
        return out
    name = pa.array(texts, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    first, docs = [np.zeros(1, np.int64)], []
    for w in held:
        first.append(w.first[1:] + first[-1][-1])
        docs.append(np.arange(w.lo, w.hi))
    first = np.concatenate(first)
    start = W.window_starts(first, k, short=True)
    last = np.repeat(first[1:], np.diff(first))[start]
    number = name[start]
    for step in range(1, k):  # number sequences of one more word
        further = np.where(start + step < last, name[np.minimum(start + step, len(name) - 1)] + 1, 0)
        number = np.unique(number << 32 | further, return_inverse=True)[1]
    doc = np.repeat(np.concatenate(docs), np.diff(first))[start]
    pairs = np.unique(doc << 32 | number)
    for d, part in zip(*_parts(pairs), strict=True):
        out[d] = part
    return out


def _parts(pairs: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    doc = pairs >> 32
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return doc[at].tolist(), np.split(pairs & 0xFFFFFFFF, at[1:])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures, one row per set, 32 bits a value."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat((flat * _MUL[i] + _ADD[i]) >> np.uint64(32), at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    key = np.zeros((len(signature), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least m of n equal MinHash values at which P(similarity >= threshold | m of n) is not below tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail above t
    is the chance of at most m successes in n + 1 trials of probability t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int = 16, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of signatures that no comparison so far rules out; with upper, those of i < j only."""
    same = np.zeros((len(a), len(b)), np.int16)
    for h in range(step):
        same += a[:, h][:, None] == b[:, h][None, :]
    alive = same >= least_matches(step, threshold, tolerance)
    i, j = np.nonzero(np.triu(alive, 1) if upper else alive)
    count = same[i, j].astype(np.int32)
    for done in range(step, a.shape[1], step):
        count += (a[i, done : done + step] == b[j, done : done + step]).sum(axis=1, dtype=np.int32)
        keep = count >= least_matches(done + step, threshold, tolerance)
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's exact Jaccard similarity reaches the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 4 * len(sets):
        both = np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)), np.int64, len(i))
    else:  # many pairs of few sets: multiply 0/1 matrices over the shingles that two sets share at least
        used = np.unique(np.concatenate([i, j]))
        names, inverse, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(used)), size[used])
        column = np.cumsum(times > 1) - 1
        shared = times[inverse] > 1
        owner, column = owner[shared], column[inverse[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            s, e = np.searchsorted(column, (lo, lo + 4096))
            part = np.zeros((len(used), 4096), np.float32)
            part[owner[s:e], column[s:e] - lo] = 1
            total += part @ part.T
        both = total[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)
    # compare as integers where the threshold allows it: both / union >= t
    union = size[i] + size[j] - both
    return both >= np.ceil(threshold * union - 1e-9)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def sign(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        import hashlib

        for batch in batches:
            ids, marks, texts = batch.columns
            at, sets, digests = [], [], []

            def flush(at: list[int], sets: list[np.ndarray], digests: list[bytes], ids=ids, marks=marks) -> pa.RecordBatch:
                s = signatures(sets)
                keys = band_keys(s)
                arrays = [ids.take(pa.array(at)), marks.take(pa.array(at)), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in s], pa.binary())]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1))))
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "digest", "signature", "keys"])

            size = 0
            for d, s, check in shingle_sets(texts, k):
                at.append(d)
                sets.append(s)
                digests.append(hashlib.blake2b(s.tobytes() + check.tobytes(), digest_size=16).digest())
                size += len(s)
                if size > 200_000:
                    yield flush(at, sets, digests)
                    at, sets, digests, size = [], [], [], 0
            if at:
                yield flush(at, sets, digests)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(task, SIGNED)


TILED = "id long, links long, peer long"


def _tile(threshold: float, tolerance: float, k: int):
    def one(ids: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of each member and its least linked id, among pairs of left with right (or inside left, if right is left)."""
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        i, j = survivors(s[a], s[b], threshold, tolerance, upper=left is right)
        i, j = a[i], b[j]
        ok = verified(sets, i, j, threshold)
        i, j = i[ok], j[ok]
        return np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids)), forest(len(ids), i, j)

    def task(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, comp, side = (t[c].to_numpy() for c in ("id", "comp", "side"))
        s = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(len(ids), -1)
        sets = exact_sets(t["text"], k)
        links, peer = np.zeros(len(ids), np.int64), ids.copy()
        for c in np.unique(comp):
            at = np.flatnonzero(comp == c)
            left, right = side[at] == t["i"][0].as_py(), side[at] == t["j"][0].as_py()
            if (left == right).all():
                right = left
            n, root = one(ids[at], left, right, [sets[x] for x in at], s[at])
            links[at], peer[at] = n, ids[at][root]
        return pa.table({"id": pa.array(ids), "links": pa.array(links), "peer": pa.array(peer)})

    return task


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: doc_id, copy_of, class_id, n_copies, n_links (all long).

    copy_of is the least document with the same set of k-word shingles, n_copies the
    number of rows with it. n_links counts the classes of copies whose similarity with
    this one reaches the threshold; class_id is the least document that is reachable
    over such links. A text of fewer than k words has one shingle, all its words. A
    null text, one without words, or a null id is a class of its own, without links:
    copy_of and class_id are its own id. Rows that repeat an id are copies of each other;
    of different sets under one id, that of the least digest counts for all its rows. An
    empty table gives an empty result; other columns are not read.

    Candidates and copies are found by hashes (copies by 128 bits of two independent ones of
    each shingle); links are decided on the words themselves.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(sign(base, "doc_id", "text", k), "signed")
    known = signed.filter("doc_id is not null")
    rows = known.select("doc_id", "digest")
    # Ids with several sets: the one of the least digest counts for all rows of the id.
    several = materialize(rows.groupBy("doc_id").agg(F.min("digest").alias("own"), F.max("digest").alias("other")).filter("own <> other").select("doc_id", "own"), "several")
    if several.head(1):
        known = known.join(several, "doc_id", "left").filter("own is null or digest = own").drop("own")
        rows = rows.join(several, "doc_id", "left").select("doc_id", F.coalesce("own", "digest").alias("digest"))
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    copies = materialize(copies, "copies")
    reps = known.join(copies, (known.digest == copies.digest) & (known.doc_id == copies.rep)).groupBy("rep").agg(F.min("keys").alias("keys"))
    banded = reps.select(F.explode("keys").alias("key"), "rep")
    leaders = materialize(banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "leaders")
    edges = banded.join(leaders, "key").filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    raw = connected_components(edges)
    components = materialize(raw, "candidates")
    discard(raw, leaders)

    sizes = components.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    few = max(1, math.ceil(components.count() / TILE))
    cuts = F.ceil(F.col("size") / TILE).cast("int")
    members = components.join(sizes, "root").withColumn("cuts", cuts).select("id", F.col("root").alias("comp"), "cuts", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("side"), F.when(F.col("cuts") == 1, -1 - F.pmod(F.xxhash64("root"), F.lit(few))).otherwise(F.col("root")).alias("bin"))
    signs = known.select(F.col("doc_id").alias("id"), "mark", "signature").join(members, "id").dropDuplicates(["id"])
    # One plan at every size: the members of a small table would be broadcast, those of a large one not.
    marked = base.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    texts = marked.join(members.select("id").hint("merge"), "id").groupBy("id", "mark").agg(F.min("text").alias("text"))
    tiles = signs.join(texts, ["id", "mark"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tiles = tiles.select("bin", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "comp", "side", "signature", "text")
    linked = materialize(tiles.groupBy("bin", "i", "j").applyInArrow(_tile(threshold, tolerance, k), TILED).filter("links > 0 or peer <> id"), "linked")

    roots = connected_components(linked.select(F.col("peer").alias("a"), F.col("id").alias("b")))
    per = linked.groupBy("id").agg(F.sum("links").alias("n_links")).withColumnRenamed("id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    per = copies.join(per, "rep", "left").select("digest", "rep", "n_copies", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    in_class = rows.join(per, "digest").select("doc_id", F.col("rep").alias("copy_of"), "class_id", "n_copies", "n_links")
    blank = F.col("text").isNull() | F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    alone = base.filter(blank).select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    out = materialize(in_class.unionByName(alone), "near")
    discard(signed, several, copies, components, linked, roots)
    return out


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    return near_duplicates(table(spark, sf_dir, "documents"))

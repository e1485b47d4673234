"""Substring deduplication by a log-structured fingerprint index.

Every 20-word window of a document has a 64-bit hash and, from other hashes of the same
words, a 32-bit check. Documents come in loads, in the order of their ids. A load is
dealt into batches of neighbouring ids; each sends its distinct windows, sorted and cut
into hash ranges. A range merges the batches of the load and is merge-joined with each
immutable run that the index holds of earlier loads: equal hashes are verified by their
checks, and all but the earliest occurrence are marked. Marks go back to the batches as
bitmaps, so no posting list is ever built, and a passage that a third of all documents
share costs one entry for each batch. The windows of the load become a run of their own;
when there are too many, or ranges have outgrown a task, runs are compacted into one.

Batches follow the order of ids, so the earliest occurrence is that of the first batch,
and an entry of an index is nothing but hash and check: about 9 bytes, as hashes are kept
as differences.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.llm import words as W
from srcatlas.llm._pack import ascended, ascending
from srcatlas.llm._store import bound_batches, bucketed, delete, discard, materialize, opened, shared_dir

WINDOW = 20
#: Bytes of text in a batch, loads of one call, windows of a hash range, and runs that an index holds at most.
BATCH_BYTES, LOADS, RANGE, RUNS = 5 << 20, 3, 1 << 21, 2
#: Bytes of text for each window: how many ranges there are is reckoned from the size of the texts.
WORD_BYTES = 6
BATCHES = "b long, o long, several boolean, rows binary"
RUN = "b long, o long, range int, hashes binary, checks binary, starts binary"
FOUND = "b long, bits binary, hashes binary, checks binary, range int, kind string"
CELL = "range int, hashes binary, checks binary"


def sliced(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the hash ranges in a sorted array."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def batches(batch_bytes: int):
    """Rows in the order of their ids to batches of whole ids. An id of more than one batch fills several of the same order `o`, alone."""

    def pack(b: int, o: int, slices: list[list], several: bool) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, slices[0][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part, at, end in slices:
                out.write_batch(part.slice(at, end - at))
        return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([o]), pa.array([several]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b", "o", "several", "rows"])

    class Rows:
        """Slices of record batches, and their bytes of text."""

        def __init__(self) -> None:
            self.slices: list[list] = []
            self.size = 0

        def add(self, part: pa.RecordBatch, k: int, size: int) -> None:
            if self.slices and self.slices[-1][0] is part and self.slices[-1][2] == k:
                self.slices[-1][2] = k + 1
            else:
                self.slices.append([part, k, k + 1])
            self.size += size

        def take(self, other: Rows) -> None:
            for part, a, b in other.slices:
                self.add(part, a, 0)
                self.slices[-1][2] = b
            self.size += other.size

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 32
        whole, own, last, hot = Rows(), Rows(), None, None  # rows of complete ids, rows of the last id, that id, and the order of its batches so far
        for part in parts:
            sizes = [x + 1 for x in pc.binary_length(part.column(1)).fill_null(0).to_pylist()]
            for k, (i, size) in enumerate(zip(part.column(0).to_pylist(), sizes, strict=True)):
                if i != last and own.slices:
                    if hot is not None or (whole.slices and whole.size + own.size > batch_bytes):
                        out, o = (own, hot) if hot is not None else (whole, b)
                        yield pack(b, o, out.slices, hot is not None)
                        b, whole = b + 1, Rows() if hot is not None else own
                    else:
                        whole.take(own)
                    own, hot = Rows(), None
                last = i
                own.add(part, k, size)
                if own.size > batch_bytes and len(own.slices) + own.slices[0][2] - own.slices[0][1] > 2:
                    if whole.slices:
                        yield pack(b, b, whole.slices, False)
                        b, whole = b + 1, Rows()
                    hot = b if hot is None else hot
                    yield pack(b, hot, own.slices, True)
                    b, own = b + 1, Rows()
        for out, o in ((whole, None), (own, hot)):
            if out.slices:
                yield pack(b, b if o is None else o, out.slices, o is not None and out is own)
                b += 1

    return task


class _Batch:
    """The documents of one batch, and their windows."""

    def __init__(self, row: dict, window: int, bits: int) -> None:
        self.b, self.o, self.window, self.bits = row["b"], row["o"], window, bits
        self.rows = pa.ipc.open_stream(row["rows"]).read_all()

    def words(self) -> Iterator[W.Words]:
        return W.tokenized(self.rows.column("text"))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, check, order among rows of one id, start) of all windows, in the order of the texts."""
        parts: list[list[np.ndarray]] = [[], [], [], []]
        ids = self.rows.column("id").combine_chunks()
        same = pc.equal(ids.slice(1), ids.slice(0, max(0, len(ids) - 1))).fill_null(False).to_numpy(zero_copy_only=False)
        turn = np.concatenate([np.zeros(min(1, len(ids)), np.int32), np.cumsum(~same, dtype=np.int32)])
        turn[len(ids) - ids.null_count :] = len(ids)  # nulls are one id, the last
        self.repeats = len(np.unique(turn)) < len(turn)  # whether rows repeat an id
        for words in self.words():
            s = W.window_starts(words.first, self.window)
            doc = words.doc()[s]
            spans = [W.spans(words.hashes(salt), s, s + self.window) for salt in (0, 1)]
            for to, x in zip(parts, (spans[0], (spans[1] >> np.uint64(32)).astype(np.uint32), turn[words.lo + doc], (s - words.first[doc]).astype(np.int32)), strict=True):
                to.append(x)
        return tuple(np.concatenate([*p, np.zeros(0, t)]) for p, t in zip(parts, (np.uint64, np.uint32, np.int32, np.int32), strict=True))

    def distinct(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """(hash, check, start) of the distinct windows in order, each window's place among them, and whether it isn't its first occurrence here."""
        h, c, turn, start = self.windows()
        order = np.argsort(h, kind="stable")  # texts are in the order of their ids, so the first of equals is the earliest
        if len(h) and _mixed(h[order], c[order]):
            order = np.lexsort((c, h))
        fresh = _fresh(h[order], c[order])
        group, lead = np.empty(len(h), np.int32), order[fresh]
        group[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        if self.repeats:
            first = np.lexsort((start, turn, group))
            lead = first[np.concatenate([[True], np.diff(group[first]) > 0])]
        later = (turn != turn[lead][group]) | (start != start[lead][group])
        return (h[lead], c[lead], start[lead]), group, later


def _fresh(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return new


def _mixed(h: np.ndarray, c: np.ndarray) -> bool:
    """Whether equal hashes, in order, have different checks."""
    return bool(((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any())


def runs_of(window: int, bits: int):
    """Batches to their distinct windows by range; starts go along for ids of several batches."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                batch = _Batch(row, window, bits)
                (h, c, start), _, _ = batch.distinct()
                cut, several = sliced(h, bits), row["several"]
                full = np.flatnonzero(np.diff(cut))
                blob = lambda x, f: pa.array([f(x[cut[r] : cut[r + 1]]) for r in full], pa.binary())  # noqa: B023, E731
                starts = blob(start, np.ndarray.tobytes) if several else pa.nulls(len(full), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), batch.b)), pa.array(np.full(len(full), batch.o)), pa.array(full.astype(np.int32)), blob(h, ascending), blob(c, np.ndarray.tobytes), starts], ["b", "o", "range", "hashes", "checks", "starts"])

    return task


def _marks(b: list[int], marked: list[np.ndarray], r: int) -> list[dict]:
    return [{"b": x, "bits": np.packbits(m).tobytes(), "range": r, "kind": "mark"} for x, m in zip(b, marked, strict=True) if m.any()]


def _found(rows: list[dict]) -> pa.Table:
    kinds = {"b": pa.int64(), "bits": pa.binary(), "hashes": pa.binary(), "checks": pa.binary(), "range": pa.int32(), "kind": pa.string()}
    return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in kinds.items()})


def merge_batches(keep: bool):
    """One range of a load: marks what an earlier batch has as well, and makes the load's run of it."""

    def merge(t: pa.Table) -> pa.Table:
        got = t.sort_by([("o", "ascending"), ("b", "ascending")]).to_pylist()
        runs = [ascended(r["hashes"]) for r in got]
        h, c = np.concatenate(runs), np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in got])
        n = [len(x) for x in runs]
        o = np.repeat(np.array([r["o"] for r in got]), n)
        order = np.argsort(h, kind="stable")
        start = np.zeros(0, np.int32)
        if any(r["starts"] for r in got):
            start = np.concatenate([np.frombuffer(r["starts"], np.int32) if r["starts"] else np.zeros(k, np.int32) for r, k in zip(got, n, strict=True)])
            order = np.lexsort((start, o, c, h))
        elif _mixed(h[order], c[order]):
            order = np.lexsort((o, c, h))
        fresh = _fresh(h[order], c[order])
        lead = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        later = np.empty(len(h), bool)
        later[order] = (o[order] != o[lead]) | (start[order] != start[lead] if len(start) else False)
        rows = _marks([r["b"] for r in got], np.split(later, np.cumsum(n)[:-1]), got[0]["range"])
        if keep:
            rows.append({"hashes": ascending(h[order][fresh]), "checks": c[order][fresh].tobytes(), "range": got[0]["range"], "kind": "run"})
        return _found(rows)

    return merge


def merge_history(t: pa.Table, history: pa.Table) -> pa.Table:
    """One range of a load against that of a run of the index: marks what the run holds."""
    if not t.num_rows or not history.num_rows:
        return _found([])
    old = [(ascended(r["hashes"]), np.frombuffer(r["checks"], np.uint32)) for r in history.to_pylist()]
    b, marked = [], []
    for r in t.to_pylist():
        h, c = ascended(r["hashes"]), np.frombuffer(r["checks"], np.uint32)
        found = np.zeros(len(h), bool)
        for oh, oc in old:
            at = np.searchsorted(oh, h)
            while True:  # one step more for each further entry of one hash
                same = (at < len(oh)) & (oh[np.minimum(at, len(oh) - 1)] == h)
                hit = same & (oc[np.minimum(at, len(oh) - 1)] == c)
                found |= hit
                if not (same & ~found).any():
                    break
                at = at + 1
        b.append(r["b"])
        marked.append(found)
    return _found(_marks(b, marked, t["range"][0].as_py()))


def fused(a: pa.Table, b: pa.Table) -> pa.Table:
    """One range of two runs as one."""
    got = [*a.to_pylist(), *b.to_pylist()]
    h, c = np.concatenate([ascended(r["hashes"]) for r in got]), np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in got])
    order = np.argsort(h, kind="stable")
    if _mixed(h[order], c[order]):
        order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = _fresh(h, c)
    return pa.table({"range": pa.array([got[0]["range"]], pa.int32()), "hashes": pa.array([ascending(h[new])], pa.binary()), "checks": pa.array([c[new].tobytes()], pa.binary())})


def resliced(before: int, bits: int):
    """Ranges of a run into narrower ones."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                h, c = ascended(r["hashes"]), np.frombuffer(r["checks"], np.uint32)
                cut = sliced(h, bits)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([ascending(h[cut[k] : cut[k + 1]]) for k in full], pa.binary()), pa.array([c[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], ["range", "hashes", "checks"])

    return task


class FingerprintIndex:
    """Immutable sorted runs of window hashes in a folder, cut into 2**bits ranges. A manifest lists the live runs; the last complete one counts."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW) -> None:
        self.spark, self.path, self.window = spark, path.rstrip("/"), window

    def _manifests(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self) -> dict:
        """bits, runs (folders) and bytes (of text, so far)."""
        done = self._manifests()
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{done[-1]}").first().value) if done else {"bits": 0, "runs": [], "bytes": 0}

    def live(self) -> list[str]:
        return self.manifest()["runs"]

    def publish(self, state: dict) -> None:
        n = max(self._manifests(), default=0) + 1
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{n}")

    def run(self, name: str) -> DataFrame:
        """(range, hashes, checks) of one run."""
        return opened(self.spark, f"{self.path}/{name}", FOUND, "kind").filter("kind = 'run'").select("range", "hashes", "checks")

    def widen(self, size: int) -> int:
        """As many ranges as texts of `size` bytes more need; runs of fewer are rewritten."""
        state = self.manifest()
        bits = max(state["bits"], 5, math.ceil(math.log2(max(1, (state["bytes"] + size) / WORD_BYTES / RANGE))))
        if state["runs"] and bits > state["bits"]:
            self.publish(state | {"bits": bits, "runs": [self._written(self.run(r).mapInArrow(resliced(state["bits"], bits), CELL)) for r in state["runs"]]})
            self._forget(state["runs"])
        return bits

    def _written(self, cells: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows = cells.select(F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("bits"), "hashes", "checks", "range", F.lit("run").alias("kind"))
        bucketed(rows, name, "range", path=f"{self.path}/{name}", by="kind")
        return name

    def _forget(self, runs: list[str]) -> None:
        for r in runs:
            delete(self.spark, f"{self.path}/{r}")

    def compact(self) -> None:
        """Merge all live runs into one, two at a time, range by range."""
        state = self.manifest()
        while len(state["runs"]) > 1:
            one, two, *rest = state["runs"]
            both = self.run(one).groupBy("range").cogroup(self.run(two).groupBy("range")).applyInArrow(fused, CELL)
            state = state | {"runs": [*rest, self._written(both)]}
            self.publish(state)
            self._forget([one, two])

    def load(self, base: DataFrame, size: int, rows: int, batch_bytes: int, keep: bool) -> tuple[DataFrame, DataFrame, int]:
        """The batches (id, text, ...) of a load of so many bytes of text and rows, the marks on them, and the bits; with keep, the load becomes a run."""
        bits = self.widen(size)
        if len(self.live()) >= RUNS:
            self.compact()
        state = self.manifest()
        parts = max(1, math.ceil((size + rows) / batch_bytes))
        dealt = base.repartitionByRange(parts, F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last())
        cut = bucketed(dealt.mapInArrow(batches(batch_bytes), BATCHES), "substring_batches", "b")
        new = cut.mapInArrow(runs_of(self.window, bits), RUN)
        found = new.groupBy("range").applyInArrow(merge_batches(keep), FOUND)
        for name in state["runs"]:
            found = found.unionByName(new.groupBy("range").cogroup(self.run(name).groupBy("range")).applyInArrow(merge_history, FOUND))
        name = f"run_{uuid.uuid4().hex}"
        out = bucketed(found, name, "range", path=f"{self.path}/{name}", by="kind")
        if keep:
            self.publish(state | {"bits": bits, "runs": [*state["runs"], name], "bytes": state["bytes"] + size})
        return cut, out.filter("kind = 'mark'").select("b", "range", "bits"), bits


def apply_marks(window: int, bits: int, names: list[str], layout: bool):
    """A batch and its marks to its rows: what is removed and what is left."""

    def task(own: pa.Table, marks: pa.Table) -> pa.Table:
        batch = _Batch(own.to_pylist()[0], window, bits)
        (h, _, _), group, gone = batch.distinct()
        cut = sliced(h, bits)
        marked = np.zeros(len(h), bool)
        for r in marks.to_pylist():
            lo, hi = cut[r["range"]], cut[r["range"] + 1]
            marked[lo:hi] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
        gone = gone | marked[group]
        n_words, n_removed, spans, kept, done = [], [], [], [], 0
        for words in batch.words():
            s = W.window_starts(words.first, window)
            s = s[gone[done : (done := done + len(s))]]
            cover = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + window, -1)
            out = np.cumsum(cover[:-1]) > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(out)])[words.first])
            n_words += words.counts().tolist()
            n_removed += lost.tolist()
            for d in range(words.hi - words.lo):
                text = words.data[words.bounds[d] : words.bounds[d + 1]].tobytes()
                if lost[d]:
                    mask = out[words.first[d] : words.first[d + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(b" ".join(compress(text.split(), (~mask).tolist())).decode())
                else:
                    spans.append([])
                    kept.append((text if layout else b" ".join(text.split())).decode())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        rows = batch.rows
        if layout:  # a null text stays one
            kept = [None if null else x for x, null in zip(kept, rows["text"].is_null().to_pylist(), strict=True)]
        out = {"id": rows["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, kind), "kept_text": pa.array(kept, pa.string())}
        return pa.table(out | {f"c{k}": rows[name] for k, name in enumerate(names)})

    return task


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, batch_bytes: int = BATCH_BYTES, loads: int = LOADS, index: FingerprintIndex | None = None, layout: bool = False) -> DataFrame:
    """Remove every word that a window covers whose words also start earlier.

    Earlier is a smaller id, or an earlier start in the same document; with an index,
    also any document that it holds. Windows are judged on the input. Returns one row per
    row: the id, n_words long, n_removed long, removed array<struct<start int, end int>>
    (word spans), kept_text string (kept words joined by one space; with layout, a text
    that nothing is removed from as it is), and the columns named in `carry`.

    A null text has no words. A null id counts as one id after all others. Rows that
    repeat an id are never earlier than each other at the same start. A text shorter
    than the window keeps all words. An empty table gives an empty result. Columns of
    docs that are not named here are not read. Without an index, the documents go through
    one of their own in `loads` loads of rising ids, and it is deleted. With one, they are
    one load, which is added to it; calls should come in the order of their ids.

    Windows are equal where 96 bits of two independent hashes of their words are: of
    10^13 windows, one is expected to be taken for another with probability 10^-3.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    carried = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry) if c != text_col]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carried)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])
    names = ["text" if c == text_col else f"c{k}" for k, c in enumerate(carry)]
    for k, name in enumerate(names):
        schema.add(f"c{k}", base.schema[name].dataType)

    cuts = [F.lit(True)]
    if index is None:
        own = FingerprintIndex(spark, f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}", window)
        ends = base.agg(F.percentile_approx("id", [(k + 1) / loads for k in range(loads - 1)], 10000)).first()[0] if loads > 1 else None
        ends = sorted(set(ends or []))
        if ends:
            cuts = [F.col("id") <= ends[0], *((F.col("id") > a) & (F.col("id") <= b) for a, b in zip(ends, ends[1:], strict=False)), F.col("id").isNull() | (F.col("id") > ends[-1])]
    else:
        own = index
    sizes = base.agg(*(x for c in cuts for x in (F.coalesce(F.sum(F.when(c, F.octet_length("text"))), F.lit(0)), F.count_if(c)))).first()
    out = None
    for k, c in enumerate(cuts):
        cut, marks, bits = own.load(base.filter(c), sizes[2 * k], sizes[2 * k + 1], batch_bytes, index is not None or k + 1 < len(cuts))
        found = materialize(cut.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(apply_marks(own.window, bits, names, layout), schema), "kept")
        discard(cut)
        out = found if out is None else out.unionByName(found)
    if index is None:
        delete(spark, own.path)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", "kept_text", *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# Windows are compared as lists of words. Exact, but one row for each word: for tests and the SQL check.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS g FROM p),
m AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM m, (SELECT unnest(range(0, 20)) AS o) WHERE r > 1),
lost AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(l), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN l IS NULL THEN words ELSE (SELECT coalesce(list(words[i] ORDER BY i), []) FROM unnest(range(1, len(words) + 1)) t(i) WHERE NOT list_contains(l, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""

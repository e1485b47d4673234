"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which tokens meet.

Both tokenizations of a batch of documents are laid on one axis of bytes. Ends of tokens are
cumulative sums; the ends that both have (`intersect1d`) cut the tokens into groups
(`searchsorted`); each A token is repeated for the B tokens whose bytes it overlaps, which
gives all links without a loop. Documents begin at common cuts, so whole batches are aligned at
once.

Counting how many documents link a pair of ids is a shuffle: each chunk of documents hands on
each of its pairs once, with the number of its documents, so that a frequent pair has a row for
each chunk at most, and a salted sum in two stages leaves no key to one task. The counts then go
back to the chunks that asked for them, never to the driver and never to all.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm._pack import packed, unpacked
from srcatlas.llm._store import bound_batches, materialize, release

#: Bytes of text aligned at once, and kept together as a chunk; a longer document is one alone.
BATCH_BYTES, CHUNK_BYTES = 1 << 20, 1 << 23
#: Characters that a library gets at once, about; a text without a cut goes whole.
PART_CHARS = 1 << 18
SALTS = 16
#: A pair is a's id times this and b's.
B_IDS = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The printable characters of a byte-level vocabulary and the bytes they stand for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: How a byte-level vocabulary cuts a text before it merges bytes (a fixed value of the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Tokens:
    """The bytes of a vocabulary's tokens, as one table."""

    def _laid_out(self) -> None:
        raw = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(raw), np.uint8)

    def joined(self, ids: bytes) -> bytes:
        """The bytes of all tokens of unsigned 32-bit ids."""
        own = np.frombuffer(ids, np.uint32)
        size = self.size[own]
        begin = np.cumsum(size) - size
        return self.table[np.arange(int(size.sum())) + np.repeat(self.start[own] - begin, size)].tobytes()


class ByteTokens(_Tokens):
    """A byte-level BPE file of the tokenizers library. Where its merges stand in the order of their ids, which is what
    tiktoken takes for ranks, that library encodes (several times as fast, the same ids)."""

    def __init__(self, content: str) -> None:
        letters = byte_alphabet()
        spec = json.loads(content)
        vocabulary, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        self.content, self._slow = content, None
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self._laid_out()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.fast = None
        if [vocabulary["".join(m)] for m in merges] == list(range(256, 256 + len(merges))):
            from tiktoken import Encoding

            self.fast = Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for t, i in vocabulary.items() if t not in special}, special_tokens={})

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.content)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Tokens of a space and each text."""
        if self.fast is None:
            return [self.slow(f" {t}") for t in texts]
        return [self.fast.encode_ordinary(f" {t}") for t in texts]


class PieceTokens(_Tokens):
    """A sentencepiece model; it adds the space itself."""

    def __init__(self, content: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=content)
        self.bytes: dict[int, bytes] = {}
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode()
        if any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.bytes.values()):
            raise ValueError("a piece goes on after a space; texts can't be cut there")
        self._laid_out()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


#: No token of either kind crosses a space after a character that is no white space (nor a piece's own mark), and what comes after it is encoded the same whatever comes before.
_CUT = re.compile(r"(?<=[^\s▁]) ")


def parts_of(text: str, size: int) -> list[str]:
    """Parts of a text of about `size` characters, each to be encoded after a space: the libraries' memory grows with what they get at once."""
    out, at = [], 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.end()
    # A space at the very end would be left alone, and is no text of its own.
    return [*out, text[at:]] if at < len(text) or not out else [*out[:-1], f"{out[-1]} "]


class Pair:
    """Two tokenizers."""

    def __init__(self, a: ByteTokens, b: PieceTokens, part: int = PART_CHARS) -> None:
        self.a, self.b, self.part = a, b, part
        self.a_size, self.b_size = a.size, b.size
        # A separator stands before each token: none, comma, semicolon, or bar before a group's first B token.
        self.names = [sep + str(i) for n in (len(self.a_size), len(self.b_size)) for sep in ("", ",", ";", "|") for i in range(n)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text by both, as unsigned 32-bit numbers; none for an empty text and for one whose bytes don't come back."""
        split = [parts_of(t, self.part) if t else [] for t in texts]
        parts = list(chain.from_iterable(split))
        many = [len(p) for p in split]
        raws = [f" {t}".encode() if t else b"" for t in texts]
        outs = []
        for t in (self.a, self.b):
            found = iter([array("I", ids).tobytes() for ids in t.encode(parts)])
            outs.append([b"".join(islice(found, n)) for n in many])
        a, b = outs
        if not all(t.joined(b"".join(out)) == b"".join(raws) for t, out in zip((self.a, self.b), outs, strict=True)):
            for k, raw in enumerate(raws):
                if self.a.joined(a[k]) != raw or self.b.joined(b[k]) != raw:
                    a[k] = b[k] = b""
        return a, b


class Aligned:
    """Groups and links of a batch of documents. Tokens of both kinds lie on one axis, document after document."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_count: np.ndarray, b_count: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a, self.b, self.a_count, self.b_count = a, b, a_count, b_count
        a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        #: The group of each token, over the batch.
        self.a_group, self.b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        # B tokens whose bytes an A token overlaps: from the first that ends after its start to the last that starts before its end.
        first = np.searchsorted(b_end, a_end - a_size[a], "right")
        last = np.searchsorted(b_end - b_size[b], a_end, "left")
        fan = last - first
        start = np.cumsum(fan) - fan
        self.link_a = np.repeat(np.arange(len(a)), fan)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(start - first, fan)
        n = len(a_count)
        self.a_doc = np.repeat(np.arange(n), a_count)
        self.n_groups = np.bincount(self.a_doc[np.flatnonzero(np.diff(self.a_group, prepend=-1))], minlength=n)
        self.link_doc = self.a_doc[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=n)

    def groups(self, names: list[str], a_many: int, b_many: int) -> list[str]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`. Names are those of A ids and then of B ids, with each separator before them."""
        doc_first = np.zeros(len(self.a), bool)
        doc_first[(np.cumsum(self.a_count) - self.a_count)[self.a_count > 0]] = True
        opens = np.diff(self.a_group, prepend=-1) != 0
        a_code = self.a + a_many * np.where(doc_first, 0, np.where(opens, 2, 1))
        b_code = self.b + b_many * np.where(np.diff(self.b_group, prepend=-1) != 0, 3, 1) + 4 * a_many
        order = np.argsort(np.concatenate([self.a_group * 2, self.b_group * 2 + 1]), kind="stable")
        shown = list(map(names.__getitem__, np.concatenate([a_code, b_code])[order].tolist()))
        at = np.concatenate([[0], np.cumsum(self.a_count + self.b_count)]).tolist()
        return ["".join(shown[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) for each pair of ids that a document links."""
        pair = self.a[self.link_a].astype(np.int64) * B_IDS + self.b[self.link_b]
        order = np.lexsort((pair, self.link_doc))
        doc, pair = self.link_doc[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pair) != 0)])) if len(pair) else np.zeros(0, np.int64)
        return doc[new], pair[new], np.diff(np.append(new, len(pair)))


_PAIRS: dict[int, Pair] = {}


def pair_of(a: str, b: bytes) -> Pair:
    """One for each worker process."""
    key = hash((a, b))
    if key not in _PAIRS:
        _PAIRS[key] = Pair(ByteTokens(a), PieceTokens(b))
    return _PAIRS[key]


DOCUMENT = ["n_a", "n_b", "n_groups", "n_links"]
CHUNKS = "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs binary, counts binary, at binary, of binary, links binary"
_DIGEST = "groups_sha256"


class _Chunk:
    """Documents of a chunk as they come."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.columns: dict[str, list[np.ndarray]] = {c: [] for c in DOCUMENT}
        self.groups: list[str] = []
        self.pair: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.many: list[np.ndarray] = []  # pairs of each document
        self.size = 0

    def row(self, chunk: int) -> pa.RecordBatch:
        pair = np.concatenate(self.pair) if self.pair else np.zeros(0, np.int64)
        distinct, of, counts = np.unique(pair, return_inverse=True, return_counts=True)
        links = np.concatenate(self.links) if self.links else np.zeros(0, np.int64)
        values = [[chunk], [self.ids], *([np.concatenate(x).tolist() if x else []] for x in self.columns.values()), [self.groups], [packed(distinct)], [packed(counts.astype(np.uint32))]]
        values += [[packed(np.concatenate(self.many).astype(np.uint32) if self.many else np.zeros(0, np.uint32))], [packed(of.astype(np.uint32))], [packed(links.astype(np.uint32))]]
        lists = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 5]
        names = ["chunk", "ids", *DOCUMENT, "groups", "pairs", "counts", "at", "of", "links"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, lists, strict=True)], names)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "digest") -> DataFrame:
    """Chunks of aligned documents (see CHUNKS); the groups as text, or their digest."""
    from hashlib import sha256

    bound_batches(docs.sparkSession)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    shown = (lambda x: x) if groups == "text" else lambda x: sha256(x.encode()).hexdigest() if x else ""

    def batches_of(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
        """Documents of about BATCH_BYTES at once, and where they begin."""
        sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
        lo = 0
        while lo < len(column):
            done = int(sizes[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
            yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
            lo = hi

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        p = pair_of(*shared.value)
        chunk, number, base = _Chunk(), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, texts in batches_of(batch.column(1)):
                xs, ys = p.encode(texts)
                count = lambda parts: np.array([len(x) // 4 for x in parts], np.int64)
                al = Aligned(np.frombuffer(b"".join(xs), np.uint32).astype(np.int64), np.frombuffer(b"".join(ys), np.uint32).astype(np.int64), count(xs), count(ys), p.a_size, p.b_size)
                doc, pair, links = al.pairs()
                chunk.ids += ids[lo : lo + len(texts)]
                for name, x in zip(DOCUMENT, (al.a_count, al.b_count, al.n_groups, al.n_links), strict=True):
                    chunk.columns[name].append(x)
                chunk.groups += map(shown, al.groups(p.names, len(p.a_size), len(p.b_size)))
                chunk.pair.append(pair)
                chunk.links.append(links)
                chunk.many.append(np.bincount(doc, minlength=len(texts)))
                chunk.size += sum(map(len, texts))
                if chunk.size >= CHUNK_BYTES:
                    yield chunk.row(base + number)
                    chunk, number = _Chunk(), number + 1
        if chunk.ids:
            yield chunk.row(base + number)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, CHUNKS)


def pair_rows(chunks: DataFrame) -> DataFrame:
    """chunk, pair, n: the documents of a chunk that link a pair."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                pair, n = unpacked(pairs, np.int64), unpacked(counts, np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk, np.int64)), pa.array(pair), pa.array(n)], ["chunk", "pair", "n"])

    return chunks.select("chunk", "pairs", "counts").mapInArrow(task, "chunk long, pair long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs, best: how many documents link a pair, and is that the most of its A id. Salted sums first, then the sums of those; an A id has no more pairs than B has ids."""
    salted = rows.groupBy("pair", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("docs")).withColumn("a", F.floor(F.col("pair") / F.lit(B_IDS)))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a"))).drop("a")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def scored(chunks: DataFrame, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of all chunks, with the counts of their links."""
    answers = rows.select("chunk", "pair").join(counts, "pair").select("chunk", "pair", "docs", "best")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            pair = right["pair"].to_numpy()
            order = np.argsort(pair)
            docs, best = right["docs"].to_numpy()[order], right["best"].to_numpy()[order]
            of, links = unpacked(r["of"], np.uint32), unpacked(r["links"], np.uint32).astype(np.int64)
            many = unpacked(r["at"], np.uint32).astype(np.int64)
            ends = np.cumsum(many)

            def total(x: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(x)])
                return sums[ends] - sums[ends - many]  # noqa: B023

            columns = [r["ids"], *(r[c] for c in DOCUMENT), total(best[of] * links), total(docs[of] * links), r["groups"]]
            kinds = [pa.int64()] * 7 + [pa.string()]
            out.append(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", *DOCUMENT, "n_best", "count_sum", "groups"]))
        return pa.concat_tables(out)

    wide = chunks.drop("pairs", "counts")
    return wide.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(task, RESULT)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (as text, or as a digest).

    a_path is a byte-level BPE file of tokenizers, b_path a sentencepiece model; both encode a
    space and the text. A text that is null or empty, or whose bytes one of them doesn't give
    back, has no tokens: zeros, and '' as groups. Every row counts as a document, repeated ones
    too; ids may be null. An empty table gives an empty result. Other columns are not read.
    """
    chunks = materialize(aligned(docs, a_path, b_path, id_col, text_col, groups), "aligned")
    rows = materialize(pair_rows(chunks), "aligned-pairs")
    counts = materialize(pair_counts(rows), "aligned-counts")
    return scored(chunks, rows, counts)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    return align(table(spark, sf_dir, "documents"), *default_paths(), groups="digest").withColumnRenamed("groups", _DIGEST)

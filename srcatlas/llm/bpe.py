"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The transducer reads a pretoken byte by byte. For each prefix it holds the last
token of that prefix's encoding and where that token begins: BPE encodings are
exactly the token sequences whose neighbours, encoded together, stay as they are,
so one token fits. Later tokens can only begin within the longest token's length of
the end; what all those beginnings have in common is stable and is emitted. How many
bytes that can take at most, the lookahead, is computed from the merge list, and the
transducer holds no more than about twice as many, so memory doesn't grow with the
text. Every pretoken goes through it; what it said of short ones is remembered in
bounded tables.

The decoder is a machine of two states, before and after the first token, with a table
of what each token puts out in each; bytes that don't end a character are held back.
Whole columns of ids run through the same tables at once.
"""

from __future__ import annotations

import codecs
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm._store import bound_batches, release

END_OF_WORD = "</w>"
#: The white space of the vocabulary's patterns.
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Bytes of a chunk, characters of a pretoken and bytes of a prefix that are remembered, and half the chunks remembered.
CHUNK_BYTES, WORD_BYTES, PREFIX_BYTES, CHUNKS = 48, 64, 12, 1 << 18
_NONE = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a vocabulary file of the public `tokenizers` format with word ends."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()], default=-1) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len(self.tokens) > 1 << 20:
            raise ValueError("more than 2**20 tokens")
        # pair of ids -> rank and id of the merged token, all in one integer each
        self.merges = {self.ids[a] << 20 | self.ids[b]: rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.bytes = byte_alphabet()
        self.single = [self.ids[c] for c in self.bytes]
        self.final = [self.ids[c + END_OF_WORD] for c in self.bytes]
        back = {c: b for b, c in enumerate(self.bytes)}
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for token, i in self.ids.items():
            end = token.endswith(END_OF_WORD) and len(token) > len(END_OF_WORD)
            body = token.removesuffix(END_OF_WORD) if end else token
            if all(c in back for c in body):
                (self.last if end else self.inner)[bytes(back[c] for c in body)] = i
        self.raw = {i: b for b, i in [*self.inner.items(), *self.last.items()]}
        self.longest = max(map(len, [*self.inner, *self.last]), default=1)
        self._fits: dict[int, bool] = {}

    @cached_property
    def lookahead(self) -> int:
        """Bytes to the right of where a token begins that can decide on it.

        A merge of x and y can only be kept from happening by one of lower rank that
        takes y away to the right, or by what keeps y from being formed, which again
        needs lower ranks only. Taken in the order of ranks, the farthest reach of each
        token is therefore known from those before: `reach` holds, for each token, how far
        from its beginning the merges so far can carry an influence.
        """
        size = {i: len(b) for i, b in self.raw.items()}
        reach = dict(size)
        for pair, merged in self.merges.items():  # in the order of ranks
            x, y, z = pair >> 20, pair & 0xFFFFF, merged & 0xFFFFF
            over = size[x] + reach[y]
            reach[z] = max(reach[z], reach[x], over)
            reach[x] = max(reach[x], over)
        return max(reach.values(), default=1)

    def merge(self, word: bytes, end: bool = True) -> list[int]:
        """The encoding of one pretoken: the adjacent pair of least rank is merged first, leftmost first."""
        single, get = self.single, self.merges.get
        out = [single[b] for b in word]
        if end and word:
            out[-1] = self.final[word[-1]]
        found = [get(a << 20 | b, _NONE) for a, b in zip(out, out[1:], strict=False)]
        while found:
            best = min(found)
            if best == _NONE:
                break
            at, new = found.index(best), best & 0xFFFFF
            out[at] = new
            del out[at + 1], found[at]
            if at < len(found):
                found[at] = get(new << 20 | out[at + 1], _NONE)
            if at:
                found[at - 1] = get(out[at - 1] << 20 | new, _NONE)
        return out

    def fits(self, a: int, b: int, end: bool) -> bool:
        """Whether b can follow a: encoded together they stay these two (a < 0: whether b stays itself)."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * CHUNKS:
                self._fits.clear()
            own = self.raw[b]
            known = self._fits[key] = self.merge(own, end) == [b] if a < 0 else self.merge(self.raw[a] + own, end) == [a, b]
        return known


class Transducer:
    """Encodes one pretoken that comes in parts; holds the bytes and prefixes that are not yet stable."""

    def __init__(self, vocabulary: Vocabulary, prefixes: int = CHUNKS // 2) -> None:
        self.v, self.longest, self.room = vocabulary, vocabulary.longest, vocabulary.lookahead + vocabulary.longest
        self.prefixes, self.memory = prefixes, {}
        self.held = 0
        self._reset()

    def _reset(self) -> None:
        self.data = bytearray()  # bytes after the last stable boundary
        self.nodes: list[tuple[int, int] | None] = [(0, -1)]  # for each boundary: where its last token begins, and that token
        self.whole = True  # nothing has been emitted yet

    def _node(self, end: int, final: bool = False) -> tuple[int, int]:
        """Where the last token before a boundary begins, and that token: the longest that fits after what is before it."""
        known, fits, nodes = self.v.last if final else self.v.inner, self.v.fits, self.nodes
        lo = max(0, end - self.longest)
        data = bytes(self.data[lo:end])
        for at in range(lo, end):
            token = known.get(data[at - lo :])
            if token is not None and fits((nodes[at] or self._known(at))[1], token, final):
                return at, token
        raise ValueError("no token fits; the merge list is not consistent")

    def _known(self, end: int) -> tuple[int, int]:
        """A boundary's node, found when it is first asked for."""
        node = self.nodes[end]
        if node is None:
            if self.whole and end <= PREFIX_BYTES:
                prefix = bytes(self.data[:end])
                node = self.memory.get(prefix)
                if node is None:
                    if len(self.memory) >= self.prefixes:
                        self.memory.clear()
                    node = self.memory[prefix] = self._node(end)
            else:
                node = self._node(end)
            self.nodes[end] = node
        return node

    def _grow(self) -> None:
        """Boundaries for all bytes; many are settled from the left, so that nothing is looked up deeply."""
        n = len(self.data) - len(self.nodes) + 1
        at = len(self.nodes)
        self.nodes += [None] * n
        if n > WORD_BYTES:
            for end in range(at, len(self.data)):
                self._known(end)

    def feed(self, part: bytes) -> Iterator[int]:
        for lo in range(0, len(part), self.room):
            self.data += part[lo : lo + self.room]
            if len(self.data) > 2 * self.room:
                yield from self._settle()

    def _settle(self) -> Iterator[int]:
        """Emit what all beginnings of later tokens have in common."""
        self._grow()
        n = len(self.data) - 1  # the newest byte may be the word's last, so its boundary waits for the next one
        self.held = max(self.held, len(self.data))
        front = set(range(max(0, n + 1 - self.longest), n + 1))
        while len(front) > 1:
            front.add(self._known(top := max(front))[0])
            front.discard(top)
        stable = front.pop()
        if n - stable > self.room:
            raise ValueError("the lookahead is exceeded")
        yield from self._path(stable)
        self.nodes = [(0, self.nodes[stable][1]), *((x[0] - stable, x[1]) if x else None for x in self.nodes[stable + 1 : n + 1])]
        del self.data[:stable]
        self.whole = False

    def _path(self, node: int) -> list[int]:
        out = []
        while node > 0:
            node, token = self._known(node)
            out.append(token)
        return out[::-1]

    def finish(self) -> list[int]:
        out = []
        if self.data:
            self._grow()
            at, token = self._node(len(self.data), True)
            out = [*self._path(at), token]
        self._reset()
        return out

    def word(self, raw: bytes) -> list[int]:
        """The encoding of a whole pretoken."""
        return [*self.feed(raw), *self.finish()]


class Encoder:
    """Encodes whole texts as the vocabulary's pipeline does: special tokens, NFC, lower case, pretokens, BPE."""

    def __init__(self, vocabulary: Vocabulary, chunks: int = CHUNKS, merge=None) -> None:
        self.v, self.chunks, self.merge = vocabulary, chunks, merge
        self.transducer = None if merge else Transducer(vocabulary, chunks // 2)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.words: dict[str, list[int]] = {}
        self.words_before: dict[str, list[int]] = {}
        assert array("I").itemsize == 4 and all("<|" in s for s in vocabulary.special)
        names = "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(f"({names})") if names else None

    def _chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        parts = self.special.split(chunk) if self.special and "<|" in chunk else (chunk,)
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.v.special[part])
                continue
            if not part.isascii():
                # Lower case is taken character by character, so sigma has no final form.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            if part.isalpha():
                out += self._word(part)
            elif part[:-1].isalpha() and part[-1] in ".,;:!?":
                out += self._word(part[:-1])
                out += self._word(part[-1])
            else:
                for word in PRETOKEN.findall(part):
                    out += self._word(word)
        return out

    def _word(self, word: str) -> list[int]:
        if self.merge:
            return self.merge(word)
        out = self.words.get(word)
        if out is None:
            out = self.words_before.get(word)
            if out is None:
                out = self.transducer.word(word.encode())
            if len(word) <= WORD_BYTES:
                if len(self.words) >= self.chunks // 2:
                    self.words, self.words_before = {}, self.words
                self.words[word] = out
        return out

    def _learn(self, chunk: bytes) -> bytes:
        out = self.before.get(chunk)
        if out is None:
            out = array("I", self._chunk(chunk.decode()))
            if sys.byteorder == "big":
                out.byteswap()
            out = out.tobytes()
        if len(chunk) <= CHUNK_BYTES:
            if len(self.known) >= self.chunks:  # what was not asked for since the last change is forgotten
                self.known, self.before = {}, self.known
            self.known[chunk] = out
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, little-endian unsigned 32-bit. No token and no normal form crosses ASCII white space."""
        chunks = text.split()
        found = list(map(self.known.get, chunks))
        try:
            return b"".join(found)
        except TypeError:  # a chunk is not known yet
            learn = self._learn
            return b"".join([learn(c) if x is None else x for x, c in zip(found, chunks, strict=True)])


def library_merge(content: str):
    """The tokenizers library's own BPE of one pretoken, for operators that don't stream; the same ids as Vocabulary.merge."""
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_str(content).model.tokenize
    table = dict(enumerate(byte_alphabet()))

    def merge(word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()):  # else each character stands for its own byte
            word = word.encode().decode("latin-1").translate(table)
        return [t.id for t in tokenize(word)]

    return merge


class Decoder:
    """Turns ids into text, one by one or by the column.

    mode "joined": token strings with one space between, as the library does for a
    file without a decoder. mode "text": the bytes behind the tokens, a space for
    each word end, through an incremental UTF-8 machine that holds an unfinished
    character back and replaces what is not UTF-8.
    """

    def __init__(self, vocabulary: Vocabulary, mode: str = "joined") -> None:
        if mode not in ("joined", "text"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.size = mode, len(vocabulary.tokens)
        names = [t.encode() for t in vocabulary.tokens]
        if mode == "joined":
            begin, inside = names, [b" " + t for t in names]
        else:
            raw = vocabulary.raw
            inside = [raw[i] + b" " * t.endswith(END_OF_WORD.encode()) if i in raw else t for i, t in enumerate(names)]
            begin = inside
        #: What each token puts out: after others, and then as the first one.
        self.outputs = [*inside, *begin]
        self.table = pa.array(self.outputs, pa.large_binary())
        self.special = frozenset(range(self.size)) - frozenset(vocabulary.raw) if mode == "text" else frozenset()
        self._reset()

    def _reset(self) -> None:
        self.first = True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        """What this token adds; a character that is not complete is held back."""
        # A special token ends what is held back.
        head = self.utf8.decode(b"", True) if token in self.special else ""
        out = self.outputs[token + self.size if self.first else token]
        self.first = False
        return head + self.utf8.decode(out)

    def close(self) -> str:
        out = self.utf8.decode(b"", True)
        self._reset()
        return out

    def decode(self, tokens: Iterable[int]) -> str:
        return "".join([*map(self.push, tokens), self.close()])

    def column(self, ids: pa.ListArray) -> pa.Array:
        """The texts of a column of ids, nulls as empty; the state of a row is where its token stands in it."""
        at = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))]).astype(np.int64)
        tokens = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if self.special and np.isin(tokens, list(self.special)).any():
            return pa.array([self.decode(x or ()) for x in ids.to_pylist()], pa.large_string())
        begins = at[:-1][np.diff(at) > 0]
        tokens[begins] += self.size
        out = self.table.take(pa.array(tokens))
        if isinstance(out, pa.ChunkedArray):
            out = out.combine_chunks()
        _, offsets, data = out.buffers()
        bounds = np.frombuffer(offsets, np.int64)[out.offset : out.offset + len(out) + 1][at] if len(out) else np.zeros(len(at), np.int64)
        raw = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds.tobytes()), data if data is not None else pa.py_buffer(b"")])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # not UTF-8 somewhere
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """From a file of the driver; the content then goes to the workers with the task (under 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(content: str, chunks: int = CHUNKS, library: bool = False) -> Encoder:
    """One encoder for each vocabulary and worker process, so that what it remembers outlives a task."""
    key = hash((content, chunks, library))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(content), chunks, library_merge(content) if library else None)
    return _ENCODERS[key]


def file_content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()).to_pylist():
        yield x or b""


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every whole text; vocabulary is the path of the file.

    A null or empty text has no ids. Rows are independent: repeated rows, null ids and
    an empty table need no care. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(file_content(vocabulary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        e = encoder_of(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [e.encode(x) for x in texts_of(part.column(1))]
                at = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, mode: str = "joined") -> DataFrame:
    """(doc_id, ids) to doc_id, ids and text string; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(file_content(vocabulary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        d = Decoder(encoder_of(shared.value).v, mode)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), d.column(part.column(1)).cast(pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids array<int>, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    path = default_vocabulary()
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

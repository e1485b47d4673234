"""Batches of rows to postings, where the rows are: nothing is shuffled for single words.

A task reads rows in the order of their numbers. Texts come folded (functions.text.folded), so
tokens are cut out of a column's bytes at once, and no array of words is passed on for a row.
Each batch's tokens become codes of one
dictionary, one sort of integers brings those of a term in a block together, and the lists
are cut out of one flat array by their bounds, as bytes that Spark needn't take apart. A block's rows wait for each other over
batches; one that two tasks read has two postings, each right for its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from srcatlas.functions.text import ACCENTED, PLAIN

#: Token arrays by column, and the column of a row's filter terms.
LISTS, MARKS = ("name_t", "file_t", "content_t"), "marks"
MASKS = range(1, 1 << len(LISTS))
#: What an entry of a list holds beside its positions: place in the block, tokens, type, level, and the number of positions in each column.
HELD = 4 + len(LISTS)
NAMES = ["term", "block", "name_n", "file_n", "content_n", "least", "entries", *(f"m{m}" for m in MASKS)]
#: Lists of one Arrow batch that goes back to Spark.
LISTED = 20_000
#: The term of a row that has a task's number of rows and of their tokens as `m1` and `m2`.
SIZE = ""
#: Which bytes of a folded text belong to tokens.
_TOKEN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: What an accented letter, of two bytes always, becomes; 0 for others.
_BASE = np.zeros(1 << 11, np.int64)
_BASE[list(map(ord, ACCENTED))] = list(map(ord, PLAIN))


def sized(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: `postings` of rows whose columns are folded texts, without n_tokens, and the task's SIZE."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2, np.int64)

        def summed() -> Iterator[pa.RecordBatch]:
            for batch in words(batches):
                sums[:] += batch.num_rows, batch.column("n_tokens").to_numpy().sum(dtype=np.int64)
                yield batch

        yield from postings(bits)(summed())
        small = [pa.array([0], pa.int32())] * (len(LISTS) + 1)
        last = [pa.array([n], pa.int64()) for n in [*sums.tolist(), *[0] * (len(MASKS) - 2)]]
        yield pa.RecordBatch.from_arrays([pa.array([SIZE]), pa.array([0], pa.int64()), *small, pa.array([b""]), *last], NAMES)

    return task


def sized_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: `counts` of rows whose columns are folded texts, and the SIZE of each segment in each batch."""
    for batch in words(batches):
        yield from counts(iter([batch]))
        segment, of = np.unique(batch.column("segment").to_numpy(), return_inverse=True)
        tokens = np.zeros(len(segment), np.int64)
        np.add.at(tokens, of, batch.column("n_tokens").to_numpy())
        none = [pa.array(np.zeros(len(segment), np.int64))] * (len(MASKS) - 2)
        yield pa.RecordBatch.from_arrays([pa.array([SIZE] * len(segment)), pa.array(np.bincount(of, minlength=len(segment)).astype(np.int64)), pa.array(tokens), *none, pa.array(segment.astype(np.int32))], ["term", *(f"m{m}" for m in MASKS), "segment"])


def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded texts to token arrays, and n_tokens of each row."""
    for batch in batches:
        if batch.num_rows:
            rest = [c for c in batch.schema.names if c not in LISTS]
            lists = [_cut(batch.column(c)) for c in LISTS]
            n = sum(x.value_lengths().to_numpy() for x in lists)
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(n.astype(np.int32)), *lists], [*rest, "n_tokens", *LISTS])


def _without_accents(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of texts between bounds, with letters for accented letters, as functions.text.tokens has them."""
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # first bytes of U+00C0 to U+027F
    base = _BASE[((data[at] & 0x1F).astype(np.int64) << 6) | (data[at + 1] & 0x3F)]
    at, base = at[base > 0], base[base > 0]
    data, kept, short = data.copy(), np.ones(len(data), bool), base < 0x80
    data[at] = np.where(short, base, 0xC0 | base >> 6)
    data[at + 1] = 0x80 | base & 0x3F
    kept[at[short] + 1] = False
    return data[kept], np.append(0, np.cumsum(kept))[bounds]


def _cut(texts: pa.Array) -> pa.ListArray:
    """The tokens of folded texts."""
    _, bounds, held = texts.buffers()
    bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held or b"", np.uint8)[bounds[0] : bounds[-1]]
    data, bounds = _without_accents(data, bounds - bounds[0])
    own = _TOKEN[data]
    begins = own.copy()
    begins[1:] &= ~own[:-1]
    rows = bounds[:-1][bounds[:-1] < len(data)]
    begins[rows] = own[rows]  # tokens end where their text does
    upto = np.append(0, np.cumsum(own))
    at = np.append(upto[:-1][begins], upto[-1]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data[own]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(begins))[bounds].astype(np.int32)), tokens)


def postings(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (row, n_tokens, type, level, marks, name_t, file_t, content_t) to a posting for each term of each block of 2**bits rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            block = batch.column("row").to_numpy() >> bits
            if held[0].column("row")[0].as_py() >> bits == block[-1]:
                continue  # one block so far
            last = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
            done = [*held[:-1], held[-1].slice(0, last)]
            held = [held[-1].slice(last)]
            yield from _blocks(pa.concat_tables(done), bits)
        if held:
            yield from _blocks(pa.concat_tables(held), bits)

    return task


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (segment, marks, name_t, file_t, content_t) to rows that hold each term, by the columns they hold it in, for each batch and segment."""
    for batch in batches:
        if batch.num_rows:
            terms, code, row, column, _ = _tokens(batch)
            group = batch.column("segment").to_numpy().astype(np.int64)
            at, entry, first = _sorted(group, code, row, column)
            mask = _mask(_sizes(column[at], entry))
            sums = [np.add.reduceat((mask == m).astype(np.int64), first) for m in MASKS]
            head = at[np.append(0, np.flatnonzero(np.diff(entry)) + 1)[first]]
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[head])), *map(pa.array, sums), pa.array(group[row[head]].astype(np.int32))], ["term", *(f"m{m}" for m in MASKS), "segment"])


def _tokens(rows) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, and of each token its code, row, column (-1: a filter's term) and position."""
    values, row, column, position = [], [], [], []
    for k, name in enumerate((MARKS, *LISTS), -1):
        lists = rows.column(name)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        values.append(lists.flatten())
        row.append(np.repeat(np.arange(len(n)), n))
        column.append(np.full(len(values[-1]), k))
        position.append(np.arange(len(values[-1])) - np.repeat(np.cumsum(n) - n, n))
    coded = pa.concat_arrays(values).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), *map(np.concatenate, (row, column, position))


def _sorted(group: np.ndarray, code: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by term, group, row and column; which entry (a term in a row) each is of; and the first entry of each term in a group."""
    _, dense = np.unique(group, return_inverse=True)
    list_of = code * (int(dense.max()) + 1) + dense[row]
    key = (list_of * len(group) + row) * 4 + column + 1
    at = np.argsort(key, kind="stable")  # positions are in order already
    same = key[at] >> 2
    new = np.append(True, np.diff(same) != 0)
    lists = list_of[at][new]
    return at, np.cumsum(new) - 1, np.flatnonzero(np.append(True, np.diff(lists) != 0))


def _sizes(column: np.ndarray, entry: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(entry[column == k], minlength=int(entry[-1]) + 1) for k in range(len(LISTS))]


def _mask(sizes: list[np.ndarray]) -> np.ndarray:
    return sum((n > 0).astype(np.int64) << k for k, n in enumerate(sizes))


def _blocks(rows: pa.Table, bits: int) -> Iterator[pa.RecordBatch]:
    number = rows.column("row").to_numpy()
    terms, code, row, column, position = _tokens(rows)
    at, entry, first = _sorted(number >> bits, code, row, column)
    code, row, column, position = code[at], row[at], column[at], position[at]
    head = np.append(0, np.flatnonzero(np.diff(entry)) + 1)  # the first token of each entry
    sizes = _sizes(column, entry)
    mask = _mask(sizes)
    of = row[head]
    n_tokens, kind, level = (rows.column(name).to_numpy()[of].astype(np.int32) for name in ("n_tokens", "type", "level"))
    off = (number & ((1 << bits) - 1))[of]
    ends = np.append(first[1:], len(head))
    n = ends - first
    # A list: the number of entries, what each holds, and all positions.
    places = sum(sizes)
    upto = np.append(0, np.cumsum(places))
    size = 1 + HELD * n + upto[ends] - upto[first]
    start = np.append(0, np.cumsum(size))
    flat = np.empty(start[-1], np.int32)
    flat[start[:-1]] = n
    begin = np.repeat(start[:-1] + 1, n) + HELD * (np.arange(len(head)) - np.repeat(first, n))
    for k, x in enumerate((off, n_tokens, kind, level, *sizes)):
        flat[begin + k] = x
    own = column >= 0
    flat[np.repeat(start[:-1] + 1 + HELD * n - upto[first], upto[ends] - upto[first]) + np.arange(upto[-1])] = position[own]
    most = [np.maximum.reduceat(x, first).astype(np.int32) for x in sizes]
    least = np.minimum.reduceat(n_tokens, first)
    sums = [np.add.reduceat((mask == m).astype(np.int64), first) for m in MASKS]
    block = (number >> bits)[of][first]
    word = code[head][first]
    for a in range(0, len(first), LISTED):  # lists go back in parts
        b = min(a + LISTED, len(first))
        bounds = ((start[a : b + 1] - start[a]) * 4).astype(np.int32)
        entries = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(flat[start[a] : start[b]])])
        arrays = [terms.take(pa.array(word[a:b])), pa.array(block[a:b]), *(pa.array(x[a:b]) for x in (*most, least)), entries, *(pa.array(x[a:b]) for x in sums)]
        yield pa.RecordBatch.from_arrays(arrays, NAMES)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (segment, block, term, entries) to a row for each entry, with its positions by column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = np.frombuffer(b"".join(batch.column("entries").to_pylist()), np.int32)
        size = pa.compute.binary_length(batch.column("entries")).to_numpy() // 4
        start = np.cumsum(size) - size
        n = flat[start].astype(np.int64)
        held = np.repeat(start + 1 - HELD * (np.cumsum(n) - n), n) + HELD * np.arange(n.sum())
        off, n_tokens, kind, level, *sizes = (flat[held + k] for k in range(HELD))
        places = size - 1 - HELD * n
        at = np.repeat(start + 1 + HELD * n - (np.cumsum(places) - places), places) + np.arange(places.sum())
        position, column = flat[at], np.repeat(np.tile(np.arange(len(LISTS)), len(held)), np.stack(sizes, 1).ravel())
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(x)).astype(np.int32)), pa.array(position[column == k])) for k, x in enumerate(sizes)]
        of = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("segment", "block", "term")), *map(pa.array, (off, n_tokens, kind, level)), *lists], ["segment", "block", "term", "off", "n_tokens", "type", "level", "name", "file", "content"])

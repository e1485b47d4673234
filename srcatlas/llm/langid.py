"""Language ID by multilingual mixture inference.

Every language has a model of bytes given the three bytes before them inside a word,
from hashed n-gram counts over all training rows. A word's log-likelihood in a language
is the mean over its bytes' orders, and a document is a mixture: expectation-maximisation
over its words estimates each language's proportion. Languages are then taken in the
order of their proportions, one more as long as the likelihood, penalised by half the
logarithm of the number of words for each language, grows. The prediction is the set's
largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.llm import words as W
from srcatlas.llm._store import bound_batches, release
from srcatlas.llm.tables import PART, entries, merged

GRAMS, EM_STEPS, TEMPER = 1 << 16, 8, 0.5
SIZES = {"4": (GRAMS, np.int64), "3": (GRAMS, np.int64)}
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def grams(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of a word: the buckets of its 4-gram and of the three bytes before it; and for each word its first byte and its number of bytes. Before a word stand zeros."""
    n = words.end - words.start
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - first[:-1][word]
    at = words.start[word] + place
    data = words.data.astype(np.uint32)
    before = np.zeros(total, np.uint32)
    for back in (3, 2, 1):
        b = np.where(place >= back, data[np.maximum(at - back, 0)], 0)
        before = before << np.uint32(8) | b.astype(np.uint32)
    bucket = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    return bucket((before.astype(np.uint64) << np.uint64(8) | data[at]) + np.uint64(1)), bucket(before.astype(np.uint64) + np.uint64(1)), first[:-1], n


def tokenized(column: pa.Array) -> Iterator[W.Words]:
    return W.tokenized(column, chunk=1 << 18, breaks=W.NOT_LETTER, fold=W.FOLD)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, lang) to table entries; names are the table and the language."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column(1).to_pylist(), object)
        for words in tokenized(batch.column(0)):
            four, three, _, n = grams(words)
            own = np.repeat(lang[words.lo : words.hi][words.doc()], n)
            for x in set(own.tolist()):
                m = own == x
                for k, at in (("4", four), ("3", three)):
                    table = tables.setdefault(f"{k}{x}", np.zeros(*SIZES[k]))
                    table += np.bincount(at[m], minlength=GRAMS)
    yield from entries(tables)


class Mixture:
    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.langs = sorted({name[1:] for name in tables})
        get = lambda k: np.stack([tables.get(k + x, np.zeros(GRAMS)) for x in self.langs], axis=1) if self.langs else np.zeros((GRAMS, 0))
        self.four, self.three = np.log(get("4") + 0.05).astype(np.float32), np.log(get("3") + 8.0).astype(np.float32)

    def likelihoods(self, words: W.Words) -> np.ndarray:
        """log P(word | language), tempered, since neighbouring n-grams share bytes."""
        four, three, first, _ = grams(words)
        if not len(first):
            return np.zeros((0, len(self.langs)))
        return TEMPER * np.add.reduceat(self.four[four] - self.three[three], first, axis=0).astype(np.float64)

    def _sum(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums over each document's own words, by themselves: no other document of the batch changes a digit."""
        out = np.zeros((len(first) - 1, x.shape[1]))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            out[full] = np.add.reduceat(x, first[full], axis=0)
        return out

    def _em(self, p: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after `steps` rounds from `share`, and each document's log-likelihood (of p, which is scaled by word)."""
        n = np.maximum(np.diff(first), 1)[:, None]
        for _ in range(steps):
            r = p * share[doc]
            share = self._sum(r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300), first) / n
        fit = np.log(np.maximum((p * share[doc]).sum(axis=1, keepdims=True), 1e-300))
        return share, self._sum(fit, first)[:, 0]

    def predict(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: the index of its language, that language's share, and the number of languages taken."""
        ll = self.likelihoods(words)
        docs, k = words.hi - words.lo, len(self.langs)
        doc, first = words.doc(), words.first
        top = ll.max(axis=1, keepdims=True) if len(ll) else ll[:, :1]
        p = np.exp(ll - top)
        share, _ = self._em(p, doc, first, np.full((docs, k), 1 / max(k, 1)), EM_STEPS)
        # A single language keeps its exact likelihood: scaled words may vanish.
        single = self._sum(ll - top, first)
        best = single.argmax(axis=1)
        chosen = np.zeros((docs, k))
        chosen[np.arange(docs), best] = 1
        value, size = single[np.arange(docs), best], np.ones(docs, np.int64)
        order = np.argsort(-share, axis=1, kind="stable")
        penalty = np.log(np.maximum(np.diff(first), 2)) / 2
        alive = np.ones(docs, bool)
        for take in range(2, k + 1):
            mask = np.zeros((docs, k))
            np.put_along_axis(mask, order[:, :take], 1.0, axis=1)
            start = share * mask + 1e-6 * mask
            start /= np.maximum(start.sum(axis=1, keepdims=True), 1e-300)
            s, fit = self._em(p, doc, first, start, 2)
            better = alive & (fit - penalty * (take - 1) > value) & (fit > -1e290)
            value = np.where(better, fit - penalty * (take - 1), value)
            chosen[better], size[better] = s[better], take
            alive = better
            if not alive.any():
                break
        pick = chosen.argmax(axis=1)
        return pick, chosen[np.arange(docs), pick], size


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: doc_id, held_out boolean, lang_pred string, score double (share of the document), n_langs int, and the columns in `carry`.

    Learned from rows with a language whose crc32(id) mod 4 is not 2; a prediction
    depends on the text alone, to the last digit of its score, so repeated rows get equal
    ones (each repetition counts in learning). A text of any length is handled whole. `und` with score 0 if the text is null, has no letter, or
    no language could be learned. Null ids are never held out. Memory grows with the
    number of languages (1 MB each). An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rest = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = base.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(rest, F.lit(0)) != 2))
    tables = merged(known.select("text", "lang").mapInArrow(count, PART), lambda name: SIZES[name[0]])
    shared = docs.sparkSession.sparkContext.broadcast(Mixture(tables))
    carried = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry) if c != text_col]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carried)
    held = ["text" if c == text_col else f"c{k}" for k, c in enumerate(carry)]
    kept = (T.StructField(f"c{k}", source.schema[name].dataType) for k, name in enumerate(held))
    schema = T.StructType([source.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_langs", T.IntegerType()), *kept])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in batches:
            lettered = np.array([x is not None and LETTER.search(x) is not None for x in batch.column(1).to_pylist()], bool) & bool(model.langs)
            pick, score, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            if model.langs:
                for words in tokenized(batch.column(1)):
                    pick[words.lo : words.hi], score[words.lo : words.hi], size[words.lo : words.hi] = model.predict(words)
            names = pa.array([model.langs[x] if y else UNKNOWN for x, y in zip(pick, lettered, strict=True)])
            columns = [batch.column(0), names, pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0)), pa.array(np.where(lettered, size, 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(name) for name in held)], schema.names)

    found = source.mapInArrow(task, schema)
    held = F.coalesce(rest == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "n_langs", *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry) if c != "doc_id"))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    return identify(table(spark, sf_dir, "documents")).drop("n_langs")

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from srcatlas.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = langid.query(spark, sf_dir).collect()
    assert out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"} and len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    for held in (True, False):
        own = [r for r in out if r.held_out == held]
        assert sum(r.lang_pred == truth[r.doc_id] for r in own) / len(own) > 0.97


def test_mixtures_and_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    words = {lang: " ".join(r.text for r in docs.filter(f"lang = '{lang}'").limit(4).collect()).split() for lang in ("en", "de")}
    mixed = " ".join(words["en"][:300] + words["de"][:100])
    rows = [(10**6, mixed, None), (10**6 + 1, None, None), (10**6 + 2, "12 34 --", None), (10**6 + 3, "", "en"), (None, "the of and", None), (10**6 + 4, "the " * 50000, None), (10**6 + 5, "???", "xx")]
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in langid.identify(df).filter("doc_id >= 1000000 or doc_id is null").collect()}
    assert out[10**6].lang_pred == "en" and out[10**6].n_langs == 2 and abs(out[10**6].score - 0.75) < 0.06
    assert [(out[10**6 + k].lang_pred, out[10**6 + k].score) for k in (1, 2, 3, 5)] == [("und", 0.0)] * 4
    assert out[None].lang_pred == "en" and out[None].held_out is False and out[10**6 + 4].lang_pred == "en"


def test_carried_columns_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, "s"), (2, None, None, None)], SCHEMA)
    out = langid.identify(df.withColumnRenamed("score", "source"), carry=("text", "source"))
    assert sorted((r.doc_id, r.lang_pred, r.text or "", r.source or "") for r in out.collect()) == [(1, "und", "abc", "s"), (2, "und", "", "")]
    assert langid.identify(df.limit(0)).count() == 0


def learned(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text and r.lang]
    parts = list(langid.count(iter([pa.RecordBatch.from_arrays([pa.array([r.text for r in rows]), pa.array([r.lang for r in rows])], ["text", "lang"])])))
    tables = {}
    for words in langid.tokenized(pa.array([r.text for r in rows])):
        four, three, _, n = langid.grams(words)
        own = np.repeat(np.array([r.lang for r in rows], object)[words.lo : words.hi][words.doc()], n)
        for lang in set(own.tolist()):
            for k, at in (("4", four), ("3", three)):
                tables.setdefault(k + lang, np.zeros(langid.GRAMS, np.int64))
                tables[k + lang] += np.bincount(at[own == lang], minlength=langid.GRAMS)
    assert parts
    return langid.Mixture(tables), [r.text for r in rows]


def answers(model, texts):
    out = []
    for words in langid.tokenized(pa.array(texts)):
        out += zip(*(x.tolist() for x in model.predict(words)), strict=True)
    return out


def test_neighbours_change_no_digit(spark, sf_dir):
    model, texts = learned(spark, sf_dir)
    texts = [*texts[:150], "", *texts[:3], "\n".join(texts[20:60]), ""]
    assert answers(model, texts) == [answers(model, [t])[0] for t in texts]


def by_hand(model, text):
    """Expectation-maximisation word by word, with plain sums."""
    words = next(langid.tokenized(pa.array([text])))
    ll, n, k = model.likelihoods(words).tolist(), len(words.start), len(model.langs)
    p = [[math.exp(x - max(row)) for x in row] for row in ll]

    def em(share, steps):
        for _ in range(steps):
            new = [0.0] * k
            for row in p:
                total = sum(a * b for a, b in zip(row, share, strict=True))
                for j in range(k):
                    new[j] += row[j] * share[j] / max(total, 1e-300) / n
            share = new
        return share, sum(math.log(max(sum(a * b for a, b in zip(row, share, strict=True)), 1e-300)) for row in p)

    share, _ = em([1 / k] * k, langid.EM_STEPS)
    single = [sum(row[j] - max(row) for row in ll) for j in range(k)]
    best = max(range(k), key=lambda j: single[j])
    chosen, value, size = [float(j == best) for j in range(k)], single[best], 1
    order = sorted(range(k), key=lambda j: -share[j])
    for take in range(2, k + 1):
        start = [share[j] + 1e-6 if j in order[:take] else 0.0 for j in range(k)]
        s, fit = em([x / sum(start) for x in start], 2)
        if fit - math.log(max(n, 2)) / 2 * (take - 1) <= value:
            break
        chosen, value, size = s, fit - math.log(max(n, 2)) / 2 * (take - 1), take
    pick = max(range(k), key=lambda j: chosen[j])
    return pick, chosen[pick], size


def test_mixtures_equal_those_worked_out_by_hand(spark, sf_dir):
    model, texts = learned(spark, sf_dir)
    texts = [t for t in texts[:60] if t.split()] + [f"{a} {b}" for a, b in zip(texts[:20], texts[20:40], strict=True)]
    for got, text in zip(answers(model, texts), texts, strict=True):
        want = by_hand(model, text)
        assert got[0] == want[0] and got[2] == want[2] and abs(got[1] - want[1]) < 1e-9


def test_repeated_rows_get_equal_answers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = defaultdict(set)
    out = langid.identify(docs.unionByName(docs.limit(40)).repartition(3)).collect()
    for r in out:
        found[r.doc_id].add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in found.values()) and Counter(r.doc_id for r in out).most_common(1)[0][1] == 2

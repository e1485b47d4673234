import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from srcatlas.llm import bpe, jaccard, langid, pipeline, substring, toxicity
from srcatlas.llm._store import materialize

COLUMNS = list(pipeline.COLUMNS)


def test_stages_one_by_one(spark, sf_dir):
    """Each stage against its operator's rows, which other tests hold against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 -- 34", None, "s", 8)], docs.schema)
    docs = docs.unionByName(odd)
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = materialize(pipeline.languages(spark, docs, sf_dir), "t")
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    want = {r.doc_id for r in langid.identify(docs).filter(F.col("lang_pred") != "und").collect()}
    assert ids == want and set(text) - ids == {10**6, 10**6 + 1}

    clean = materialize(pipeline.not_toxic(spark, kept, sf_dir), "t")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(kept, labels).filter("predicted = 0").collect()}
    assert all(r.text == text[r.doc_id] for r in clean.collect())

    single = materialize(pipeline.one_of_each(spark, clean, sf_dir), "t")
    groups = {r.doc_id: r.class_id for r in jaccard.near_duplicates(clean).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    cut = materialize(pipeline.without_repeats(spark, single, sf_dir), "t")
    removed = {r.doc_id: r for r in substring.dedup(single).collect()}
    for r in cut.collect():
        assert r.text == (removed[r.doc_id].kept_text if removed[r.doc_id].n_removed else text[r.doc_id]) and r.n_chars == len(r.text)

    packed = pipeline.packed(spark, cut, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with extra columns and every odd row there is."""
    path = str(tmp_path_factory.mktemp("tables"))
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lm", "rt", "n", "sk")]
    text = lambda k, n: " ".join(words[(7 * i * i + k * (i + 3) + k) % len(words)] for i in range(n))
    rows = [(k, text(k, 60), "en" if k % 2 else "de", "web", 1) for k in range(40)]
    rows += [rows[3], rows[3], (5, text(77, 60), "en", "x", None), (60, rows[8][1], "de", "copy", 1), (61, rows[9][1] + " tail", "en", "near", 1)]
    rows += [(70, None, "en", "web", 0), (71, "", None, None, None), (72, "12 !", "de", "web", 4), (73, text(5, 30000), None, "long", 9), (None, text(90, 50), "en", None, 1), (None, None, None, None, None)]
    rows += [(80, " ".join(f"own{i}" for i in range(30)) + " " + " ".join(rows[11][1].split()[:30]), "de", "part", 1)]
    docs = spark.createDataFrame([(*r, 1, "extra", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, g string, chunk double")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 0, 0) for k in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = materialize(pipeline.languages(spark, docs, folder), "t")
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {*range(40), 60, 61, 73, 80, None}
    assert {r.lang for r in kept.collect()} == {"en", "de"}
    clean = materialize(pipeline.not_toxic(spark, kept, folder), "t")
    assert clean.count() == kept.count() and clean.columns == COLUMNS
    single = materialize(pipeline.one_of_each(spark, clean, folder), "t")
    ids = Counter(r.doc_id for r in single.collect())
    assert set(ids.values()) == {1} and {3, 5, 8, 9, 73, None} <= set(ids) and not {60, 61} & set(ids)
    cut = {r.doc_id: r for r in materialize(pipeline.without_repeats(spark, single, folder), "t").collect()}
    assert set(cut) == set(ids) and len(cut[80].text.split()) == 30 and cut[80].n_chars == len(cut[80].text)


def test_run_on_odd_rows(spark, folder):
    """The pieces are the encodings of what the stages before kept."""
    out = P.run(spark, folder).collect()
    assert 3 in {r.doc_id for r in out} and Counter((r.doc_id, r.piece) for r in out).most_common(1)[0][1] == 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "t")
    e = bpe.encoder_of(bpe.file_content(bpe.default_vocabulary()))
    ids = {r.doc_id: e.encode((r.text or "").encode()) + (1).to_bytes(4, "little") for r in docs.collect()}
    assert set(ids) == {r.doc_id for r in out}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run(spark, sf_dir):
    assert [name for name, _ in P.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(P.run(spark, sf_dir).columns)

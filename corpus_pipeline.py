"""Corpus pipeline: from raw documents to packed token sequences.

The stages are those of srcatlas.llm.pipeline; each works on everything its predecessor
kept, which lies in the shared folder as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcatlas.llm import pipeline
from srcatlas.llm._store import materialize, table

STAGES = [
    ("language ID", pipeline.languages),
    ("toxicity", pipeline.not_toxic),
    ("n-gram Jaccard join", pipeline.one_of_each),
    ("substring dedup", pipeline.without_repeats),
    ("best-fit packing", pipeline.packed),
]

#: SQL can't express the models of the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a folder that pass all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs

"""The stages of the corpus pipeline: from raw documents to packed token sequences.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage works on everything its predecessor kept. Columns of docs
beyond those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm import bpe, jaccard, langid, packing, substring, toxicity
from srcatlas.llm._store import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null texts and those without a letter; all of them, if no row has both a language and a letter.

    A null language becomes the one found; others stay. Repeated rows and null ids are
    judged each by its text. An empty table gives an empty result.
    """
    found = langid.identify(docs.select(*COLUMNS), carry=COLUMNS)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic, by labels of the table labels.

    A null or empty text, a null id and repeated rows are judged each by its text; without
    labels nothing is rejected. An empty table gives an empty result.
    """
    found = toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=COLUMNS)
    return found.filter("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near duplicates.

    Of rows that repeat an id one stays, that of the least text (then language, source,
    number of characters). A row with a null id, which nothing can name, stays. A null text
    and one without words is a group of its own. An empty table gives an empty result.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard.near_duplicates(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias("__kept")).agg((F.count(F.lit(1)) > 1).alias("__again"))
    kept = materialize(kept, "kept-ids")
    # One plan at every size, instead of a broadcast of the ids only where they are few.
    rows = docs.join(kept.filter("not __again or __kept is null").hint("merge"), docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").select(*COLUMNS)
    again = kept.filter("__again and __kept is not null")
    if not again.head(1):
        return rows
    rest = [c for c in COLUMNS if c != "doc_id"]
    least = docs.join(again, docs["doc_id"] == again["__kept"], "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r"))
    return rows.unionByName(least.select("doc_id", *(F.col(f"r.{c}").alias(c) for c in rest)))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of texts that stand earlier, in the same or a document of a smaller id; a text without any stays as it is, layout included.

    No document goes: one that repeats others altogether keeps an empty text. A null text
    stays null. Rows that repeat an id don't count as earlier than each other. An empty
    table gives an empty result.
    """
    found = substring.dedup(docs, carry=("lang", "source"), layout=True)
    text = F.col("kept_text")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens, one row for each piece; see packing.pack.

    A null or empty text is its end token alone. Repeated rows and null ids are packed
    each. An empty table gives an empty result.
    """
    return packing.pack(docs, bpe.default_vocabulary())

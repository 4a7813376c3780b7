"""A corpus pipeline of five stages: language ID, near-duplicate removal, substring dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty one; other columns than those
of documents are left out; repeated rows are judged alike, so all stay or go; rows with a null
doc_id are judged by their text alone, and are no copies of others; texts are read whole.  Null
texts and texts without letters are rejected by language ID; given to a later stage, they have
no words, so it keeps them, and they have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.cluster import remove_folder, shared_folder, written
from palimpsest.llm import bpe, decontam, langid, partenum, queries, substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents; those that the model rejects go."""
    found = langid.identify(docs.select(*COLUMNS), langid.learn(docs))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link (five-word shingles, Jaccard 0.8 or more), that with the smallest doc_id stays; null ids stay."""
    groups = partenum.jaccard_components(docs, n=5, percent=80)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a smaller document has go; other texts stay as they are, and documents of which nothing is left go."""
    rows = substring.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = rows.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = decontam.contamination(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"))
    return rows.where("n_hit = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, *queries.tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL has no trained model; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages one after another, over all documents.

    folder: where the stages' tables go, in a store that all share (a new folder, if none is given).  A run that failed goes on
    after the last stage that was written there; a stage's table is removed when the next one is written."""
    folder = folder or shared_folder(spark, "pipeline")
    paths = [f"{folder}/{k}_{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k for k in range(len(STAGES) - 1) if written(spark, paths[k])), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[done + 1 : -1], done + 1):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        if k:
            remove_folder(spark, paths[k - 1])
        docs = spark.read.parquet(paths[k])
    return STAGES[-1][1](spark, docs, sf_dir)

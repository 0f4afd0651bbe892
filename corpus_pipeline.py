"""A training corpus from ``documents``: five stages, each one operator, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, minhash, packing, suffixes, toxicity
from tilewright.llm.common import read_table, shared_dir, with_row_key
from tilewright.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is in the upper half go, each row by its own text."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS[1:]).filter("not toxic").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest id; shingles of five words, similarity of 0.8 or more.

    Of rows with equal ids the first by text counts as the smaller, and null ids are the smallest.
    """
    rows = with_row_key(docs.select(*COLUMNS))
    kept = minhash.near_duplicates(rows, shingle=5, percent=80, id_col="_row").filter("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that have come before are cut from the texts; no document goes."""
    rows = with_row_key(docs.select(*COLUMNS))
    cut = suffixes.remove_repeats(rows, with_text=True, id_col="_row").select(F.col("doc_id").alias("_row"), "kept_text")
    out = rows.drop("text", "n_chars").join(cut, "_row")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text."""
    rows = with_row_key(docs.select(*COLUMNS))
    bad = decontaminate.hits(rows, read_table(spark, sf_dir, "benchmark"), id_col="_row").filter("contaminated").select(F.col("doc_id").alias("_row"))
    return rows.join(bad, "_row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("suffix-dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores, sketches and tokenizers have no SQL; tests/llm/test_pipeline_chain.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: five stages over the documents table.

A stage takes documents (doc_id, text, lang, source, n_chars; other columns are left out) and handles them as its operator
does: null and empty texts are no copies of others and hold no passage, so they reach the last stage, where each is a piece of
one end token. Texts of any length are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import NO_ID, let_go, load, saved, scratch_count
from docrecon.llm.decontaminate import decontaminate
from docrecon.llm.near_dup import near_dedup
from docrecon.llm.packing import pack
from docrecon.llm.substring import substring_dedup
from docrecon.llm.toxicity import fit, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The pipeline takes near copies from here on; the query op3_minhash has its own bound.
SIMILARITY = 0.8


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay, such without text too (their score is the rate of toxic labels, so they go
    only where most labels are toxic). Labels teach, but a document's own label doesn't decide. Rows that repeat are judged
    alike."""
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays. Rows that repeat doc_id and text are one document, of which one
    row stays; rows that repeat a doc_id with other texts stay or go together; such without doc_id stay."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    kept = near_dedup(docs, SIMILARITY).where("kept or doc_id is null").select(key.alias("key")).distinct()
    return docs.select(*COLUMNS, key.alias("key")).join(kept, "key").dropDuplicates(["key", "text"]).select(*COLUMNS)


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of a document with a smaller doc_id are cut out of later ones; a document of which nothing is left goes. Of rows
    with one doc_id none is earlier."""
    cut = substring_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.where("n_removed = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces with their places in sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]
#: Scores, similarity and packing aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage leaves in the scratch folder goes when the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), scratch_count()
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        let_go(spark, before)
    return docs

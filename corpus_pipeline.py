"""A training corpus out of documents: toxic and poor documents go, then repeated lines, then near copies; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.jaccard import keep_one_of_each_group
from skyledger.llm.lines import dedup_lines
from skyledger.llm.packing import pack_documents
from skyledger.llm.quality import fit_quality, score_quality
from skyledger.llm.queries import GOOD_FROM, TOKENIZER, TOXIC_FROM, held_out, table, vocabulary
from skyledger.llm.scratch import Scratch
from skyledger.llm.toxicity import fit_toxicity, score_toxicity


def _free(docs: DataFrame, name: str) -> str:
    """name, with underscores so that it is no column of docs."""
    while name in docs.columns:
        name = "_" + name
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as toxic. Null and empty texts score like a text without words; repeated rows score alike; other columns stay."""
    scratch, score = Scratch(spark, "toxicity"), _free(docs, "score")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()), scratch)
    scratch.clear()
    return score_toxicity(docs, model, out=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as poor. Null and empty texts score like a text without words; repeated rows score alike; other columns stay."""
    scratch, score = Scratch(spark, "quality"), _free(docs, "score")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()), scratch)
    scratch.clear()
    return score_quality(docs, model, out=score).where(F.col(score) >= GOOD_FROM).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that come after a similar one; a document goes only if no word is left. n_chars follows the text.

    The order is that of doc_id, null keys last, then of the line; rows that repeat a doc_id and a text lose the same lines.
    Null and empty texts, which have no line with a word, stay as they are.
    """
    kept = dedup_lines(docs, Scratch(spark, "lines"), min_words=1, drop_share=1.0)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, 0.8): that of the least doc_id, null keys last.

    Rows are grouped by their texts, whatever their keys. Null and blank texts are in no group and all stay.
    """
    return keep_one_of_each_group(docs, Scratch(spark, "copies")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place. A null text is empty: its piece is the end id alone.

    Repeated rows and null keys are packed row by row. An empty table gives none.
    """
    return pack_documents(docs, Scratch(spark, "packing"), vocabulary(TOKENIZER))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("packing", packing)]
#: Learned scores and a tokenizer are not SQL. A test holds the first four stages to plain Python on a small table with null and repeated keys; of
#: packing it counts documents, and of run() rows (pack_documents has a test of its own).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents, each one's result written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents through five training-data operators, each stage written and read again.

Cases, stage by stage: null and empty texts get the labels' share of good rows as their score, are one empty line, near
duplicates of nothing, take nothing from the mix and so leave it; of rows that are equal, or near duplicates, one stays; a null
doc_id is like any other, last in order; ties go to the first row of a stage's input; other columns, whatever their names, pass through all
stages but the last; without enough labels no document is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm.bpe import encode_rows, vocabulary
from symloom.llm.common import materialize, table
from symloom.llm.line_dedup import without_lines
from symloom.llm.minhash_dedup import keep_one
from symloom.llm.mixing import mix
from symloom.llm.quality_classifier import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents have."""
    return without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded, the text of the ids."""
    return encode_rows(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("bpe", tokens),
]

#: No SQL expresses the classifier, the register sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs

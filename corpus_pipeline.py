"""A training corpus from ``documents``: quality rules, near-duplicate and
substring removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. Stages are written as Parquet and reread.

Edge cases hold as each operator states them: null texts fail the quality
rules, rows repeated exactly collapse at near-duplicate removal, an empty
table passes through every stage, and extra columns are kept unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import packing, quality, secrets, simhash, suffix_dedup
from quire.llm.common import materialise
from quire.llm.queries import documents, tokenizer_file


#: a passage of 51 words has about 300 bytes; shorter strings than this are not removed
REPEAT_BYTES = 200


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text it describes."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many
    of their host share."""
    return _counted(quality.drop_rejected(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (4-word shingles, 4 bits)."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEAT_BYTES`` bytes that occur twice or more."""
    return _counted(suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with findings replaced by a mark."""
    return _counted(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither SimHash nor the tokenizer; tests/llm/test_pipeline.py compares all stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

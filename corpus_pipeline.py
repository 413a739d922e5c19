"""The corpus pipeline: quality, near-duplicates, contamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of ``documents``.

- quality: documents that the ordinal classifier does not rate good go.
- simhash: of each group of near-duplicates the smallest doc_id stays.
- decontamination: documents that hold a whole window of 13 words of the benchmark
  go, however long they are, as do those with a twentieth of their words in shorter items.
- secrets: secrets are masked in the text and n_chars is set anew; no document goes.
- packing: the texts as token pieces with their place in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvaya.llm import decontaminate, packing, quality, secrets, simhash
from anvaya.llm.common import stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows-only: scores of a fitted model cannot be stated in SQL.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality rules -> line deduplication -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE.  The first four return
documents in their own columns; the last returns each document's tokens.  An empty table passes through; what a stage
does with nulls, empty texts and repeated rows is said in its operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemeter
from tidemeter.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from tidemeter.llm.memo import small_batches
from tidemeter.session import checkpoint_dir

# Ship the package's functions by value: workers need not have it installed.
cloudpickle.register_pickle_by_value(tidemeter)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of 50 words or more, not mostly repeated, whose probability of being good, from all rules' votes, is at least one half."""
    small_batches(spark)
    return quality.kept_documents(docs, base=True)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that are at most two edits from an earlier one, and without what has no line of its own left; ``n_chars`` follows the text."""
    small_batches(spark)
    return _recounted(line_dedup.without_repeated_lines(docs, drop_emptied=True))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by five-word shingles at a similarity of 0.8 or more, the one of smallest id."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs, size=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages of ten words or more, and without documents that are mostly such passages."""
    small_batches(spark)
    return _recounted(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the ids and of their decoding."""
    small_batches(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True, keep=("lang", "source"))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: No SQL: expectation-maximisation, edit distances and BPE merges are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs

"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows that the stage before kept and returns the columns of ``documents``, but for the last
one, which returns the token ids in place of the text. SQL cannot express the classifier's fit, XXH64 or the
encoding, so ``ORACLE_SQL`` is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from samplery.llm import line_dedup, mixing, ordinal, pieces, simhash
from samplery.llm.common import materialize, scratched


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the table ``labels``, does not reject. Null texts stay."""
    return ordinal.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    return line_dedup.without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_near_duplicates(docs)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, in place of its text."""
    return pieces.encode(docs, pieces.PieceModel.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", sources),
    ("sentencepiece encoding", tokens),
]

ORACLE_SQL = None


def _written(stage: Callable[[SparkSession, DataFrame, str], DataFrame], name: str, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)


@scratched
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after another; a stage's tables go when its rows are written, and these when the run ends, but for those that the last stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-2]:
        docs = scratched(_written)(stage, name, spark, docs, sf_dir)
    (name, stage), (_, last) = STAGES[-2:]
    return last(spark, _written(stage, name, spark, docs, sf_dir), sf_dir)

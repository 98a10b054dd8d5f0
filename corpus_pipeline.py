"""A corpus pipeline of five stages over ``documents``: toxic documents go, one of each group of near
duplicates stays, documents with benchmark passages go, sources are mixed to their target weights, and the
rest is written as token ids. Each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pvgrid.llm.common import stage, table
from pvgrid.llm.decontaminate import drop_contaminated
from pvgrid.llm.mixing import take_mix
from pvgrid.llm.planes import token_digest
from pvgrid.llm.queries import TOKENIZER
from pvgrid.llm.simhash import drop_near_duplicates
from pvgrid.llm.toxicity import drop_toxic
from pvgrid.session import prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels teach, but are no input of a score."""
    return drop_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHashes of three-word shingles link at three differing bits or fewer."""
    prepare(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any full window of a benchmark item; items shorter than a window drop none."""
    return drop_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"), short_items=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from none to three times."""
    prepare(spark)
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, size and check sum of every document's ids, read from the files written."""
    prepare(spark)
    return token_digest(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("tokens", tokens)]

#: SQL can fit no field of probabilities and encode no tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

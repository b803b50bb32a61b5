"""A training-data pipeline: quality, near copies, test data, source weights, shards.

Each stage is (name, function); a function takes (spark, docs, sf_dir), docs being all that the stage before it
kept, and returns the rows that go on. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.balance import mix
from strandframe.llm.bytenet import score_quality
from strandframe.llm.common import stash, table
from strandframe.llm.decontaminate import decontaminate
from strandframe.llm.minhash import label_components
from strandframe.llm.ring import assign

SHARDS = 24
LEAST_QUALITY = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row as a struct, so that no name of it meets theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores below 0.3 go.

    Null and empty texts have the score of no evidence, repeated rows go or stay together, null labels and ids are no
    labels. Extra columns of any name pass through unread.
    """
    scored = score_quality(_packed(docs), table(spark, sf_dir, "labels"), ["__row"])
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, that of least doc_id stays.

    Null texts and texts without words have no links and stay. A null doc_id comes after all others; of rows with one
    doc_id one stays. Extra columns of any name pass through unread.
    """
    return label_components(_packed(docs).drop("source"), width=5).filter("first").select("__row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item, go.

    Null and empty texts stay, and so does everything if no item has words. Extra columns of any name pass through unread.
    """
    found = decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), ["__row"])
    return found.filter(F.size("spans") == 0).select("__row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies (0, 1 or 2) as bring their sources to the target weights.

    A null source is a source of its own; texts without words have no copies. Rows that are equal are
    counted each. Extra columns of any name pass through unread.
    """
    mixed = mix(_packed(docs), keep=["__row"]).filter("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, and replaces columns of these names; all others pass through. A null doc_id is a key like any other."""
    return assign(docs, F.col("doc_id"), SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs


#: A network's scores and a ring's walk have no SQL; tests compare with plain Python.
ORACLE_SQL = None

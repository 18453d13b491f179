"""The corpus pipeline: quality, exact duplicates, near duplicates, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
Null, empty and repeated rows are treated as the stages' operators say; an empty table
passes through every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clustercat.llm.common import filed, located, quoted
from clustercat.llm.exact_dedup import exact_groups
from clustercat.llm.mixing import mix, mixed_documents
from clustercat.llm.packing import pack
from clustercat.llm.quality import judge
from clustercat.llm.queries import table, word_vocabulary
from clustercat.llm.simhash import simhash_groups
from clustercat.storage import keep


def _only(docs: DataFrame, decisions: DataFrame, condition: str) -> DataFrame:
    """The rows of ``docs`` whose decision meets the condition.

    There are about as many decisions as rows, so the join is planned as a shuffle at any size.
    """
    chosen = keep(decisions.filter(condition).select("_cc_file", "_cc_row"), "chosen").hint("shuffle_merge")
    return located(docs).join(chosen, ["_cc_file", "_cc_row"], "left_semi").select(*quoted(docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = filed(docs)
    return _only(docs, judge(docs, table(spark, sf_dir, "labels")), "kept")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    docs = filed(docs)
    return _only(docs, exact_groups(docs), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    docs = filed(docs)
    return _only(docs, simhash_groups(docs, width=3, distance=3), "survivor")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the source mix plays: a row for each round in which a document is played."""
    docs = filed(docs)
    _, schedule = mix(docs)
    return mixed_documents(docs, keep(schedule, "schedule"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in the training sequences."""
    # Workers still hold what earlier stages remember, so this one remembers less.
    return pack(docs, word_vocabulary(), capacity=2048, remembered=400_000).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mix", mixing),
    ("best-fit packing", packing),
]

# The stages are a fitted model, hashes and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

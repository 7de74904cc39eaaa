"""The corpus pipeline: quality rules, line dedup, near dedup, source mixing and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.llm import lines, mixing, packing, quality, simhash
from verbena.llm.common import read
from verbena.plans.materialise import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects by their ledger bits go, the bit of the terms of abuse learned from the table labels among them.

    A null, empty or blank text is rejected as empty; a text is not rejected for its length; repeated rows and rows of one or of no doc_id are
    judged each by its text; an empty table stays empty; all columns are carried, whatever their names. Without ``sf_dir`` no terms are learned.
    """
    terms = quality.abuse_terms(docs, read(spark, sf_dir, "labels")) if sf_dir else []
    return quality.apply_policy(docs, terms=terms)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from all of them, where a group of near copies counts as one document; ``n_chars`` follows the text.

    So a copied document keeps its lines until the next stage decides which copy stays. A null text stays null and an empty one empty; a
    document that loses every line stays with an empty text; rows of one doc_id, or of none, count as one document; every row stays;
    further columns are carried, whatever their names; a text of any length takes time linear in its lines.
    """
    kept = lines.drop_common_lines(docs, near_copies=True)
    return kept.withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, with all its columns.

    Equal texts without words (null and empty ones are equal) are copies of each other; rows without a doc_id are kept; of rows that repeat
    doc_id and text one stays, different texts of one doc_id all do; a tie is for the least doc_id; an empty table stays empty.
    """
    return simhash.dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; documents of sources below their weight come several times.

    A null source is a source; rows of one (doc_id, source), a null doc_id among them, come together; null and empty texts have no tokens and
    come with the block where they fall; ties of the shuffle are for the least doc_id; an empty table stays empty; all columns are carried.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences.

    A null or empty text has one row without a sequence; repeated rows are packed as further copies; a text longer than a sequence is cut
    into full pieces and a rest; equal sizes are ranked by doc_id; an empty table gives no rows; further columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Packing is a sequence of dependent sweeps and near dedup a search; neither has SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is a table in the shared folder, read by the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

"""Documents cleaned, deduplicated and packed for training, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. The
filters return the columns of documents unchanged, whatever they are called; the last stage
returns pieces.

Null and empty texts are scored and packed like any other; all texts without a word are near
duplicates of each other, as equal texts are. Of near duplicates the smallest doc_id stays, a
null one only where there is no other; of repeated rows one stays. Texts of any length are read
whole. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import packing, quality, simhash, toxicity
from reelgrid.llm.rows import free_name, stored, table


def _names(docs: DataFrame) -> dict[str, str]:
    """Names for a score and its prediction that no column of ``docs`` has."""
    return {"name": free_name(docs, "score"), "predicted": free_name(docs, "predicted")}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; documents it calls toxic (0.5 or more) go."""
    network = toxicity.toxicity_model(spark, docs, sf_dir)
    own = _names(docs)
    scored = toxicity.score(docs, network, **own)
    return scored.where(F.col(own["name"]) < 0.5).drop(*own.values())


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; documents it scores below 0.5 go."""
    machine = quality.quality_model(spark, docs, sf_dir)
    own = _names(docs)
    scored = quality.score(docs, machine, metadata=("n_chars",), **own)
    return scored.where(F.col(own["name"]) >= 0.5).drop(*own.values())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; of each group of near-duplicates the document of the smallest id stays."""
    return simhash.first_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; pieces of packed sequences with the digest of their ids."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_copies),
          ("packing", pack)]

ORACLE_SQL = None  # trained models and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

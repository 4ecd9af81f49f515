"""The corpus pipeline: documents that are of quality and not toxic, one of each group of near copies, mixed and packed.

Defined results of every stage: a null text counts as the empty one (and is judged by its statistics); a null doc_id is
never labelled, is the last to be kept of its near copies, and packs like any other; very long texts are read whole; rows
equal in everything are judged alike, and of them near_copies keeps one; labels that miss or contradict are settled as
the operators say; an empty table gives an empty one; other columns, whatever their names, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import mixing, neardup, packing, quality, toxicity
from kinelake.llm.common import documents, fresh, id_crc, labels, stored

#: What is left holds little of the labelled table's other domains; the mix brings that down further, and never up.
TARGETS = {"good": 0.985, "poor": 0.01, "toxic": 0.005}
REMOVED = ("poor", "toxic")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; without labels of both kinds, all or none by the labels' share."""
    known = labels(spark, sf_dir).where(id_crc("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    at = fresh("_quality", docs)
    return quality.score_quality(docs, quality.train(docs, known), at).where(F.col(at) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5; without labels, all of them."""
    known = labels(spark, sf_dir).where(id_crc("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    at = fresh("_toxicity", docs)
    return toxicity.score_toxicity(docs, toxicity.train(docs, known), at).where(F.col(at) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each near-duplicate class; ties are rows equal in text and id, of which one stays."""
    return neardup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; what a document's domains are is learnt from the whole table's labels."""
    return mixing.resample(docs, mixing.quality_domains(labels(spark, sf_dir)), TARGETS, documents(spark, sf_dir), REMOVED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.pack(docs, packing.token_count(F.col("text")))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and sketches are not to be had in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

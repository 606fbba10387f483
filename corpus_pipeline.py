"""Corpus preparation as stages over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marram.llm import langid, packing, privacy, quality, simhash
from marram.session import forget, materialize, recorded, settings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows and bytes that go to a Python worker at a time: documents are long, and a worker holds a batch several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def batched(stage: Stage) -> Stage:
    """The stage with BATCHES set, which stay set: its result is lazy and runs when the caller stores it. ``run`` restores them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_rules", batched(quality.stage_quality)),
    ("language_id", batched(langid.stage_language)),
    ("near_duplicates", batched(simhash.stage_near_duplicates)),
    ("personal_data", batched(privacy.stage_privacy)),
    ("packing", batched(packing.stage_packing)),
]

#: Language scores and subword packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read by the next.

    The returned table is stored too and reads nothing else: what led to it is
    deleted as soon as the next stage's result is stored, and the session's
    settings are as before. Runs share nothing, so that several may stand side
    by side. Null, empty and repeated texts fare as each stage says, equal
    documents by their ids; an empty table gives no rows.
    """
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    with settings(spark, BATCHES):
        for name, stage in STAGES:
            with recorded() as paths:
                docs = materialize(stage(spark, docs, sf_dir), name)
            forget(spark, [*stored, *paths[:-1]])
            stored = paths[-1:]  # the stage's own result, which is written last
    return docs

"""A corpus pipeline: documents lose what is toxic, of no known language, a near copy or holds a benchmark; the rest is mixed.

Every stage works on all its predecessor kept, written as Parquet and read again.  Stages but the last
return the columns of documents; the last returns the reading plan of the mix (see mixing.mix): with
the default budget every kept document is read at least once.  As the predecessor's documents are stored
when a stage begins, it first takes the predecessors' models off the executors.

Defined results: null and empty texts are not toxic, of no known language and so not kept from then on; copies and
repeated rows become one document in the near-duplicate stage, of equal ones the first by id (nulls last); an
empty table gives an empty plan; extra columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import decontaminate, language, mixing, simhash, toxicity
from skylattice.llm.common import release, shared_folder, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return language.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return simhash.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return mixing.mix(docs)


STAGES = [("toxicity", toxicity_filter), ("language_id", language_filter), ("simhash_near_dedup", near_dedup), ("decontamination", benchmark_filter), ("mixing", source_mix)]

#: Model scoring, fingerprints and tilings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = _stored(spark, docs, name)
    return docs


def _stored(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder that the session names, and read again."""
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
    docs.write.parquet(path)
    return spark.read.parquet(path)

"""Catalogues of chunks as one table, with a commit: a snapshot, then a line in the manifest, then the inputs go.

Readers follow the manifest's newest line, so they see all of a consolidation or nothing of it.  A run that dies
before the line leaves a snapshot that nobody reads; one that dies after it leaves inputs, whose rows are taken in
place of those that came from the same path before when it is run again.  So nothing is lost and nothing doubled.
One run at a time may write a table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogues import union_by_name

MANIFEST = "version long, snapshot string, inputs array<string>"
FROM = "from_path"


def _newest(spark: SparkSession, path: str):
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version"), "snapshot").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def consolidated(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its last commit left it, with the path that each row came from; None before the first."""
    last = _newest(spark, path)
    return spark.read.parquet(f"{path}/{last.snapshot}") if last else None


def _there(spark: SparkSession, path: str):
    """(Hadoop path, its file system), or None where there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (at, files) if files.exists(at) else None


def remove(spark: SparkSession, path: str) -> None:
    if found := _there(spark, path):
        found[1].delete(found[0], True)


def consolidate(spark: SparkSession, inputs: list[str], path: str, delete: bool = True) -> DataFrame | None:
    """The Parquet folders of chunks joined to the table at `path`; a column that a part lacks is NULL there.

    Inputs that aren't there (any more) add nothing, and without any the table stays as it is.
    """
    own = [p.rstrip("/") for p in dict.fromkeys(inputs) if _there(spark, p)]
    last = _newest(spark, path)
    if own:
        parts = [spark.read.parquet(p).withColumn(FROM, F.lit(p)) for p in own]
        if last:
            parts.insert(0, spark.read.parquet(f"{path}/{last.snapshot}").where(~F.col(FROM).isin(own)))
        snapshot = f"snapshots/{uuid.uuid4().hex}"
        union_by_name(*parts).write.parquet(f"{path}/{snapshot}")
        line = spark.createDataFrame([((last.version if last else 0) + 1, snapshot, own)], MANIFEST)
        line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        if delete:
            for p in own:
                remove(spark, p)
    return consolidated(spark, path)

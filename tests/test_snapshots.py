"""Consolidation of chunk catalogues that may die between its steps."""

import pytest
from pyspark.sql import functions as F

from skylattice.sources import snapshots as S


def chunk(spark, folder, k, more=False):
    df = spark.range(3).select((F.col("id") + 10 * k).alias("id"), F.lit(f"s{k}").alias("srcname"))
    (df.withColumn("snr", F.lit(1.0 * k)) if more else df).write.mode("overwrite").parquet(str(folder / f"chunk{k}"))
    return str(folder / f"chunk{k}")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_chunks_become_one_table_and_go(spark, tmp_path):
    table = str(tmp_path / "all")
    assert S.consolidated(spark, table) is None and S.consolidate(spark, [str(tmp_path / "none")], table) is None
    got = S.consolidate(spark, [chunk(spark, tmp_path, 0), chunk(spark, tmp_path, 1, True)], table)
    assert ids(got) == [0, 1, 2, 10, 11, 12] and got.where("snr is null").count() == 3
    assert not (tmp_path / "chunk0").exists() and not (tmp_path / "chunk1").exists()
    assert ids(S.consolidate(spark, [chunk(spark, tmp_path, 2), str(tmp_path / "chunk0")], table)) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    assert ids(S.consolidate(spark, [], table)) == ids(S.consolidated(spark, table))


def test_a_run_that_dies_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    table, first = str(tmp_path / "all"), chunk(spark, tmp_path, 0)
    S.consolidate(spark, [first], table, delete=False)
    second = chunk(spark, tmp_path, 1)

    def dies(*_):
        raise RuntimeError("here")

    with monkeypatch.context() as m:  # after the line of the manifest, before the inputs go
        m.setattr(S, "remove", dies)
        with pytest.raises(RuntimeError):
            S.consolidate(spark, [first, second], table)
    assert ids(S.consolidated(spark, table)) == [0, 1, 2, 10, 11, 12] and (tmp_path / "chunk1").exists()
    with monkeypatch.context() as m:  # before the line: readers stay with what was
        m.setattr(S, "MANIFEST", "version long, snapshot string, inputs array<long>")
        with pytest.raises(Exception):
            S.consolidate(spark, [chunk(spark, tmp_path, 5)], table)
    assert ids(S.consolidated(spark, table)) == [0, 1, 2, 10, 11, 12]
    assert ids(S.consolidate(spark, [first, second, str(tmp_path / "chunk5")], table)) == [0, 1, 2, 10, 11, 12, 50, 51, 52]
    assert not (tmp_path / "chunk1").exists() and not (tmp_path / "chunk5").exists()

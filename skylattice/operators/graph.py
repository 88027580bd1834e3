"""Connected components, and joins that deal a hot key to many tasks.

A salt spreads the rows of one key; minima and what a key is joined with travel once for each salt that
is there, so no task gathers a key whole, however many rows it has.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 128


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, only a local master gets one of its own."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    return shared.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder: lineage is cut, and later steps don't repeat it."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def salted(df: DataFrame, name: str, salts: int = SALTS) -> DataFrame:
    """The rows with a salt in turn, settled, so that every later use sees the same salts."""
    return settled(df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))


def joined_evenly(rows: DataFrame, table: DataFrame, keys: list[str], salt: str, how: str = "inner") -> DataFrame:
    """rows (with a salt) joined to table (one row a key): a key's row travels once for each salt of its rows."""
    spread = rows.select(*keys, salt).distinct().join(table, keys)
    return rows.join(spread, [*keys, salt], how)


def _least(edges: DataFrame, low: Column) -> DataFrame:
    """(u, salt, m): the least neighbour of u, for each salt of its edges (u, v, salt)."""
    part = edges.groupBy("u", "salt").agg(F.min("v").alias("v"))
    whole = part.groupBy("u").agg(F.min("v").alias("v"), F.collect_set("salt").alias("salts"))
    return whole.select("u", low.alias("m"), F.explode("salts").alias("salt"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v)."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got)
        place, names = pd.factorize(pd.concat([rows.column(c).to_pandas() for c in ("u", "v")]), sort=True)
        u, v, label = place[: len(rows)], place[len(rows) :], np.arange(len(names))
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            np.minimum.at(new, label, new)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        kind = rows.schema.field("u").type
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names.take(label), kind)], names=["node", "component"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Up to `few` distinct edges are followed by one task, which holds them all; more than that, in rounds.

    Alternating large-star and small-star steps: nodes hang on ever smaller neighbours until each
    component is one star.  Every round is settled, so a lost executor costs one round.  Null ends and
    loops are ignored.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = settled(e.where("x is not null and y is not null and x <> y").select("u", "v").distinct())
    seen = state(e)
    if seen[0] <= few:
        return settled(_in_one_task(e))
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).select("u", "v", salt)
        least = _least(both, F.least("v", "u"))
        large = settled(both.where("v > u").join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        own = large.select("u", "v", salt)
        least = _least(own, F.col("v"))
        small = own.join(least, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    # The last round left stars: every u hangs on its root v.
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

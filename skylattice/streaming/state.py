"""Structured Streaming forms of what the search carries from chunk to chunk."""

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.robust import finite
from ..operators.graph import shared_folder


def events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events as a stream of files; a stream reads a folder, never one file."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def windows(df: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums of tumbling or hopping windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = df.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "n", "total")


def dedupe(df: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Duplicates that overlapping chunks make go while the watermark allows."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def welford(df: DataFrame, key: str = "user_id", tau: float | None = None) -> DataFrame:
    """Running (key, n, mean, m2) of finite values; with tau, of what an exponential mean in event time leaves.

    Counts and moments are aggregates that the engine keeps as state; only the exponential mean, which
    depends on the order of events, needs a state of its own.
    """
    if tau is None:
        v = finite(F.col("value"))
        return df.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        n, mean, m2, ema, last = state.get if state.exists else (0, 0.0, 0.0, math.nan, math.nan)
        for part in parts:
            for at, x in part.sort_values("at")[["at", "value"]].itertuples(index=False):
                if not math.isfinite(x):
                    continue
                a = 0.0 if math.isnan(last) else 1 - math.exp(-max(0.0, at - last) / tau)
                ema = x if math.isnan(ema) else (1 - a) * ema + a * x
                last, x = at, x - ema
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
        state.update((n, mean, m2, ema, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "m2": [m2]})

    src = df.select(key, F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), "value").withColumn("at", F.col("at") / 1e6)
    return src.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, mean double, m2 double", "n long, mean double, m2 double, ema double, last double", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything available now, written batch by batch to the shared folder and read again; a batch that is run again replaces itself."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.writeStream.foreachBatch(lambda part, k: part.write.mode("overwrite").parquet(f"{at}/out/batch={k}")).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(df.schema).parquet(f"{at}/out")
    except AnalysisException as e:  # no batch had come
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], df.schema)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedMoments(StatefulProcessor):
    """Welford moments of what an exponential mean in event time leaves, events of a key taken in the order of their time.

    Events wait until the watermark has passed them, whatever order they come in; a timer takes those that
    are due, sorted by time and value.  A key that has had no event for `idle_ms` gives its last row, `closed`, and its
    state is dropped, so the state is that of keys seen within the watermark's delay and the idle time.
    Events that come after later ones of their key were taken are left out, as are those that the engine drops for the watermark.
    """

    def __init__(self, key: str, tau: float, idle_ms: int):
        self.key, self.tau, self.idle_ms = key, tau, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double, ema double, last long")
        self.waiting = handle.getListState("waiting", "at long, value double")

    def handleInputRows(self, key, rows, timerValues):
        newest = None
        for part in rows:
            self.waiting.appendList(list(zip(part["at"].astype("int64").tolist(), part["value"].astype("float64").tolist(), strict=True)))
            newest = max(int(part["at"].max()), newest or 0)
        if newest is not None:
            self.handle.registerTimer(newest)
            self.handle.registerTimer(newest + self.idle_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get())
        if not waiting and not self.moments.exists():  # a timer of a key that is closed
            yield pd.DataFrame()
            return
        due = [x for x in waiting if x[0] <= now]
        rest = waiting[len(due) :]
        n, mean, m2, ema, last = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, math.nan, -1)
        for at, x in due:
            if not math.isfinite(x) or at < last:
                continue
            a = 0.0 if last < 0 else 1 - math.exp(-(at - last) / 1000 / self.tau)
            ema = x if math.isnan(ema) else (1 - a) * ema + a * x
            last, x, n = at, x - ema, n + 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
        closed = not rest and now >= last + self.idle_ms
        if closed:
            self.moments.clear()
            self.waiting.clear()
        elif due:
            self.moments.update((n, mean, m2, ema, last))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "mean": [mean], "m2": [m2], "last": [last], "closed": [closed]} if due or closed else {})

    def close(self) -> None:
        pass


def ordered_welford(df: DataFrame, key: str = "user_id", tau: float = 30.0, late: str = "10 seconds", idle: float = 3600.0) -> DataFrame:
    """Running (key, n, mean, m2, last, closed) in event order, a row whenever events of a key become due; needs the state store STATE_STORE."""
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at")
    src = df.withWatermark("ts", late).select(key, "ts", at, F.col("value").cast("double").alias("value"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n long, mean double, m2 double, last long, closed boolean"
    return src.groupBy(key).transformWithStateInPandas(OrderedMoments(key, tau, int(idle * 1000)), schema, "Append", "EventTime")

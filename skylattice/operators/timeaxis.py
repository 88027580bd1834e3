"""Time axis: distinct times, cadence, scans, chunks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_column(df: DataFrame) -> str:
    """time_centroid where the table has it, else time."""
    found = next((c for c in ("time_centroid", "time") if c in df.columns), None)
    if found is None:
        raise ValueError("neither time_centroid nor time")
    return found


def distinct_times(df: DataFrame, time: str | None = None, scan: str | None = "scan") -> DataFrame:
    """(time, scan) in order; scan 0 if there is no such column.  A time in two scans gives two rows."""
    time = time or time_column(df)
    has = scan is not None and scan in df.columns
    return df.select(F.col(time).alias("time"), (F.col(scan) if has else F.lit(0)).alias("scan")).distinct().orderBy("time", "scan")


def _gaps(axis: DataFrame, time: str) -> DataFrame:
    # The axis is one row a timestamp, far smaller than the data behind it.
    return axis.select(time).distinct().select((F.col(time) - F.lag(time).over(Window.orderBy(time))).alias("gap"))


def cadence(axis: DataFrame, time: str = "time") -> DataFrame:
    """One row: the median step, 1.0 if there is none."""
    return _gaps(axis, time).agg(F.coalesce(F.median("gap").cast("double"), F.lit(1.0)).alias("cadence"))


def time_bin(df: DataFrame, time: str | None = None, rows: int = 10_000) -> DataFrame:
    """One row: the median `interval` of the first rows where the table has that column and a usable value, else the median step of its times."""
    time = time or time_column(df)
    steps = cadence(df.select(time), time)
    if "interval" not in df.columns:
        return steps
    some = df.select("interval").limit(rows).where("interval > 0").agg(F.median("interval").cast("double").alias("interval"))
    return some.join(F.broadcast(steps)).select(F.coalesce("interval", "cadence").alias("cadence"))  # one row each


def assert_uniform(axis: DataFrame, time: str = "time", tolerance: float = 1e-2) -> DataFrame:
    """The axis; running it raises where steps differ by more than the tolerance."""
    said = is_uniform(axis, time, tolerance).select(F.assert_true("uniform", F.lit("the time axis is not uniform")).alias("ok"))
    return axis.join(F.broadcast(said), F.col("ok").isNull()).drop("ok")


def scan_count(df: DataFrame, scan: str = "scan") -> DataFrame:
    """One row: how many different scans."""
    return df.agg(F.count_distinct(scan).alias("scans"))


def is_uniform(axis: DataFrame, time: str = "time", tolerance: float = 1e-2) -> DataFrame:
    """One row: the first step, and whether all steps are within tolerance of it."""
    g = _gaps(axis, time)
    return g.agg(F.min("gap").cast("double").alias("least"), F.max("gap").cast("double").alias("most"), F.coalesce(F.max("gap") - F.min("gap") <= tolerance, F.lit(True)).alias("uniform"))


def scan_islands(axis: DataFrame, time: str = "time", scan: str = "scan") -> DataFrame:
    """Runs of one scan along time: (island, scan, first, last, n)."""
    w = Window.orderBy(time)
    new = F.coalesce((F.col(scan) != F.lag(scan).over(w)).cast("long"), F.lit(0))
    runs = axis.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("island").agg(F.first(scan).alias("scan"), F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))


def chunks(axis: DataFrame, size: int, overlap: int = 0, time: str = "time", scan: str | list[str] = "scan") -> DataFrame:
    """(scan, chunk, time): windows of size + overlap times, size apart, never over a scan's end; scan is a column or several."""
    scan = [scan] if isinstance(scan, str) else list(scan)
    w = Window.partitionBy(*scan)
    idx = axis.withColumn("i", F.row_number().over(w.orderBy(time)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    last = F.floor(F.col("i") / size)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (size + overlap - 1)) / size))
    # The first chunk that reaches the scan's end is the last.
    got = idx.select(*scan, time, "n", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk"))
    return got.where((F.col("chunk") == 0) | (F.col("chunk") * size + overlap < F.col("n"))).drop("n")


def chunk_bounds(axis: DataFrame, size: int, overlap: int = 0, time: str = "time", scan: str = "scan") -> DataFrame:
    return chunks(axis, size, overlap, time, scan).groupBy(scan, "chunk").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))


def dominant_scan(df: DataFrame, by: list[str], scan: str = "scan") -> DataFrame:
    """The most frequent non-zero scan of each group, the smallest on a tie, NULL if there is none."""
    return df.groupBy(*by).agg(F.mode(F.when(F.col(scan) != 0, F.col(scan)), True).alias("scan"))


def hopping(df: DataFrame, ts: str, size: str, slide: str | None = None) -> Column:
    return F.window(ts, size, slide) if slide else F.window(ts, size)

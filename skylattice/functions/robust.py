"""Robust spread.  NaN never takes part: filter it or use finite()."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def finite(c: Column) -> Column:
    """The value, or NULL if it is NaN or infinite, so that no comparison meets NaN."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def usable(sigma: Column) -> Column:
    """The spread, or 1 if there is none."""
    return F.when(sigma > 0, sigma).otherwise(F.lit(1.0))


def with_mad(df: DataFrame, value: str, by: list[str], name: str = "sigma") -> DataFrame:
    """Adds 1.4826 times the median absolute deviation of each row's group, 1 if there is none.

    Both medians are windows over the same groups: one shuffle, and no join back.
    """
    w = Window.partitionBy(*by)
    v = finite(F.col(value))
    return df.withColumn(name, F.median(v).over(w)).withColumn(name, usable(F.median(F.abs(v - F.col(name))).over(w) * MAD_TO_SIGMA))


def mad_sigma(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by..., sigma): 1.4826 times the median absolute deviation of each group, 1 if there is none."""
    v = df.select(*by, finite(F.col(value)).alias("v"))
    if by:
        both = v.withColumn("m", F.median("v").over(Window.partitionBy(*by)))
    else:
        both = v.join(F.broadcast(v.agg(F.median("v").alias("m"))))  # one row
    return both.groupBy(*by).agg(usable(F.median(F.abs(F.col("v") - F.col("m"))) * MAD_TO_SIGMA).alias("sigma"))


def with_clipped(df: DataFrame, value: str, by: list[str], clip: float = 3.0, rounds: int = 5, cumulative: bool = False, name: str = "sigma") -> DataFrame:
    """Adds the spread of each row's group by iterated clipping from the median and MAD.

    Without `cumulative` every round tests all values again and always takes the new spread; with it a
    round only tests what the last one kept, and ends as soon as it clips nothing.  Every round is a set of
    aggregates over the same groups, so rows are shuffled once.  A group is one image's pixels.
    """
    w = Window.partitionBy(*by)
    v, mu, s, done, kept, pool = (f"__{x}" for x in ("v", "mu", "s", "done", "kept", "pool"))
    got = df.withColumn(v, finite(F.col(value))).withColumn(mu, F.median(v).over(w))
    got = got.withColumn(s, F.coalesce(F.median(F.abs(F.col(v) - F.col(mu))).over(w) * MAD_TO_SIGMA, F.lit(0.0)))
    got = got.withColumns({done: F.col(s) <= 0, pool: F.col(v).isNotNull()})
    for _ in range(rounds):
        got = got.withColumn(kept, F.col(pool) & (F.abs(F.col(v) - F.col(mu)) <= F.lit(clip) * F.col(s)))
        own = F.when(F.col(kept), F.col(v))
        got = got.withColumns({"__n": F.count(own).over(w), "__of": F.count_if(F.col(pool)).over(w), "__mean": F.avg(own).over(w), "__dev": F.coalesce(F.stddev_samp(own).over(w), F.lit(0.0))})
        stop = F.col(done) | (F.col("__n") == 0)
        if cumulative:
            stop = stop | (F.col("__n") == F.col("__of"))
        got = got.withColumn(done, stop)
        keep = lambda new, old: F.when(F.col(done), F.col(old)).otherwise(F.col(new))
        got = got.withColumns({mu: keep("__mean", mu), s: keep("__dev", s), pool: keep(kept, pool) if cumulative else F.col(pool)})
        got = got.withColumn(done, F.col(done) | (F.col(s) <= 0))
    return got.withColumn(name, usable(F.col(s))).drop(v, mu, s, done, kept, pool, "__n", "__of", "__mean", "__dev")


def clipped_sigma(df: DataFrame, value: str, by: list[str], clip: float = 3.0, rounds: int = 5, cumulative: bool = False) -> DataFrame:
    """(by..., sigma) of each group, see with_clipped; groups without a finite value are left out."""
    got = with_clipped(df.select(*by, F.col(value).alias("value")).where(finite(F.col("value")).isNotNull()), "value", list(by), clip, rounds, cumulative)
    return got.groupBy(*by).agg(F.first("sigma").alias("sigma"))

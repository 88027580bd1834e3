"""The engine's inputs as views of the driver's tables, in Spark and (SQL) for the oracles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cube as C


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark, sf, *by) -> DataFrame:
    """Summed fluxes of the cells seen, apart for each value of the columns given."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    src = table(spark, sf, "lineitem").select(F.floor(days / 30).cast("long").alias("t"), (F.col("l_suppkey") % 10).alias("y"), (F.col("l_partkey") % 10).alias("x"), "l_quantity", *by)
    return src.groupBy(*(c for c in src.columns if c != "l_quantity")).agg(F.sum("l_quantity").alias("flux"))


def cube(spark, sf) -> DataFrame:
    return C.dense(obs(spark, sf))


def clean(spark, sf) -> DataFrame:
    return C.subtract_mean(C.dense(obs(spark, sf), empty=True))


def lc(spark, sf) -> DataFrame:
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    src = table(spark, sf, "events").select(hour.alias("t"), (F.expr("user_id div 10") % 10).alias("y"), (F.col("user_id") % 10).alias("x"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return src.groupBy("t", "y", "x").agg(F.sum("v").cast("double").alias("flux"))


def axis(spark, sf) -> DataFrame:
    """Distinct hours, a scan being three days."""
    us = "unix_micros(cast(ts as timestamp))"
    return table(spark, sf, "events").select(F.expr(f"{us} div 3600000000").alias("time"), F.expr(f"{us} div 259200000000").alias("scan")).distinct()


def det(spark, sf) -> DataFrame:
    k = F.col("user_id") % 20
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp))").alias("time"), F.date_format(F.col("ts"), "yyyyMMdd").alias("scan"), F.format_string("beam%02d", F.col("user_id") % 36).alias("beam"),
        F.col("value").alias("snr"), F.pow(F.lit(2.0), F.col("event_id") % 7).cast("long").alias("width"),
        (150 + (k % 5) * 0.05 + (F.col("event_id") % 3) * 0.001).alias("ra"), (-30 + F.floor(k / 5) * 0.05 + (F.col("event_id") % 2) * 0.001).alias("dec"),
    )


def vis(spark, sf) -> DataFrame:
    key = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        (key % 8).alias("t"), key.alias("row"), F.expr("l_linenumber div 2").alias("chan"), F.when(F.col("l_linenumber") % 2 == 0, "XX").otherwise("YY").alias("corr"), (key % 17 - 8).cast("double").alias("u"), (key % 13 - 6).cast("double").alias("v"),
        (F.col("l_extendedprice") / 131072.0).alias("re"), F.col("l_discount").alias("im"), (F.col("l_returnflag") == "R").alias("flag"), F.col("l_quantity").cast("double").alias("weight"),
    )


def suppliers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("PSR"), F.col("s_suppkey").cast("string")).alias("src_name"), (150 + (F.col("s_suppkey") % 5) * 0.05 + 0.002).alias("ra"), (-30 + F.floor((F.col("s_suppkey") % 10) / 5) * 0.05).alias("dec"))


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("RACS"), F.col("c_custkey").cast("string")).alias("src_name"), (150 + (F.col("c_custkey") % 5) * 0.05 + 0.001).alias("ra"), (-30 + F.floor((F.col("c_custkey") % 15) / 5) * 0.05 + 0.002).alias("dec"))


def power(spark, sf) -> DataFrame:
    src = table(spark, sf, "embeddings").select((F.expr("vec_id div 10")).alias("y"), (F.col("vec_id") % 10).alias("x"), F.posexplode("embedding").alias("k", "e"))
    return src.select("y", "x", F.col("k").cast("long").alias("k"), F.pow(F.round(F.col("e").cast("double") * 1000), F.lit(2.0)).alias("power"))


SQL = {
    "cube": """
obs as (select (date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 30)::bigint as t, l_suppkey % 10 as y, l_partkey % 10 as x, sum(l_quantity) as flux from lineitem group by all),
axis as (select unnest(generate_series((select min(t) from obs), (select max(t) from obs))) as t),
cube as (select t, y, x, coalesce(flux, 0)::double as flux from axis cross join (select distinct y, x from obs) left join obs using (t, y, x))""",
    "clean": """
clean as (select t, y, x, flux as raw, case when flux = 0 then 0 else flux - avg(flux) over (partition by y, x) end as flux from cube)""",
    "lc": """
lc as (select epoch_us(ts) // 3600000000 as t, user_id // 10 % 10 as y, user_id % 10 as x, sum(round(value * 100)::bigint)::double as flux from events group by all)""",
    "axis": """
axis as (select distinct epoch_us(ts) // 3600000000 as time, epoch_us(ts) // 259200000000 as scan from events)""",
    "det": """
det as (select event_id as id, epoch_us(ts) as time, strftime(ts, '%Y%m%d') as scan, 'beam' || lpad((user_id % 36)::varchar, 2, '0') as beam, value as snr, (2 ** (event_id % 7))::bigint as width,
  150 + (user_id % 20 % 5) * 0.05e0 + (event_id % 3) * 0.001e0 as ra, -30 + (user_id % 20 // 5) * 0.05e0 + (event_id % 2) * 0.001e0 as dec from events)""",
    "vis": """
vis as (select l_orderkey % 8 as t, l_orderkey as row, (l_linenumber // 2)::bigint as chan, case when l_linenumber % 2 = 0 then 'XX' else 'YY' end as corr, (l_orderkey % 17 - 8)::double as u, (l_orderkey % 13 - 6)::double as v,
  l_extendedprice / 131072.0e0 as re, l_discount as im, l_returnflag = 'R' as flag, l_quantity::double as weight from lineitem)""",
    "cats": """
psr as (select 'PSR' || s_suppkey as src_name, 150 + (s_suppkey % 5) * 0.05e0 + 0.002e0 as ra, -30 + (s_suppkey % 10 // 5) * 0.05e0 as dec from supplier),
racs as (select 'RACS' || c_custkey as src_name, 150 + (c_custkey % 5) * 0.05e0 + 0.001e0 as ra, -30 + (c_custkey % 15 // 5) * 0.05e0 + 0.002e0 as dec from customer)""",
    "power": """
power as (select vec_id // 10 as y, vec_id % 10 as x, (k - 1)::bigint as k, round(embedding[k]::double * 1000) ** 2 as power from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as k from embeddings))""",
    "sep": """2 * asin(sqrt(least(1, sin(radians(a.dec - b.dec) / 2) ** 2 + cos(radians(a.dec)) * cos(radians(b.dec)) * sin(radians(a.ra - b.ra) / 2) ** 2))) * 180 / pi() * 3600""",
}


def ctes(*names: str) -> str:
    return "with recursive " + ",".join(SQL[n] for n in names)

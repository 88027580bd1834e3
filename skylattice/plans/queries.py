"""Registered queries of the engine's own operators, each beside its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.robust import clipped_sigma, mad_sigma
from ..operators import catalogues as K
from ..operators import cube as C
from ..operators import greedy as G
from ..operators.graph import shared_folder
from ..operators.gridding import gridded_image, gridded_spectrum
from ..operators import imaging as I
from ..operators import periodicity as P
from ..operators import search as E
from ..operators import timeaxis as A
from ..sources import readers as R
from ..sources.fits import read_fits, write_fits
from ..streaming import state as S
from . import inputs as N
from .inputs import SQL, ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, as the oracles do."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# Scans and the time axis


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate <= timestamp '1996-03-31'")
def scan_range_pruned(spark, sf):
    return N.table(spark, sf, "lineitem").where("l_shipdate between timestamp_ntz '1996-01-01' and timestamp_ntz '1996-03-31'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select event_id, user_id from events")
def project_subset(spark, sf):
    return N.table(spark, sf, "events").select("event_id", "user_id")


@query(ctes("axis") + " select time, scan from axis")
def distinct_time_axis(spark, sf):
    return A.distinct_times(N.axis(spark, sf))


@query(ctes("axis") + " select coalesce(median(g)::double, 1) as cadence from (select time - lag(time) over (order by time) as g from (select distinct time from axis))")
def cadence_median(spark, sf):
    return A.cadence(N.axis(spark, sf))


@query(ctes("axis") + " select min(g)::double as least, max(g)::double as most, max(g) - min(g) <= 0.01 as uniform from (select time - lag(time) over (order by time) as g from (select distinct time from axis))")
def uniform_cadence(spark, sf):
    return A.is_uniform(N.axis(spark, sf))


@query(
    ctes("axis")
    + """ , m as (select *, coalesce((scan <> lag(scan) over (order by time))::bigint, 0) as new from axis), r as (select *, sum(new) over (order by time)::bigint as island from m)
select island, min(scan) as scan, min(time) as first, max(time) as last, count(*) as n from r group by island"""
)
def scan_islands(spark, sf):
    return A.scan_islands(N.axis(spark, sf))


def _chunks_sql(size: int, overlap: int) -> str:
    return ctes("axis") + f""" , i as (select *, row_number() over (partition by scan order by time) - 1 as i, count(*) over (partition by scan) as total from axis)
select scan, c as chunk, min(time) as first, max(time) as last, count(*) as n from i join (select unnest(generate_series(0, 200)) as c) on i.i between c * {size} and c * {size} + {size + overlap - 1}
where c = 0 or c * {size} + {overlap} < total group by scan, c"""


@query(_chunks_sql(10, 0))
def chunks_tumbling(spark, sf):
    return A.chunk_bounds(N.axis(spark, sf), 10)


@query(_chunks_sql(16, 5))
def chunks_hopping(spark, sf):
    return A.chunk_bounds(N.axis(spark, sf), 16, 5)


@query(
    """with c as (select user_id, event_id % 5 as scan, count(*) as n from events where event_id % 5 <> 0 group by all)
select u.user_id, c.scan from (select distinct user_id from events) u left join (select user_id, scan, row_number() over (partition by user_id order by n desc, scan) as k from c) c on u.user_id = c.user_id and c.k = 1"""
)
def dominant_scan(spark, sf):
    return A.dominant_scan(N.table(spark, sf, "events").select("user_id", (F.col("event_id") % 5).alias("scan")), ["user_id"])


# Visibilities and images


@query(ctes("vis") + " select row, chan, corr, round(case when flag then 0 else weight end, 6) as weight from vis")
def flag_weight(spark, sf):
    return r6(I.flag_weights(N.vis(spark, sf)).select("row", "chan", "corr", "weight"))


FLAGGED = ", fl as (select * replace (case when flag then 0 else weight end as weight) from vis)"
AVERAGED = FLAGGED + ", av as (select t, row, chan, u, v, coalesce(sum(weight * re) / nullif(sum(weight), 0), 0) as re, coalesce(sum(weight * im) / nullif(sum(weight), 0), 0) as im, sum(weight) as weight from fl group by all)"
NORMED = ", nv as (select * replace (case when max(weight) over (partition by t) > 0 then weight / max(weight) over (partition by t) else 0 end as weight) from av)"
STOKES = (
    FLAGGED
    + """, wide as (select t, row, chan, u, v, max(re) filter (corr = 'XX') as rx, max(re) filter (corr = 'YY') as ry, max(im) filter (corr = 'XX') as ix, max(im) filter (corr = 'YY') as iy,
  max(weight) filter (corr = 'XX') as wx, max(weight) filter (corr = 'YY') as wy from fl group by all)"""
)


@query(ctes("vis") + AVERAGED + " select t, row, chan, u, v, round(re, 9) as re, round(im, 9) as im, round(weight, 6) as weight from av")
def corr_average(spark, sf):
    av = I.average_correlations(I.flag_weights(N.vis(spark, sf)))
    return av.withColumns({"re": F.round("re", 9), "im": F.round("im", 9), "weight": F.round("weight", 6)})


@query(ctes("vis") + FLAGGED + " select t, row, chan, u, v, round(re, 6) as re, round(im, 6) as im, round(weight, 6) as weight from fl where corr = 'XX'")
def corr_single(spark, sf):
    return r6(I.single_correlation(I.flag_weights(N.vis(spark, sf)), "XX"))


@query(
    ctes("vis") + STOKES + """ select t, row, chan, u, v, round(coalesce((rx + ry) / 2, rx, ry), 6) as re, round(coalesce((ix + iy) / 2, ix, iy), 6) as im,
round(case when wx is null then wy when wy is null then wx when wx = 0 or wy = 0 then 0 else 4 / (1 / wx + 1 / wy) end, 6) as weight from wide"""
)
def stokes_i(spark, sf):
    return r6(I.stokes_i(I.flag_weights(N.vis(spark, sf))))


@query(ctes("vis") + AVERAGED + NORMED + " select t, row, chan, round(weight, 6) as weight from nv")
def weight_norm(spark, sf):
    return r6(I.normalise_weights(I.average_correlations(I.flag_weights(N.vis(spark, sf)))).select("t", "row", "chan", "weight"))


def _dft_sql(by: str, n: int = 8, cell: float = 0.01) -> str:
    return ctes("vis") + AVERAGED + NORMED + f""" , grid as (select y, x, (x - {(n - 1) / 2}e0) * {cell}e0 as l, (y - {(n - 1) / 2}e0) * {cell}e0 as m from (select unnest(generate_series(0, {n - 1})) as y) cross join (select unnest(generate_series(0, {n - 1})) as x))
select {by} y, x, round(sum(weight * (re * cos(2 * pi() * (u * l + v * m)) - im * sin(2 * pi() * (u * l + v * m)))) / count(*), 6) as flux from nv cross join grid where weight > 0 group by all"""


def _normed(spark, sf):
    return I.normalise_weights(I.average_correlations(I.flag_weights(N.vis(spark, sf))))


@query(_dft_sql("t,"))
def dirty_image_dft(spark, sf):
    return r6(I.dirty_image(_normed(spark, sf), 8, 0.01))


@query(_dft_sql(""))
def continuum_dft(spark, sf):
    return r6(I.dirty_image(_normed(spark, sf), 8, 0.01, []))


# Gridded images and spectra, as close to direct sums as their kernel can be made


@query(_dft_sql("t,", 32, 0.004))
def dirty_image_gridded(spark, sf):
    return r6(gridded_image(_normed(spark, sf), 32, 0.004, epsilon=1e-14))


# Visibilities as a table holds them: metres, numbers for correlations, channels and labels in tables of their own.
DECLARED = """spw as (select distinct (l_linenumber // 2)::bigint as chan, 9e8 + (l_linenumber // 2) * 1e6 as freq_hz from lineitem),
dv as (select l_orderkey % 2 as scan, l_orderkey % 8 // 2 as t, l_orderkey as row, (l_linenumber // 2)::bigint as chan, l_linenumber % 2 as corr, (l_orderkey % 17 - 8) * 1.5e0 as u_m, (l_orderkey % 13 - 6) * 1.5e0 as v_m, (l_orderkey % 11 - 5) * 9e0 as w_m,
  l_extendedprice / 131072.0e0 as re, l_discount as im, case when l_returnflag = 'R' then 0 else l_quantity::double end as weight from lineitem)"""
DECLARED_SQL = "with " + DECLARED + """, wl as (select dv.*, freq_hz / 299792458e0 as k from dv join spw using (chan)),
av as (select scan, t, row, chan, u_m * k as u, v_m * k as v, w_m * k as w, coalesce(sum(weight * re) / nullif(sum(weight), 0), 0) as re, coalesce(sum(weight * im) / nullif(sum(weight), 0), 0) as im, sum(weight) as weight from wl group by all),
nv as (select * replace (weight / max(weight) over (partition by scan, t) as weight) from av),
axis as (select i, (i - 3.5e0) * 0.02e0 as a from (select unnest(generate_series(0, 7)) as i)), grid as (select p.i as y, q.i as x, q.a as l, p.a as m, sqrt(1 - p.a * p.a - q.a * q.a) as n from axis p cross join axis q),
ph as (select scan, t, y, x, n, weight, re, im, 2 * pi() * (u * l + v * m - w * (n - 1)) as phase from nv cross join grid where weight > 0)"""


def _declared(spark, sf):
    """(rows of the layout that readers.visibilities gives, spw, pol)."""
    key, line = F.col("l_orderkey"), N.table(spark, sf, "lineitem")
    rows = line.select(
        (key % 2).alias("scan"), F.expr("l_orderkey % 8 div 2").alias("t"), F.expr("l_orderkey % 8 div 2").cast("double").alias("time"), key.alias("row"), F.expr("l_linenumber div 2").alias("chan"), (F.col("l_linenumber") % 2).alias("corr"),
        ((key % 17 - 8) * 1.5).alias("u"), ((key % 13 - 6) * 1.5).alias("v"), ((key % 11 - 5) * 9.0).alias("w"), (F.col("l_extendedprice") / 131072.0).alias("re"), F.col("l_discount").alias("im"), (F.col("l_returnflag") == "R").alias("flag"), F.col("l_quantity").cast("double").alias("weight"),
    )
    spw = line.select(F.expr("l_linenumber div 2").alias("chan")).distinct().withColumn("freq_hz", F.col("chan") * 1e6 + 9e8)
    pol = line.select((F.col("l_linenumber") % 2).alias("corr")).distinct().withColumn("code", F.when(F.col("corr") == 0, 9).otherwise(12))
    return rows, spw, pol


@query(DECLARED_SQL + " select scan, t, y, x, round(sum(weight * (re * cos(phase) - im * sin(phase))) / any_value(n) / count(*), 6) as flux from ph group by scan, t, y, x")
def visibilities_end_to_end(spark, sf):
    vis = R.search_rows(*_declared(spark, sf))
    return r6(I.frame_images(vis, 8, 0.02, "average", by=["scan", "t"], w_term=True, epsilon=1e-14))


@query("select code, case code when 5 then 'RR' when 6 then 'RL' when 7 then 'LR' when 8 then 'LL' when 9 then 'XX' when 10 then 'XY' when 11 then 'YX' when 12 then 'YY' else code::varchar end as label from (select distinct p_size as code from part)")
def correlation_labels(spark, sf):
    return N.table(spark, sf, "part").select(F.col("p_size").alias("code")).distinct().withColumn("label", I.correlation_label(F.col("code")))


# Cubes


@query(ctes("cube") + " select t, y, x, flux from cube")
def cube_dense(spark, sf):
    return N.cube(spark, sf)


@query(ctes("cube", "clean") + " select t, y, x, round(flux, 6) + 0 as flux from clean")
def highpass_mean(spark, sf):
    return r6(C.subtract_mean(N.cube(spark, sf)).select("t", "y", "x", "flux"))


def _moving_sql(w: int) -> str:
    return ctes("cube") + f" select t, y, x, total from (select t, y, x, sum(flux) over w as total, count(*) over w as n from cube window w as (partition by y, x order by t rows between current row and {w - 1} following)) where n = {w}"


for _w in (1, 2, 4, 8):
    query(_moving_sql(_w), f"moving_sum_w{_w}")(lambda spark, sf, w=_w: C.moving_sum(N.cube(spark, sf), w))


def _mean_sql(centre: int) -> str:
    return ctes("cube") + f" select t, y, x, total / 4 as mean, t + {centre} as centre from (select t, y, x, sum(flux) over w as total, count(*) over w as n from cube window w as (partition by y, x order by t rows between current row and 3 following)) where n = 4"


@query(_mean_sql(2))
def boxcar_mean(spark, sf):
    return C.boxcar_mean(N.cube(spark, sf), 4)


@query(_mean_sql(1))
def center_policy(spark, sf):
    return C.boxcar_mean(N.cube(spark, sf), 4, "left")


def _mad(src: str, v: str, by: str) -> str:
    """CTEs md(by, sigma)."""
    on = f"using ({by})" if by else "on true"
    b = f"{by}," if by else ""
    g = f"group by {by}" if by else ""
    return f", mm as (select {b} median({v}) as m from {src} {g}), md as (select {b} case when 1.4826e0 * median(abs({v} - m)) > 0 then 1.4826e0 * median(abs({v} - m)) else 1 end as sigma from {src} join mm {on} {g})"


@query(ctes("cube") + _mad("cube", "flux", "t") + " select t, round(sigma, 6) as sigma from md")
def mad_per_frame(spark, sf):
    return r6(mad_sigma(N.cube(spark, sf), "flux", ["t"]))


STD = ", sm as (select y, x, stddev_pop(flux) as std from cube group by y, x)"


@query(ctes("cube") + STD + _mad("sm", "std", "") + " select round(sigma, 6) as sigma from md")
def mad_global(spark, sf):
    return r6(mad_sigma(C.std_map(N.cube(spark, sf)), "std"))


def _clip_rounds(v: str, src: str) -> str:
    """Five unrolled rounds of global clipping, each over all values."""
    out = f", k0 as (select median({v}) as mu from {src}), s0 as (select mu, 1.4826e0 * median(abs({v} - mu)) as s from {src}, k0 group by mu)"
    for i in range(1, 6):
        out += f", s{i} as (select case when any_value(s) <= 0 or count(*) filter (abs({v} - mu) <= 3 * s) = 0 then any_value(mu) else avg({v}) filter (abs({v} - mu) <= 3 * s) end as mu, case when any_value(s) <= 0 or count(*) filter (abs({v} - mu) <= 3 * s) = 0 then any_value(s) when count(*) filter (abs({v} - mu) <= 3 * s) = 1 then 0 else stddev_samp({v}) filter (abs({v} - mu) <= 3 * s) end as s from {src}, s{i - 1})"
    return out + ", cg as (select case when s > 0 then s else 1 end as sigma from s5)"


@query(ctes("cube") + STD + _clip_rounds("std", "sm") + " select round(sigma, 6) as sigma from cg")
def clipped_rms_global(spark, sf):
    return r6(clipped_sigma(C.std_map(N.cube(spark, sf)), "std", []))


CLIP_FRAMES = """, st as (select t, median(flux) as mu, list(flux) as vals from cube group by t), s0 as (select t, mu, vals, 1.4826e0 * list_median(list_transform(vals, lambda v: abs(v - mu))) as s from st),
f(i, t, vals, mu, s, done) as (select 0, t, vals, mu, s, s <= 0 from s0 union all
  select i + 1, t, case when stop then vals else kept end, case when stop then mu else list_avg(kept) end, case when stop then s when len(kept) = 1 then 0 else list_stddev_samp(kept) end, stop from
  (select *, done or len(kept) = 0 or len(kept) = len(vals) as stop from (select *, list_filter(vals, lambda v: abs(v - mu) <= 3 * s) as kept from f where i < 5)))
select t, round(case when s > 0 then s else 1 end, 6) as sigma from f where i = 5"""


@query(ctes("cube") + CLIP_FRAMES)
def clipped_rms_per_frame(spark, sf):
    return r6(clipped_sigma(N.cube(spark, sf), "flux", ["t"], cumulative=True))


def _snr_sql(w: int, tail: str) -> str:
    return (
        ctes("cube", "clean")
        + f""", frame as (select t, bool_and(flux = 0) as empty from cube group by t),
win as (select t, y, x, sum(flux) over w as total, sum(raw) over w as rt, count(*) over w as n, bool_or(empty) over w as hit, lead(raw, {w // 2}) over (partition by y, x order by t) as cr from clean join frame using (t)
  window w as (partition by y, x order by t rows between current row and {w - 1} following)), sums as (select * from win where n = {w})"""
        + _mad("sums", "total", "t")
        + ", snr as (select t, y, x, case when not hit and cr <> 0 and rt <> 0 then total / sigma else 0 end as snr, total from sums join md using (t)) "
        + tail
    )


@query(_snr_sql(4, "select t, y, x, round(snr, 6) as snr, round(total, 6) as total from snr where snr >= 3"))
def boxcar_snr_spatial(spark, sf):
    return r6(C.above(C.boxcar_snr(N.clean(spark, sf), 4), 3.0)).select("t", "y", "x", "snr", "total")


@query(
    ctes("cube", "clean")
    + """ select t, y, x, round(case when d > 1e-9 then s / d else 0 end, 6) as snr from (select t, y, x, s, sqrt(greatest(0, s2 / 4 - (s / 4) * (s / 4))) * 2 as d, n from
(select t, y, x, sum(flux) over w as s, sum(flux * flux) over w as s2, count(*) over w as n from clean window w as (partition by y, x order by t rows between current row and 3 following))) where n = 4"""
)
def boxcar_snr_temporal(spark, sf):
    return r6(C.boxcar_snr_temporal(N.clean(spark, sf), 4))


def _snr_widths(widths=(1, 2, 4)) -> str:
    """CTE sw(width, t, y, x, snr)."""
    parts, first = [], ctes("cube", "clean") + ", frame as (select t, bool_and(flux = 0) as empty from cube group by t)"
    for w in widths:
        parts.append(f"select {w}::bigint as width, t, y, x, sum(flux) over w as total, sum(raw) over w as rt, count(*) over w as n, bool_or(empty) over w as hit, lead(raw, {w // 2}) over (partition by y, x order by t) as cr from clean join frame using (t) window w as (partition by y, x order by t rows between current row and {w - 1} following)")
    return first + ", win as (" + " union all ".join(f"({p})" for p in parts) + "), sums as (select * from win where n = width)" + _mad("sums", "total", "width, t") + ", sw as (select width, t, y, x, case when not hit and cr <> 0 and rt <> 0 then round(total / sigma, 6) else 0 end as snr from sums join md using (width, t))"


def _widths(spark, sf, widths=(1, 2, 4)):
    return C.multi_width(N.clean(spark, sf), list(widths), places=6).select("width", "t", "y", "x", "snr")


@query(_snr_widths() + " select width, t, y, x, snr from (select *, row_number() over (partition by width order by snr desc, t, y, x) as k from sw where snr >= 2.5) where k <= 50")
def boxcar_topk(spark, sf):
    return C.top_k(C.above(_widths(spark, sf), 2.5), 50, ["width"]).drop("rank")


@query(_snr_widths() + " select width, count(*) as n from sw where snr >= 2.5 group by width")
def flatten_widths(spark, sf):
    return C.above(_widths(spark, sf), 2.5).groupBy("width").agg(F.count("*").alias("n"))


@query(_snr_sql(4, "select t, y, x, t - 0.5e0 as time_start, t + 3.5e0 as time_end, t + 1.5e0 as time_center, 4e0 as duration, t + 2 as center_idx from snr where snr >= 3"))
def time_tags(spark, sf):
    return C.time_tags(C.above(C.boxcar_snr(N.clean(spark, sf), 4), 3.0).select("t", "y", "x"), 4)


@query(
    ctes("cube")
    + """ , frame as (select t, bool_and(flux = 0) as empty from cube group by t) select t, y, x from (select t, y, x, bool_or(flux = 0 or empty) over w as bad, count(*) over w as n from cube join frame using (t)
window w as (partition by y, x order by t rows between current row and 3 following)) where n = 4 and not bad"""
)
def zero_flux_filter(spark, sf):
    return C.zero_flux_ok(N.cube(spark, sf), 4)


# Variance


@query(ctes("cube") + STD + " select y, x, round(std, 6) as std from sm")
def std_map(spark, sf):
    return r6(C.std_map(N.cube(spark, sf)))


@query(ctes("cube") + " select y, x, round(stddev_pop(flux)::float::double, 3) as std from cube group by y, x")
def std_map_fits(spark, sf):
    """The map with its world coordinates as a FITS file, read back by blocks of rows."""
    path, head = f"{shared_folder(spark)}/std-{uuid.uuid4().hex}.fits", sky.tangent_header(10, 10, 1e-4, 1e-4, 2.6, -0.5)
    words = spark.range(1).select(head.alias("h")).first().h.asDict()
    write_fits(C.std_map(N.cube(spark, sf)).withColumnRenamed("std", "value"), path, 10, 10, header=words, fill=float("nan"))
    return read_fits(spark, path).where("not isnan(value)").select("y", "x", (F.round("value", 3) + 0.0).alias("std"))


@query(ctes("cube") + " select y, x, count(*) as n, round(avg(flux), 6) as mean, round(stddev_samp(flux), 6) as std from cube group by y, x")
def welford_merge(spark, sf):
    states = C.welford(N.cube(spark, sf).withColumn("chunk", F.floor(F.col("t") / 10)), ["chunk", "y", "x"])
    m = C.welford_merge(states, ["y", "x"])
    return r6(m.select("y", "x", "n", "mean", C.welford_std(m).alias("std")))


VSNR = ctes("cube") + STD + _clip_rounds("std", "sm") + ", vs as (select y, x, std, round((std - (select avg(std) from sm)) / (select sigma from cg), 6) as snr from sm)"


@query(VSNR + " select y, x, round(std, 6) as std, snr from vs")
def variance_snr(spark, sf):
    return r6(C.variance_snr(C.std_map(N.cube(spark, sf))))


@query(VSNR + " select y, x, round(std, 6) as std, snr from vs where snr >= 0.5 order by snr desc, y, x limit 20")
def variance_topk(spark, sf):
    return C.top_k(C.above(r6(C.variance_snr(C.std_map(N.cube(spark, sf)))), 0.5), 20, ties=["y", "x"])


@query(
    ctes("lc")
    + """, o as (select *, row_number() over (partition by y, x order by t) as k, avg(flux) over (partition by y, x) as mean from lc),
e(y, x, k, t, ema, high) as (select y, x, k, t, (1 - a) * mean + a * flux, flux - ((1 - a) * mean + a * flux) from (select *, 1 - exp(-1e0 / 30) as a from o where k = 1)
  union all select o.y, o.x, o.k, o.t, (1 - (1 - exp(-(o.t - e.t) / 30e0))) * e.ema + (1 - exp(-(o.t - e.t) / 30e0)) * o.flux, o.flux - ((1 - (1 - exp(-(o.t - e.t) / 30e0))) * e.ema + (1 - exp(-(o.t - e.t) / 30e0)) * o.flux) from e join o on o.y = e.y and o.x = e.x and o.k = e.k + 1)
select y, x, t, round(high, 4) as high from e"""
)
def ema_highpass(spark, sf):
    return C.ema_highpass(N.lc(spark, sf), 30.0, first_step=1.0).withColumn("high", F.round("high", 4))


@query(
    ctes("cube")
    + """ , frame as (select t, bool_and(flux = 0) as empty from cube group by t), good as (select y, x, t, round(abs(flux - avg(flux) over (partition by y, x)), 9) as s from cube join frame using (t) where flux <> 0 and not empty)
select y, x, t from (select *, row_number() over (partition by y, x order by s desc, t) as k from good) where k = 1"""
)
def peak_time_tag(spark, sf):
    return C.peak_time(N.cube(spark, sf))


# Greedy selection


def _box(lo: int, hi: int, src: str, by: str = "t", value: str = "snr") -> str:
    return f"select a.*, (select max(b.{value}) from {src} b where b.{by} = a.{by} and b.y - a.y between {-lo} and {hi} and b.x - a.x between {-lo} and {hi}) as top from {src} a"


@query(ctes("cube") + f" select t, y, x, flux, top from ({_box(2, 2, 'cube', value='flux')})")
def max_filter_2d(spark, sf):
    return G.max_filter(N.cube(spark, sf), 2, 2, ["t"], "flux")


@query(ctes("cube") + f" select t, y, x, flux, top from ({_box(2, 1, 'cube', value='flux')})")
def max_filter_scipy(spark, sf):
    return G.max_filter(N.cube(spark, sf), 2, 1, ["t"], "flux")


@query(
    VSNR
    + f""", m as (select 0 as t, y, x, case when snr >= 0 then snr end as snr from vs), p as (select y, x, snr, row_number() over (order by snr desc, y, x) as k from ({_box(1, 1, "m")}) where snr >= top),
f(k, kept) as (select 0, []::struct(y bigint, x bigint, snr double)[] union all select f.k + 1, case when len(list_filter(f.kept, lambda q: abs(q.y - p.y) <= 3 and abs(q.x - p.x) <= 3)) = 0 then list_append(f.kept, {{'y': p.y, 'x': p.x, 'snr': p.snr}}) else f.kept end from f join p on p.k = f.k + 1)
select d.y, d.x, d.snr from (select unnest(kept) as d from (select kept from f order by k desc limit 1))"""
)
def nms_2d(spark, sf):
    vs = r6(C.variance_snr(C.std_map(N.cube(spark, sf)))).withColumn("t", F.lit(0))
    return G.nms_2d(G.local_maxima(vs, 3, ["t"], 0.0), 3)


THR = 2.5


@query(
    _snr_widths()
    + f""", o as (select width, t, y, x, snr from sw where snr >= {THR}), fr as (select width, t, list({{'y': y, 'x': x, 'snr': snr}} order by y, x) as px, row_number() over (partition by width order by t) as k from o group by width, t),
f(width, k, kept) as (select distinct width, 0::bigint, []::struct(t bigint, y bigint, x bigint, snr double)[] from fr union all
  select width, k, list_concat(kept, list_transform(list_filter(free, lambda p: len(list_filter(free, lambda q: q.y - p.y between -1 and 1 and q.x - p.x between -1 and 1 and q.snr > p.snr)) = 0), lambda p: {{'t': t, 'y': p.y, 'x': p.x, 'snr': p.snr}}))
  from (select fr.width, fr.k, fr.t, f.kept, list_filter(fr.px, lambda p: len(list_filter(f.kept, lambda q: q.t >= fr.t - 4 and q.t < fr.t and abs(q.y - p.y) <= 3 and abs(q.x - p.x) <= 3)) = 0) as free from f join fr on fr.width = f.width and fr.k = f.k + 1))
select width, d.t, d.y, d.x, d.snr from (select width, unnest(kept) as d from (select width, max_by(kept, k) as kept from f group by width))"""
)
def nms_per_width(spark, sf):
    return G.nms_per_width(_widths(spark, sf), 3, 2, THR)


ORDER = {"max_snr": "0", "prefer_short": "width", "prefer_long": "-width"}
for _p, _o in ORDER.items():
    query(
        _snr_widths()
        + f""", d as (select width, t + width // 2 as c, y, x, snr, row_number() over (order by {_o}, snr desc, t + width // 2, y, x, width) as k from sw where snr >= {THR}),
f(k, kept) as (select 0::bigint, []::struct(c bigint, y bigint, x bigint, width bigint, snr double)[] union all
  select f.k + 1, case when len(list_filter(f.kept, lambda q: abs(q.y - d.y) <= 3 and abs(q.x - d.x) <= 3 and abs(q.c - d.c) <= 16)) = 0 then list_append(f.kept, {{'c': d.c, 'y': d.y, 'x': d.x, 'width': d.width, 'snr': d.snr}}) else f.kept end from f join d on d.k = f.k + 1)
select e.c, e.y, e.x, e.width, e.snr from (select unnest(kept) as e from (select kept from f order by k desc limit 1))""",
        f"group_across_widths_{_p}",
    )(lambda spark, sf, p=_p: G.group_widths(C.above(_widths(spark, sf), THR).withColumn("c", F.col("t") + F.expr("width div 2")), 3, 8, p))


# Chunk by chunk: each chunk's spread is that of all samples up to its end


@query(ctes("cube") + """, ck as (select *, (t - (select min(t) from cube)) // 16 as chunk from cube), ends as (select distinct chunk from ck)
select e.chunk, c.y, c.x, count(*)::bigint as n, round(avg(flux), 6) as mean, round(stddev_samp(flux), 6) as std from ends e join ck c on c.chunk <= e.chunk group by e.chunk, c.y, c.x""")
def welford_cumulative(spark, sf):
    cube = N.cube(spark, sf)
    first = cube.agg(F.min("t").alias("first"))
    chunked = cube.crossJoin(F.broadcast(first)).withColumn("chunk", F.expr("(t - first) div 16"))  # one row
    states = C.welford_prefix(C.welford(chunked, ["chunk", *C.PIXEL]), C.PIXEL)
    return r6(states.select("chunk", "y", "x", "n", "mean", C.welford_std(states).alias("std")))


# The composed search: two observations lie in one table, and each gives what it gives alone


def _search_sql(beam: int) -> str:
    """Both searches of one observation, alone in its table, from the cube to candidates with their place in the sky."""
    alone = lambda sql: sql.replace("from lineitem", f"from lineitem where l_linenumber % 2 = {beam}")
    parts = []
    for w in (1, 2, 4):
        parts.append(f"select {w}::bigint as width, t, y, x, sum(flux) over w as total, sum(raw) over w as rt, count(*) over w as n, bool_or(empty) over w as hit, bool_or(raw = 0 or empty) over w as bad, lead(raw, {w // 2}) over (partition by y, x order by t) as cr from clean join frame using (t) window w as (partition by y, x order by t rows between current row and {w - 1} following)")
    box = alone(ctes("cube", "clean")) + ", frame as (select t, bool_and(flux = 0) as empty from cube group by t), win as (" + " union all ".join(f"({p})" for p in parts) + "), sums as (select * from win where n = width)" + _mad("sums", "total", "width, t") + f""",
sw as (select width, t, y, x, not bad as clear, case when not hit and cr <> 0 and rt <> 0 then round(total / sigma, 6) else 0 end as snr from sums join md using (width, t)), o as (select * from sw where snr >= {THR}),
fr as (select width, t, list({{'y': y, 'x': x, 'snr': snr, 'clear': clear}} order by y, x) as px, row_number() over (partition by width order by t) as k from o group by width, t),
f(width, k, kept) as (select distinct width, 0::bigint, []::struct(t bigint, y bigint, x bigint, snr double)[] from fr union all
  select width, k, list_concat(kept, list_transform(list_filter(free, lambda p: p.clear and len(list_filter(free, lambda q: q.y - p.y between -1 and 1 and q.x - p.x between -1 and 1 and q.snr > p.snr)) = 0), lambda p: {{'t': t, 'y': p.y, 'x': p.x, 'snr': p.snr}}))
  from (select fr.width, fr.k, fr.t, f.kept, list_filter(fr.px, lambda p: len(list_filter(f.kept, lambda q: q.t >= fr.t - 4 and q.t < fr.t and abs(q.y - p.y) <= 3 and abs(q.x - p.x) <= 3)) = 0) as free from f join fr on fr.width = f.width and fr.k = f.k + 1)),
nm as (select width, d.t, d.y, d.x, d.snr from (select width, unnest(kept) as d from (select width, max_by(kept, k) as kept from f group by width))),
gd as (select width, t + width // 2 as c, y, x, snr, row_number() over (order by snr desc, t + width // 2, y, x, width) as k from nm),
g(k, kept) as (select 0::bigint, []::struct(c bigint, y bigint, x bigint, width bigint, snr double)[] union all
  select g.k + 1, case when len(list_filter(g.kept, lambda q: abs(q.y - gd.y) <= 3 and abs(q.x - gd.x) <= 3 and abs(q.c - gd.c) <= 16 or q.c = gd.c)) = 0 then list_append(g.kept, {{'c': gd.c, 'y': gd.y, 'x': gd.x, 'width': gd.width, 'snr': gd.snr}}) else g.kept end from g join gd on gd.k = g.k + 1),
bx as (select 'boxcar' as kind, e.y, e.x, e.snr, e.width, e.c - e.width // 2 as t0_idx, 10 + e.c - e.width // 2 + (e.width - 1) / 2e0 as time_center from (select unnest(kept) as e from (select kept from g order by k desc limit 1))),
sd as (select y, x, stddev_samp(flux) as std from cube group by y, x)""" + _clip_rounds("std", "sd") + f""",
vs as (select 0 as t, y, x, round((std - (select avg(std) from sd)) / (select sigma from cg), 6) as snr from sd), vm as (select t, y, x, case when snr >= 0.5 then snr end as snr from vs),
vp as (select y, x, snr, row_number() over (order by snr desc, y, x) as k from ({_box(1, 1, "vm")}) where snr >= top),
vf(k, kept) as (select 0, []::struct(y bigint, x bigint, snr double)[] union all select vf.k + 1, case when len(list_filter(vf.kept, lambda q: abs(q.y - vp.y) <= 3 and abs(q.x - vp.x) <= 3)) = 0 then list_append(vf.kept, {{'y': vp.y, 'x': vp.x, 'snr': vp.snr}}) else vf.kept end from vf join vp on vp.k = vf.k + 1),
pk as (select y, x, t, row_number() over (partition by y, x order by round(abs(flux - m), 9) desc, t) as k from (select *, avg(flux) over (partition by y, x) as m from cube join frame using (t) where flux <> 0 and not empty)),
va as (select 'variance' as kind, d.y, d.x, d.snr, null::bigint as width, null::bigint as t0_idx, 10e0 + pk.t as time_center from (select unnest(kept) as d from (select kept from vf order by k desc limit 1)) left join pk on pk.y = d.y and pk.x = d.x and pk.k = 1),
al as (select * from bx union all select * from va), lm as (select *, -(x - 4.5e0) * 0.01e0 as l, -(y - 4.5e0) * 0.01e0 as m from al), ln as (select *, sqrt(1 - l * l - m * m) as n from lm)
select {beam} as beam, kind, y, x, snr, width as width_samples, t0_idx, time_center, round(degrees(2.6e0 + atan2(l, n * cos(-0.5e0) - m * sin(-0.5e0))), 6) as ra_deg, round(degrees(asin(m * cos(-0.5e0) + n * sin(-0.5e0))), 6) as dec_deg from ln"""
    return box


@query(" union all ".join(f"select * from ({_search_sql(b)})" for b in (0, 1)))
def search_end_to_end(spark, sf):
    s = E.Settings(npix=10, cell=0.01, ra0=2.6, dec0=-0.5, t0=10.0, widths=[1, 2, 4], threshold=THR, var_threshold=0.5, radius=3)
    found = E.search_cube(C.dense(N.obs(spark, sf, (F.col("l_linenumber") % 2).cast("int").alias("beam")), ["beam"], empty=True), s, ["beam"])
    of_box = lambda c: F.when(F.col("kind") == "boxcar", F.col(c)).alias(c)
    return found.select("beam", "kind", "y", "x", "snr", of_box("width_samples"), of_box("t0_idx"), "time_center", F.round(F.degrees("ra_rad"), 6).alias("ra_deg"), F.round(F.degrees("dec_rad"), 6).alias("dec_deg"))


# Sky


@query("select p_partkey, round((p_partkey % 64 - 31.5e0) * 0.0001e0, 9) as l, round((p_size - 31.5e0) * 0.0001e0, 9) as m from part")
def lm_from_xy(spark, sf):
    l, m = sky.lm_from_xy(F.col("p_partkey") % 64, F.col("p_size"), 64, 64, 1e-4, 1e-4)  # noqa: E741
    return N.table(spark, sf, "part").select("p_partkey", F.round(l, 9).alias("l"), F.round(m, 9).alias("m"))


RADEC = """g as (select p_partkey, (p_partkey % 64 - 31.5e0) * 0.0101e0 as l, (p_size - 31.5e0) * 0.0101e0 as m from part), n as (select *, sqrt(1 - l * l - m * m) as n from g),
rd as (select p_partkey, 2.6e0 + atan2(l, n * cos(-0.5e0) - m * sin(-0.5e0)) as ra, asin(m * cos(-0.5e0) + n * sin(-0.5e0)) as dec from n)"""


def _radec(spark, sf):
    l, m = sky.lm_from_xy(F.col("p_partkey") % 64, F.col("p_size"), 64, 64, 0.0101, 0.0101)  # noqa: E741
    ra, dec = sky.radec_from_lm(l, m, 2.6, -0.5)
    return N.table(spark, sf, "part").select("p_partkey", ra.alias("ra"), dec.alias("dec"))


@query("with " + RADEC + " select p_partkey, round(ra, 9) as ra, round(dec, 9) as dec from rd")
def radec_from_lm(spark, sf):
    return _radec(spark, sf).select("p_partkey", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"))


HMS = RADEC + """, te as (select p_partkey, (round_even(fmod(fmod(ra, 2 * pi()) + 2 * pi(), 2 * pi()) * (12 / pi()) * 36000, 0))::bigint % 864000 as h, least(round_even(abs(degrees(dec)) * 36000, 0)::bigint, 3240000) as d, degrees(dec) >= 0 as up from rd),
sx as (select p_partkey, format('{:02d}:{:02d}:{:02d}.{:d}', h // 36000, h // 600 % 60, h // 10 % 60, h % 10) as ra_hms, (case when up then '+' else '-' end) || format('{:02d}:{:02d}:{:02d}.{:d}', d // 36000, d // 600 % 60, d // 10 % 60, d % 10) as dec_dms from te)"""


@query("with " + HMS + " select p_partkey, ra_hms, dec_dms from sx")
def sexagesimal(spark, sf):
    h, d = sky.sexagesimal(F.col("ra"), F.col("dec"))
    return _radec(spark, sf).select("p_partkey", h.alias("ra_hms"), d.alias("dec_dms"))


@query("with " + HMS + " select p_partkey, 'J' || replace(ra_hms, ':', '') || replace(dec_dms, ':', '') as srcname from sx")
def srcname(spark, sf):
    h, d = sky.sexagesimal(F.col("ra"), F.col("dec"))
    return _radec(spark, sf).select("p_partkey", sky.source_name(h, d).alias("srcname"))


SPOTS = ", spots as (select min(id) as id, ra, dec from det group by ra, dec)"


@query(ctes("det") + SPOTS + f" select a.id as a, b.id as b, round({SQL['sep']}, 4) as sep from spots a join spots b on true where {SQL['sep']} <= 35")
def separation_pairs(spark, sf):
    spots = N.det(spark, sf).groupBy("ra", "dec").agg(F.min("id").alias("id"))
    return K.near_pairs(spots, spots, 35.0).withColumn("sep", F.round("sep", 4))


@query(
    ctes("det") + SPOTS + f""", pr as (select a.id as a, b.id as b from spots a join spots b on true where {SQL['sep']} <= 35), reach as (select a as node, a as low from pr union select pr.b, reach.low from reach join pr on pr.a = reach.node),
comp as (select node, min(low) as component from reach group by node) select det.id, component from det join spots using (ra, dec) join comp on comp.node = spots.id"""
)
def sky_components(spark, sf):
    return K.sky_components(N.det(spark, sf).select("id", "ra", "dec"), 35.0).select("id", "component")


TOL = 300_000_000
GROUPS = f""", an(scan, g, t) as (select scan, 0::bigint, min(time) from det group by scan union all select an.scan, any_value(an.g) + 1, min(det.time) from an join det on det.scan = an.scan and det.time > an.t + {TOL} group by an.scan, an.t),
gr as (select det.*, an.g as grp from det asof join an on det.scan = an.scan and det.time >= an.t)"""


@query(ctes("det") + GROUPS + " select id, scan, grp from gr")
def anchored_time_groups(spark, sf):
    return G.anchored_groups(N.det(spark, sf), "time", TOL, ["scan"]).select("id", "scan", "grp")


def _events(spark, sf):
    return E.event_table(N.det(spark, sf), TOL, 35.0)


# Sources of the view lie 145 arc seconds apart, so the lattice cell is the component.
EVENTS = GROUPS + """, cl as (select *, round((ra - 150) / 0.05e0 - 0.02e0)::bigint * 100 + round((dec + 30) / 0.05e0 - 0.02e0)::bigint as cell from gr), ev as (select scan, grp, cell, min(id) as component, arg_max(time, {'s': snr, 'i': -id}) as time, arg_max(ra, {'s': snr, 'i': -id}) as ra, arg_max(dec, {'s': snr, 'i': -id}) as dec, max(snr) as max_snr,
  arg_max(beam, {'s': snr, 'i': -id}) as max_snr_beam, arg_max(width, {'s': snr, 'i': -id}) as max_snr_width, list_sort(list(distinct beam)) as beams, list_sort(list(distinct scan)) as scans, list_sort(list(distinct width)) as widths,
  count(distinct beam) as n_beams, count(*) as n_detections, string_agg(beam, ',' order by snr desc, id) as beam_all, list(snr order by snr desc, id) as snr_all from cl group by scan, grp, cell)"""


@query(ctes("det") + EVENTS + """ select time, round(ra, 6) as ra, round(dec, 6) as dec, max_snr, max_snr_beam, max_snr_width, array_to_string(beams, ',') as beam_ids, array_to_string(scans, ',') as scan_ids, array_to_string(widths, ',') as width_samples, n_beams, n_detections, beam_all from ev""")
def event_summary(spark, sf):
    return r6(_events(spark, sf)).select("time", "ra", "dec", "max_snr", "max_snr_beam", "max_snr_width", "beam_ids", "scan_ids", "width_samples", "n_beams", "n_detections", "beam_all")


SOURCES = EVENTS + """, nu as (select *, row_number() over (order by time, ra, dec) - 1 as event_id from ev), su as (select cell, {0} arg_max(ra, {{'s': max_snr, 'i': -event_id}}) as ra, arg_max(dec, {{'s': max_snr, 'i': -event_id}}) as dec, count(*) as n_events, sum(n_detections)::bigint as n_detections_total,
  array_to_string(list_sort(list_distinct(flatten(list(beams)))), ',') as beams_all, array_to_string(list_sort(list_distinct(flatten(list(scans)))), ',') as scans_all, max(max_snr) as max_snr, arg_max(time, {{'s': max_snr, 'i': -event_id}}) as max_snr_time_center,
  array_to_string(arg_max(beams, {{'s': max_snr, 'i': -event_id}}), ',') as max_snr_event_beams, arg_max(max_snr_beam, {{'s': max_snr, 'i': -event_id}}) as max_snr_beam, arg_max(max_snr_width, {{'s': max_snr, 'i': -event_id}}) as max_snr_width, array_to_string(list_sort(list_distinct(flatten(list(widths)))), ',') as widths_all from nu group by all)"""


def _sources_sql(extra: str) -> str:
    return EVENTS + SOURCES[len(EVENTS) :].replace("{0} ", extra).replace("{{", "{").replace("}}", "}").replace("from nu group by all)", "from nu group by cell" + (", scan)" if extra else ")"))


@query(
    ctes("det") + _sources_sql("") + """ select row_number() over (order by max_snr desc, ra, dec) - 1 as source_id, round(ra, 6) as ra, round(dec, 6) as dec, n_events, n_detections_total, beams_all, scans_all, max_snr, max_snr_time_center, max_snr_event_beams, max_snr_beam, max_snr_width,
array_to_string(list_sort(list_transform(string_split(widths_all, ','), lambda w: w::bigint)), ',') as width_samples_all from su"""
)
def super_summary(spark, sf):
    return r6(E.source_table(E.numbered_events(_events(spark, sf)), 35.0))


@query(
    ctes("det") + _sources_sql("scan,") + """, ob as (select cell, arg_max(ra, {'s': max_snr, 'c': scan}) as ra, arg_max(dec, {'s': max_snr, 'c': scan}) as dec, max(max_snr) as max_snr, arg_max(scan, {'s': max_snr, 'c': scan}) as max_snr_scan_id, count(distinct scan) as n_scans, array_to_string(list_sort(list(distinct scan)), ',') as scan_ids,
array_to_string(list_sort(list_distinct(flatten(list(string_split(beams_all, ','))))), ',') as beams_all, arg_max(max_snr_width, {'s': max_snr, 'c': scan}) as max_snr_width, array_to_string(list_sort(list_distinct(list_transform(flatten(list(string_split(widths_all, ','))), lambda w: w::bigint))), ',') as width_samples_all from su group by cell)
select round(ra, 6) as ra, round(dec, 6) as dec, max_snr, max_snr_scan_id, n_scans, scan_ids, beams_all, max_snr_width, width_samples_all from ob"""
)
def obs_summary(spark, sf):
    supers = E.scan_sources(E.numbered_events(_events(spark, sf)), 35.0)
    return r6(E.observation_table(supers, 35.0).drop("id"))


NEAR = """{n} as (select id, src_name, sep from (select a.id, b.src_name, round({sep}, 9) as sep, row_number() over (partition by a.id order by round({sep}, 9), b.src_name) as k from det a join {c} b on true where {sep} <= 6) where k = 1)"""


@query(ctes("det", "cats") + "," + NEAR.format(n="np", c="psr", sep=SQL["sep"]) + " select det.id, np.src_name, round(np.sep, 4) as sep from det left join np using (id)")
def crossmatch_nearest(spark, sf):
    return K.nearest(N.det(spark, sf).select("id", "ra", "dec"), N.suppliers(spark, sf), 6.0).withColumn("sep", F.round("sep", 4))


@query(
    ctes("det", "cats") + "," + NEAR.format(n="np", c="psr", sep=SQL["sep"]) + "," + NEAR.format(n="nr", c="(select min(src_name) as src_name, ra, dec from racs group by ra, dec)", sep=SQL["sep"])
    + " select det.id, coalesce(np.src_name, nr.src_name, 'unknown') as source_name, round(coalesce(np.sep, nr.sep), 4) as source_offset_arcsec, case when np.sep is not null then 'PSRCAT' when nr.sep is not null then 'RACS' else '' end as source_catalog from det left join np using (id) left join nr using (id)"
)
def crossmatch_priority(spark, sf):
    racs = N.customers(spark, sf).groupBy("ra", "dec").agg(F.min("src_name").alias("src_name"))
    got = K.crossmatch(N.det(spark, sf).select("id", "ra", "dec"), [("PSRCAT", N.suppliers(spark, sf)), ("RACS", racs)], 6.0)
    return got.withColumn("source_offset_arcsec", F.round("source_offset_arcsec", 4))


OBS_SQL = ORACLES["obs_summary"]


@query(
    OBS_SQL.replace("with recursive", "with recursive" + ctes("cats").removeprefix("with recursive") + ",", 1).replace("select round(ra, 6) as ra, round(dec, 6) as dec, max_snr, max_snr_scan_id", ", ox as (select cell as id, ra, dec from ob), " + NEAR.format(n="np", c="psr", sep=SQL["sep"]).replace("from det a", "from ox a") + " select round(ra, 6) as ra, round(dec, 6) as dec, max_snr, max_snr_scan_id")
    .replace("width_samples_all from ob", "width_samples_all, coalesce(np.src_name, 'unknown') as source_name, round(np.sep, 4) as source_offset_arcsec, case when np.sep is not null then 'PSRCAT' else '' end as source_catalog from ob left join np on np.id = ob.cell")
)
def aggregate_end_to_end(spark, sf):
    supers = E.scan_sources(E.numbered_events(_events(spark, sf)), 35.0)
    found = E.observation_table(supers, 35.0, [("PSRCAT", N.suppliers(spark, sf))], 6.0).drop("id")
    return r6(found.withColumn("source_offset_arcsec", F.round("source_offset_arcsec", 4)))


@query(ctes("det") + " select id from det where beam in ('beam03', 'beam07') or sqrt(((150.05e0 - ra) * cos(radians(-30e0))) ** 2 + (-30e0 - dec) ** 2) * 3600 <= 35")
def component_match(spark, sf):
    rows = N.det(spark, sf).select("id", F.col("beam").alias("srcname"), "ra", "dec")
    names = spark.createDataFrame([("beam03",), ("beam07",)], "srcname string")
    return K.component_match(rows, names, spark.createDataFrame([(150.05, -30.0)], "ra double, dec double"))


ARTEFACTS = """art as (select distinct case event_id % 6 when 0 then 'obs_boxcar_cand_' || s || '_w4.png' when 1 then 'obs_' || s || '_lc.txt' when 2 then 'obs_cand_' || s || '.fits' when 3 then 'obs_' || s || '.csv' when 4 then 'obs' || s || '_' || event_id || '.txt' else s || '_x.txt' end as artefact from (select event_id, 'Supplier#' || lpad((user_id % 30)::varchar, 9, '0') as s from events)),
nm as (select distinct s_name as srcname from supplier)"""


@query("with " + ARTEFACTS + " select artefact, srcname from art join nm on contains(artefact, 'cand_' || srcname) or contains(artefact, '_' || srcname || '_') or contains(artefact, '_' || srcname || '.')")
def artefact_match(spark, sf):
    ev = N.table(spark, sf, "events").select("event_id", F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 30).cast("string"), 9, "0")).alias("s"))
    form = [("obs_boxcar_cand_", "_w4.png"), ("obs_", "_lc.txt"), ("obs_cand_", ".fits"), ("obs_", ".csv")]
    name = F.concat("s", F.lit("_x.txt"))
    for k, (a, b) in enumerate(form):
        name = F.when(F.col("event_id") % 6 == k, F.concat(F.lit(a), "s", F.lit(b))).otherwise(name)
    name = F.when(F.col("event_id") % 6 == 4, F.concat(F.lit("obs"), "s", F.lit("_"), F.col("event_id").cast("string"), F.lit(".txt"))).otherwise(name)
    return K.artefact_match(ev.select(name.alias("artefact")), N.table(spark, sf, "supplier").select(F.col("s_name").alias("srcname")))


@query(
    """with h as (select event_id, (epoch_us(ts) % 1000000007)::double as ta from events), g as (select distinct (n * 97013)::double as mark from (select unnest(generate_series(0, 10400)) as n))
select event_id as id, arg_min(mark, {'d': abs(mark - ta), 'm': mark}) as time from h join g on mark between ta - 100000 and ta + 100000 group by event_id"""
)
def nearest_time(spark, sf):
    ev = N.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.expr("unix_micros(cast(ts as timestamp))") % 1000000007).cast("double").alias("time"))
    return K.nearest_time(ev, spark.range(10401).select((F.col("id") * 97013).cast("double").alias("time")))


# Names, lists, tables

FILES = """files as (select event_id, case event_id % 5 when 0 then 'FIELD' || user_id || '.SB' || (70000 + event_id) || '_beam' || lpad((user_id % 36)::varchar, 2, '0') || '_' || strftime(ts, '%Y%m%d%H%M%S') || '_boxcar_all.vot'
  when 1 then 'F' || user_id || '.SB' || (70000 + event_id) || '_' || strftime(ts, '%Y%m%d%H%M%S') || '_variance_super_summary.CSV' when 2 then 'F.SB12_native_combined_boxcar_all.csv' when 3 then 'nofield' else 'X.SB77974_Periodicity_ALL.xml' end as file from events)"""


@query(
    "with " + FILES + r""" select event_id, regexp_extract(file, '^([^.]+)\.', 1) as field, regexp_extract(file, '(SB\d{5,})', 1) as sbid, regexp_extract(file, '(beam\d+)', 1) as beam,
case when regexp_matches(file, '\d{14}') then regexp_extract(file, '(\d{14})', 1) else regexp_extract(file, '(\w+_combined)', 1) end as scan_id,
lower(coalesce(nullif(regexp_extract(file, '(?i)_(boxcar|variance|periodicity)_super_summary\.(?:vot|xml|csv)$', 1), ''), regexp_extract(file, '(?i)_(boxcar|variance|periodicity)_all\.(?:vot|xml|csv)$', 1))) as kind,
regexp_matches(file, '(?i)_(boxcar|variance|periodicity)_all\.(?:vot|xml|csv)$') as is_all, regexp_matches(file, '(?i)_(boxcar|variance|periodicity)_super_summary\.(?:vot|xml|csv)$') as is_super from files"""
)
def parse_filename(spark, sf):
    at, u, e = F.date_format("ts", "yyyyMMddHHmmss"), F.col("user_id").cast("string"), (F.col("event_id") + 70000).cast("string")
    name = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("FIELD"), u, F.lit(".SB"), e, F.lit("_beam"), F.lpad((F.col("user_id") % 36).cast("string"), 2, "0"), F.lit("_"), at, F.lit("_boxcar_all.vot")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("F"), u, F.lit(".SB"), e, F.lit("_"), at, F.lit("_variance_super_summary.CSV")))
        .when(F.col("event_id") % 5 == 2, "F.SB12_native_combined_boxcar_all.csv")
        .when(F.col("event_id") % 5 == 3, "nofield")
        .otherwise("X.SB77974_Periodicity_ALL.xml")
    )
    return N.table(spark, sf, "events").select("event_id", name.alias("file")).select("event_id", *(c.alias(k) for k, c in K.parse_name(F.col("file")).items()))


@query("""select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', "x" ,,' || p_size || ', 7', ','), lambda s: trim(s, ' "''')), lambda s: s <> ''), '|') as names, list_sum([p_size, 7])::bigint as total from part""")
def split_lists(spark, sf):
    text = F.concat("p_name", F.lit(', "x" ,,'), F.col("p_size").cast("string"), F.lit(", 7"))
    ints = F.slice(K.split_ints(text), -2, 2)
    return N.table(spark, sf, "part").select("p_partkey", F.array_join(K.split_strings(text), "|").alias("names"), F.aggregate(ints, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(ctes("cats") + " select 'fk5; circle(' || format('{:.6f}', ra) || ',' || format('{:.6f}', dec) || ',20.0\") # text={' || src_name || ' (x)}' as line from psr")
def region_lines(spark, sf):
    return N.suppliers(spark, sf).select(K.region_line(F.col("ra"), F.col("dec"), F.concat("src_name", F.lit(" {x}"))).alias("line"))


@query(ctes("det") + " select id as x, ''::varchar as srcname, -1::bigint as y, round(ra, 6) as ra_deg, snr, width as width_samples, -1::bigint as scan_id from det")
def sentinel_fill(spark, sf):
    d = N.det(spark, sf).select(F.col("id").alias("x"), F.radians("ra").alias("ra_rad"), "snr", F.col("width").alias("width_samples"))
    return r6(K.candidate_table(d)).select("x", "srcname", "y", "ra_deg", "snr", "width_samples", "scan_id")


@query(ctes("det") + " select id, snr, null::bigint as width from det where id % 2 = 0 union all by name select id, width from det where id % 2 = 1")
def union_missing_columns(spark, sf):
    d = N.det(spark, sf)
    return K.union_by_name(d.where("id % 2 = 0").select("id", "snr"), d.where("id % 2 = 1").select("id", "width"))


# Periodicity

NF, BLOCK = 16, 100


@query(ctes("power") + ", hs as (select y, x, h, k // m as k, power from power cross join (select unnest(generate_series(1, 4)) as h) cross join (select unnest(generate_series(1, 4)) as m) where m <= h and k % m = 0 and k // m < 64 // h) select y, x, h, k, sum(power) as power from hs group by all")
def harmonic_sum(spark, sf):
    return P.harmonic_sum(N.power(spark, sf), 4, 64)


@query(
    ctes("power") + ", hs as (select y, x, h, k // m as k, sum(power) as power from power cross join (select unnest(generate_series(1, 4)) as h) cross join (select unnest(generate_series(1, 4)) as m) where m <= h and k % m = 0 and k // m < 64 // h group by all)" + _mad("hs", "power", "h, k")
    + " select y, x, h, k, round(power / sigma, 6) as snr, round(k / 64e0, 6) as f_hz, round(64e0 / k, 6) as period_s from hs join md using (h, k) where k > 0 and power / sigma >= 7"
)
def periodicity_snr(spark, sf):
    return r6(P.periodicity(P.harmonic_sum(N.power(spark, sf), 4, 64), 7.0, 32, 1.0))


@query(ctes("power") + " select y, x, max(power) as top, arg_max(k, {'p': power, 'k': -k}) as k from power group by y, x")
def power_max_argmax(spark, sf):
    return P.best_frequency(N.power(spark, sf))


PHASE = f"2 * pi() * k * t / {2.0 * NF}e0"
DFT = f", sp as (select y, x, k, sum(flux * cos({PHASE})) / 1e4 as re, sum(flux * sin({PHASE})) / 1e4 as im from lc cross join (select unnest(generate_series(0, {NF - 1})) as k) group by all)"


def _spectrum(spark, sf):
    parts = P.block_spectrum(N.lc(spark, sf), NF, BLOCK)
    return P.stitch(parts, NF, BLOCK).withColumns({"re": F.col("re") / 1e4, "im": F.col("im") / 1e4})


@query(ctes("lc") + DFT + " select y, x, k, round(re, 4) + 0 as re, round(im, 4) + 0 as im from sp")
def phase_stitch(spark, sf):
    s = _spectrum(spark, sf)
    return s.select("y", "x", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query(ctes("lc") + DFT + " select y, x, k, round(re * re + im * im, 3) + 0 as power from sp")
def nufft_direct(spark, sf):
    return P.power(_spectrum(spark, sf)).withColumn("power", F.round("power", 3) + 0.0)


ADJOINT = """with ph as (select l_orderkey * 0.5e0 - 4.148808e3 * 50 * 1e-3 / (800 + l_linenumber * 10e0) ** 2 as t, (l_orderkey % 17 - 8)::double as u, (l_orderkey % 13 - 6)::double as v, l_extendedprice / 131072.0e0 as re, l_discount as im from lineitem where l_returnflag <> 'R'),
sp as (select y, x, k, 2 * pi() * (k / 8e0 * t - 0.01e0 * (u * (x - 2) + v * (y - 2))) as phase, re, im from ph cross join (select unnest(generate_series(0, 4)) as y) cross join (select unnest(generate_series(0, 4)) as x) cross join (select unnest(generate_series(2, 7)) as k))
select y, x, k, round(sum(re * cos(phase) - im * sin(phase)), 4) + 0 as re, round(sum(re * sin(phase) + im * cos(phase)), 4) + 0 as im from sp group by y, x, k"""


def _tones(spark, sf):
    return N.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 0.5).alias("time"), (F.col("l_orderkey") % 17 - 8).cast("double").alias("u"), (F.col("l_orderkey") % 13 - 6).cast("double").alias("v"), ((F.col("l_linenumber") * 10 + 800) * 1e6).alias("freq_hz"),
        (F.col("l_extendedprice") / 131072.0).alias("re"), F.col("l_discount").alias("im"), (F.col("l_returnflag") == "R").alias("flag"),
    )


@query(ADJOINT)
def adjoint_transform(spark, sf):
    got = P.stitched(P.adjoint_blocks(_tones(spark, sf), 5, 0.01, 0.5, 16, 0.25, 50.0, 5000), 16, 0.5)
    return got.select("y", "x", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query(ADJOINT)
def adjoint_gridded(spark, sf):
    got = gridded_spectrum(_tones(spark, sf), 5, 0.01, 0.5, 16, 0.25, 50.0, epsilon=1e-14)
    return got.select("y", "x", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("select p_partkey, round(x - 2 * pi() * floor((x + pi()) / (2 * pi())), 6) + 0 as wrapped, (2 ** ceil(log2(greatest(1, p_size))))::bigint as pow2, round(4.148808e3 * 500 * 1e-3 / (800 + p_size) ** 2, 9) as delay from (select *, p_retailprice / 7 as x from part)")
def phase_helpers(spark, sf):
    p = N.table(spark, sf, "part")
    return p.select("p_partkey", (F.round(sky.wrap_pi(F.col("p_retailprice") / 7), 6) + 0.0).alias("wrapped"), sky.next_pow2(F.col("p_size")).alias("pow2"), F.round(sky.dm_delay(500.0, (F.col("p_size") + 800).cast("double")), 9).alias("delay"))


# Snippets

CAND = ", cand as (select row_number() over (order by t, y, x) as cand, t, y, x from cube where flux >= 100)"


def _cand(spark, sf):
    """All cells at the threshold, numbered in order."""
    return K.number(N.cube(spark, sf).where("flux >= 100").select("t", "y", "x"), "cand", "t", "y", "x").withColumn("cand", F.col("cand") + 1)


def _snip_sql(value: str, at: str) -> str:
    steps = "cross join (select unnest(generate_series(-2, 2)) as dt) cross join (select unnest(generate_series(-1, 1)) as dy) cross join (select unnest(generate_series(-1, 1)) as dx)"
    return ctes("cube") + CAND + f", ends as (select min(t) a, max(t) b, min(y) c, max(y) d, min(x) e, max(x) f from cube), sn as (select cand, dt, dy, dx, {value} as flux from cand {steps} cross join ends left join cube c on {at})"


CLAMP = "c.t = greatest(a, least(b, cand.t + dt)) and c.y = greatest(c, least(d, cand.y + dy)) and c.x = greatest(e, least(f, cand.x + dx))".replace("greatest(c,", "greatest(ends.c,")
CONSTANT = _snip_sql("coalesce(c.flux, 0)", "c.t = cand.t + dt and c.y = cand.y + dy and c.x = cand.x + dx")


@query(CONSTANT + " select cand, dt, dy, dx, flux from sn")
def snippet_constant(spark, sf):
    return C.snippets(N.cube(spark, sf), _cand(spark, sf), 2, 1)


@query(_snip_sql("c.flux", CLAMP) + " select cand, dt, dy, dx, flux from sn")
def snippet_edge(spark, sf):
    return C.snippets(N.cube(spark, sf), _cand(spark, sf), 2, 1, "edge")


@query(CONSTANT + " select cand, arg_max(dt, {'f': flux, 't': -dt}) as dt, max(flux) as flux from sn where dy = 0 and dx = 0 group by cand")
def snippet_peak(spark, sf):
    return C.snippet_peak(C.snippets(N.cube(spark, sf), _cand(spark, sf), 2, 1))


@query(
    ctes("cube") + CAND + """, cw as (select *, 1 << (t % 3)::int as width from cand), sm as (select 1 as width, t, y, x, flux from cube union all select * from (select w as width, t, y, x, case when w = 2 then avg(flux) over w2 else avg(flux) over w4 end as flux from cube cross join (values (2), (4)) v(w)
  window w2 as (partition by w, y, x order by t rows between current row and 1 following), w4 as (partition by w, y, x order by t rows between current row and 3 following)) where t + width - 1 <= (select max(t) from cube))
select cw.cand, k, dy, dx, cw.t + k + cw.width // 2 as centre, round(coalesce(sm.flux, 0), 6) as flux from cw cross join (select unnest(generate_series(-2, 2)) as k) cross join (select unnest(generate_series(-1, 0)) as dy) cross join (select unnest(generate_series(-1, 0)) as dx)
left join sm on sm.width = cw.width and sm.t = cw.t + k and sm.y = cw.y + dy and sm.x = cw.x + dx"""
)
def snippet_smoothed(spark, sf):
    cand = _cand(spark, sf).withColumn("width", F.pow(F.lit(2), F.col("t") % 3).cast("long"))
    return r6(C.smoothed_snippets(N.cube(spark, sf), cand, [1, 2, 4], 5, 2))


@query(ctes("cube") + CAND + " select cand, cube.t, flux, case when count(*) over w = 4 then avg(flux) over w end as smooth from cand join cube using (y, x) window w as (partition by cand order by cube.t rows between current row and 3 following)")
def lightcurve(spark, sf):
    return C.light_curves(N.cube(spark, sf), _cand(spark, sf), 4)


@query(ctes("cube") + " select t, round(quantile_cont(flux, 0.05), 6) as p5, round(quantile_cont(flux, 0.995), 6) as p995 from cube group by t")
def percentiles(spark, sf):
    p = N.cube(spark, sf).groupBy("t").agg(F.percentile("flux", F.array(F.lit(0.05), F.lit(0.995))).alias("p"))
    return r6(p.select("t", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p995")))


# Smaller steps of a search and its tables


@query("select l_orderkey as row, l_linenumber as chan, case when l_returnflag = 'R' then 0 else l_tax * 100 end as weight from lineitem where l_linenumber between 2 and 4")
def weight_spectrum_channels(spark, sf):
    """A channel's own weights, where the table has them, of a range of channels."""
    line = N.table(spark, sf, "lineitem")
    vis = line.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("chan"), F.col("l_quantity").alias("weight"), (F.col("l_tax") * 100).alias("weight_spectrum"), (F.col("l_returnflag") == "R").alias("flag"))
    return I.flag_weights(I.weight_source(I.channel_range(vis, 2, 5))).select("row", "chan", "weight")


@query(ctes("vis") + " select t, row, chan, u, v, re, im, weight::double as weight from vis where corr = (select corr from (select distinct corr from vis) order by corr offset 1 limit 1)")
def corr_indexed(spark, sf):
    return I.indexed_correlation(N.vis(spark, sf), 1)


@query(ctes("cube") + """, mk as (select l_suppkey % 10 as y, l_partkey % 10 as x, sum(l_quantity) % 2 = 0 as valid from lineitem group by all), vc as (select * from cube semi join (select * from mk where valid) m using (y, x))
select f.t, f.mean, w.n, w.total from (select t, round(avg(flux), 6) as mean from vc group by t) f cross join (select count(*) as n, round(sum(m), 6) as total from (select avg(flux) as m from vc where t between (select min(t) + 5 from cube) and (select min(t) + 14 from cube) group by y, x)) w""")
def masked_means(spark, sf):
    """Means of frames, and the image of a window of them, over a mask's valid pixels."""
    line, cube = N.table(spark, sf, "lineitem"), N.cube(spark, sf)
    mask = line.groupBy((F.col("l_suppkey") % 10).alias("y"), (F.col("l_partkey") % 10).alias("x")).agg((F.sum("l_quantity") % 2 == 0).alias("valid"))
    own, first = C.valid_only(cube, mask), cube.agg(F.min("t").alias("t")).first().t or 0
    image = C.window_image(own, first + 5, first + 15).agg(F.count("*").alias("n"), F.sum("flux").alias("total"))
    return r6(C.frame_means(own).crossJoin(F.broadcast(image)))  # one row


@query(
    ctes("lc") + """, lo as (select y, x, min(t) as a from lc group by y, x)
select y, x, count(*) as n, round(avg(flux), 6) as mean, round(stddev_samp(flux), 6) as std from (select lc.*, (lc.t - lo.a) // 100 as chunk from lc join lo using (y, x)) group by y, x"""
)
def finalised_welford(spark, sf):
    """States of whole observations from those of their chunks."""
    lc = N.lc(spark, sf)
    first = lc.groupBy("y", "x").agg(F.min("t").alias("a"))
    states = E.final_states(lc.join(first, ["y", "x"]).withColumn("chunk", F.expr("(t - a) div 100")))
    return r6(states.select("y", "x", "n", "mean", C.welford_std(states).alias("std")))


@query(ctes("det") + """, one as (select *, round(ra * 3600 * 100)::bigint as a, case when id % 3 = 0 then '' when id % 3 = 1 then 'kept' end as ra_hms from det)
select id, ra_hms = 'kept' as kept, coalesce(nullif(ra_hms, ''), printf('%02d', (ra // 15)::int)) as hours from one""")
def filled_sexagesimal(spark, sf):
    """Sexagesimal places where they are missing or empty; others stay."""
    mark = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "kept")
    got = K.fill_sexagesimal(N.det(spark, sf).withColumn("ra_hms", mark), "ra", "dec")
    return got.select("id", F.when(mark.isNotNull(), mark == "kept").alias("kept"), F.when(F.col("ra_hms") == "kept", "kept").otherwise(F.substring("ra_hms", 1, 2)).alias("hours"))


@query("select event_id, round(m, 9) as mjd, strftime(make_timestamp(((m - 40587) * 86400000)::bigint * 1000), '%Y/%m/%d/%H:%M:%S') as begins, '-interval ' || user_id || ' ' || (user_id + 5) as option from (select *, 40587 + epoch_us(ts) // 1000000 / 86400.0e0 as m from events)")
def time_strings(spark, sf):
    """Dates and selections of time as other tools take them."""
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000") + 40587 * 86400
    return N.table(spark, sf, "events").select("event_id", F.round(sky.mjd(seconds), 9).alias("mjd"), F.substring(sky.timerange(seconds, seconds), 1, 19).alias("begins"), sky.interval_option(F.col("user_id"), F.col("user_id") + 5).alias("option"))


@query("""with f as (select distinct 'img_' || lpad((s_suppkey % 24)::varchar, 2, '0') || '_' || s_suppkey || '.fits' as file, 'img_' || lpad((s_suppkey % 24)::varchar, 2, '0') as own from supplier), b as (select distinct 'img_' || lpad((c_custkey % 36)::varchar, 2, '0') as beam from customer)
select beam, coalesce((select min(file) from f where contains(file, beam)), (select min(file) from f)) as file from b""")
def continuum_files(spark, sf):
    """The continuum image of each beam, by its label in the file's name."""
    label = lambda c, n: F.concat(F.lit("img_"), F.lpad((F.col(c) % n).cast("string"), 2, "0"))
    files = N.table(spark, sf, "supplier").select(F.concat(label("s_suppkey", 24), F.lit("_"), F.col("s_suppkey").cast("string"), F.lit(".fits")).alias("file"))
    return K.continuum_lookup(N.table(spark, sf, "customer").select(label("c_custkey", 36).alias("beam")), files)


@query("""with a as (select 'cand_' || s_suppkey || case when s_suppkey % 5 = 0 then '_Variance_' when s_suppkey % 5 = 1 then '_box_' else '_x_' end || 'a.png' as artefact from supplier)
select artefact from a where lower(artefact) not like '%@_variance@_%' escape '@'""")
def family_files(spark, sf):
    """Files without a mark of another family than the boxcar search's."""
    mark = F.when(F.col("s_suppkey") % 5 == 0, "_Variance_").when(F.col("s_suppkey") % 5 == 1, "_box_").otherwise("_x_")
    return K.family_filter(N.table(spark, sf, "supplier").select(F.concat(F.lit("cand_"), F.col("s_suppkey").cast("string"), mark, F.lit("a.png")).alias("artefact")), "boxcar")


@query(ctes("det") + " select d.id, d.scan from det d where d.scan in (select scan from det where snr >= 480)")
def members_of_chosen(spark, sf):
    """All rows of the components that a selection names."""
    rows = N.det(spark, sf).withColumn("component", F.col("scan"))
    return K.members(rows, rows.where("snr >= 480")).select("id", "scan")


@query(ctes("power") + " select x::bigint as x, y::bigint as y, k as nharm_used, round(power, 3) as snr, 'periodicity' as algo, 'f' as phase_center_field from power where k < 4")
def periodicity_table(spark, sf):
    """Periodic candidates in their catalogue's seventeen columns."""
    found = N.power(spark, sf).where("k < 4").select("x", "y", F.col("power").alias("snr"), F.col("k").alias("nharm_used"), F.lit("f").alias("phase_center_field"))
    table = K.candidate_table(found, K.PERIODICITY)
    return table.select("x", "y", "nharm_used", F.round("snr", 3).alias("snr"), "algo", "phase_center_field")


# Streams, run once over what is there


def _stream(spark, sf):
    return S.events(spark, sf, N.table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select * from (select date_trunc('day', ts)::timestamp as start, count(*) as n, round(sum(value), 4) as total from events group by 1) where start + interval '1 day' <= (select max(ts) - interval '1 day' from events)")
def stream_windows(spark, sf):
    got = S.run_once(S.windows(_stream(spark, sf), "1 day"), "stream_windows_out")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("select user_id, count(*) as n, round(avg(value), 9) as mean, round(var_pop(value) * count(*), 5) as m2 from events group by user_id")
def stream_welford(spark, sf):
    got = S.run_once(S.welford(_stream(spark, sf)), "stream_welford_out", "update")
    return got.groupBy("user_id").agg(F.max(F.struct("n", "mean", "m2")).alias("s")).select("user_id", "s.n", F.round("s.mean", 9).alias("mean"), F.round("s.m2", 5).alias("m2"))


@query("select distinct event_id from events")
def stream_dedupe(spark, sf):
    twice = _stream(spark, sf).unionByName(_stream(spark, sf))
    return S.run_once(S.dedupe(twice.select("event_id", "ts"), ["event_id"]), "stream_dedupe_out").select("event_id")

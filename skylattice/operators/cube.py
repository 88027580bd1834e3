"""Image cubes as rows (t, y, x, flux): densifying, filters in time, boxcar searches, variance.

Cubes of many observations, chunks or beams lie in one table: `by` names the columns that tell them
apart, and nothing is computed over rows that differ in them.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import clipped_sigma, finite, mad_sigma, usable, with_clipped, with_mad

PIXEL = ["y", "x"]
AXIS_SALTS, REACH = 16, 100


def dense(obs: DataFrame, by: list[str] = (), empty: bool = False) -> DataFrame:
    """Every pixel seen at every time between the first and the last of its observation, 0 where nothing was observed.

    empty: adds whether the whole frame is zero, which the axis knows before it is spread over pixels.
    """
    by = list(by)
    ends = obs.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo is not null")
    axis = ends.select(*by, F.explode(F.sequence("lo", "hi")).alias("t"))
    if empty:
        seen = obs.where("flux <> 0").select(*by, "t").distinct().withColumn("seen", F.lit(True))
        axis = axis.join(seen, [*by, "t"], "left").select(*by, "t", F.col("seen").isNull().alias("empty"))
    pixels = obs.select(*by, *PIXEL).distinct()
    if by:  # one observation's pixels are dealt to many tasks, its axis to each of them
        salts = F.sequence(F.lit(0), F.lit(AXIS_SALTS - 1))
        pixels = pixels.withColumn("salt", F.pmod(F.xxhash64(*PIXEL), F.lit(AXIS_SALTS)).cast("int"))
        grid = pixels.join(axis.withColumn("salt", F.explode(salts)), [*by, "salt"])
    else:
        grid = pixels.join(F.broadcast(axis))  # the axis of one observation: a row a timestamp
    flux = F.coalesce("flux", F.lit(0)).cast("double").alias("flux")
    return grid.join(obs, [*by, "t", *PIXEL], "left").select(*by, "t", *PIXEL, flux, *(["empty"] if empty else []))


def along(width: int = 0, by: list[str] = ()) -> Window:
    w = Window.partitionBy(*by, *PIXEL).orderBy("t")
    return w.rowsBetween(0, width - 1) if width else w


def with_empty(cube: DataFrame, by: list[str] = (), value: str = "flux") -> DataFrame:
    """Adds `empty`, whether a frame is all zero, unless dense() has said so."""
    return cube if "empty" in cube.columns else cube.withColumn("empty", F.bool_and(F.col(value) == 0).over(Window.partitionBy(*by, "t")))


def subtract_mean(cube: DataFrame, rezero: bool = True, by: list[str] = ()) -> DataFrame:
    """Flux less the pixel's mean; with rezero, raw zeros stay zero."""
    clean = F.col("flux") - F.avg("flux").over(Window.partitionBy(*by, *PIXEL))
    return cube.withColumn("raw", F.col("flux")).withColumn("flux", F.when(F.col("flux") == 0, 0.0).otherwise(clean) if rezero else clean)


def valid_only(cube: DataFrame, mask: DataFrame, by: list[str] = ()) -> DataFrame:
    """The cube's valid pixels: mask is (by..., y, x, valid); a pixel that it lacks is not valid."""
    return cube.join(mask.where("valid").select(*by, *PIXEL).distinct(), [*by, *PIXEL], "left_semi")


def moving_sum(cube: DataFrame, width: int, by: list[str] = ()) -> DataFrame:
    """Forward sums of full windows only: (t, y, x, total)."""
    w = along(width, by)
    return cube.select(*by, "t", *PIXEL, F.sum("flux").over(w).alias("total"), F.count("flux").over(w).alias("n")).where(F.col("n") == width).drop("n")


def boxcar_mean(cube: DataFrame, width: int, centre: str = "right", by: list[str] = ()) -> DataFrame:
    """Means of full windows, with the time at the window's centre."""
    shift = width // 2 if centre == "right" else (width - 1) // 2
    return moving_sum(cube, width, by).select(*by, "t", *PIXEL, (F.col("total") / width).alias("mean"), (F.col("t") + shift).alias("centre"))


def window_sums(cube: DataFrame, widths: list[int], by: list[str] = (), zeroing: bool = True) -> DataFrame:
    """(by..., width, t, y, x, total, ok, clear) of the full windows of all widths, from one pass over each pixel's samples.

    cube comes from subtract_mean.  ok: the window touches no empty frame, and neither its centre nor its raw
    sum is zero.  clear: no sample of it is zero or missing either, what the zero-flux filter asks for.
    """
    src = with_empty(cube, by, "raw") if zeroing else cube.withColumn("empty", F.lit(False))
    zero = (F.col("raw") == 0) | F.isnan("raw") | F.col("empty")
    cols = []
    for k, width in enumerate(widths):
        w = along(width, by)
        ok = ~F.bool_or("empty").over(w) & (F.lead("raw", width // 2).over(along(0, by)) != 0) & (F.sum("raw").over(w) != 0) if zeroing else F.lit(True)
        cols += [F.sum("flux").over(w).alias(f"total{k}"), (F.count("flux").over(w) == width).alias(f"full{k}"), ok.alias(f"ok{k}"), (~F.bool_or(zero).over(w)).alias(f"clear{k}")]
    wide = src.select(*by, "t", *PIXEL, *cols)
    each = F.array(*(F.struct(F.lit(w).cast("long").alias("width"), *(F.col(f"{c}{k}").alias(c) for c in ("total", "full", "ok", "clear"))) for k, w in enumerate(widths)))
    return wide.select(*by, "t", *PIXEL, F.inline(each)).where("full").drop("full")


def boxcar_snrs(cube: DataFrame, widths: list[int], estimator: str = "mad", clip: float = 3.0, zeroing: bool = True, by: list[str] = (), mask: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """Window sums of all widths over their frame's spread: (by..., width, t, y, x, total, clear, snr); widths that no window fits give nothing.

    Where a mask (by..., y, x, valid) is given, other pixels have neither a share in the spread nor an S/N
    but 0.  places: decimals of the S/N, where ties should not hang on the last bits.
    """
    sums = window_sums(cube, widths, by, zeroing)
    if mask is not None:
        sums = sums.join(mask.where("valid").select(*by, *PIXEL).distinct().withColumn("valid", F.lit(True)), [*by, *PIXEL], "left").withColumn("valid", F.col("valid").isNotNull())
    value = F.col("total") if mask is None else F.when(F.col("valid"), F.col("total"))
    frame = [*by, "width", "t"]
    sums = sums.withColumn("__value", value)
    got = with_mad(sums, "__value", frame) if estimator == "mad" else with_clipped(sums, "__value", frame, clip, cumulative=True)
    snr = F.when(F.col("ok") & F.col("__value").isNotNull(), F.col("total") / F.col("sigma")).otherwise(0.0)
    return got.select(*by, "width", "t", *PIXEL, "total", "clear", (snr if places is None else F.round(snr, places)).alias("snr"))


def boxcar_snr(cube: DataFrame, width: int, estimator: str = "mad", clip: float = 3.0, zeroing: bool = True, by: list[str] = (), mask: DataFrame | None = None) -> DataFrame:
    """The search of one width: (by..., t, y, x, total, snr)."""
    return boxcar_snrs(cube, [width], estimator, clip, zeroing, by, mask).drop("width", "clear")


def boxcar_snr_temporal(cube: DataFrame, width: int, by: list[str] = ()) -> DataFrame:
    """Window sum over its own spread times the root of the width; 0 where that is 0."""
    w = along(width, by)
    s, s2 = F.sum("flux").over(w), F.sum(F.col("flux") * F.col("flux")).over(w)
    var = F.greatest(F.lit(0.0), s2 / width - (s / width) * (s / width))
    low = F.sqrt(var) * math.sqrt(width)
    got = cube.select(*by, "t", *PIXEL, s.alias("s"), low.alias("d"), F.count("flux").over(w).alias("n")).where(F.col("n") == width)
    return got.select(*by, "t", *PIXEL, F.when(F.col("d") > 1e-9, F.col("s") / F.col("d")).otherwise(0.0).alias("snr"))


def above(snr: DataFrame, threshold: float) -> DataFrame:
    """NaN never passes, though Spark orders it above all numbers."""
    return snr.where(finite(F.col("snr")) >= threshold)


def multi_width(cube: DataFrame, widths: list[int], **how) -> DataFrame:
    """Searches of all widths, with a column width."""
    return boxcar_snrs(cube, widths, **how)


def widths_in_samples(widths: list[float], dt: float | None = None) -> list[int]:
    """Seconds (with dt) round half to even; whole samples are cut; at least 1."""
    return [max(1, round(w / dt) if dt else int(w)) for w in widths]


def top_k(df: DataFrame, k: int, by: list[str] = (), ties: list[str] = ("t", "y", "x")) -> DataFrame:
    """The k best by S/N of each group (all if no group), ties by place."""
    order = [F.col("snr").desc(), *ties]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def time_tags(det: DataFrame, width: int | Column, t0: float = 0.0, dt: float = 1.0) -> DataFrame:
    """Begin, end, centre and duration of detections on an axis of step dt; width: a number or a column."""
    width = F.lit(width) if isinstance(width, int) else width
    a = F.lit(t0) + F.col("t") * dt - dt / 2
    b = F.lit(t0) + (F.col("t") + width - 1) * dt + dt / 2
    return det.withColumns({"time_start": a, "time_end": b, "time_center": (a + b) / 2, "duration": b - a, "center_idx": F.col("t") + F.floor(width / 2).cast("long")})


def zero_flux_ok(cube: DataFrame, width: int, by: list[str] = ()) -> DataFrame:
    """(t, y, x) of windows without any zero sample or empty frame: what the zero-flux filter accepts."""
    w = along(width, by)
    zero = (F.col("flux") == 0) | F.isnan("flux") | F.col("empty")
    got = with_empty(cube, by).select(*by, "t", *PIXEL, F.bool_or(zero).over(w).alias("bad"), F.count("flux").over(w).alias("n"))
    return got.where((F.col("n") == width) & ~F.col("bad")).select(*by, "t", *PIXEL)


# Variance


def std_map(cube: DataFrame, sample: bool = False, by: list[str] = ()) -> DataFrame:
    """Spread in time of each pixel: (y, x, std)."""
    v = finite(F.col("flux"))
    return cube.groupBy(*by, *PIXEL).agg((F.stddev_samp(v) if sample else F.stddev_pop(v)).alias("std"))


def variance_snr(stds: DataFrame, estimator: str = "clipped_rms", clip: float = 3.0, subtract: bool = True, by: list[str] = (), mask: DataFrame | None = None) -> DataFrame:
    """(by..., y, x, std, snr): each map less its mean, over its spread.

    The mean is over all pixels; the spread over the valid ones of a mask (by..., y, x, valid), where one is
    given, and other pixels have S/N 0.
    """
    by = list(by)
    value = F.col("std")
    if mask is not None:
        stds = stds.join(mask.where("valid").select(*by, *PIXEL).distinct().withColumn("valid", F.lit(True)), [*by, *PIXEL], "left")
        value = F.when(F.col("valid"), F.col("std"))
    stds = stds.withColumn("__value", value)
    if by:
        got = (with_mad if estimator == "mad" else lambda d, v, b: with_clipped(d, v, b, clip))(stds, "__value", by)
        got = got.withColumn("mean", F.avg(finite(F.col("std"))).over(Window.partitionBy(*by)))
    else:
        sigma = mad_sigma(stds, "__value") if estimator == "mad" else clipped_sigma(stds, "__value", [], clip)
        mean = stds.agg(F.avg(finite(F.col("std"))).alias("mean"))
        got = stds.join(F.broadcast(mean)).join(F.broadcast(sigma), how="left").withColumn("sigma", usable(F.col("sigma")))  # one row each
    snr = (F.col("std") - (F.col("mean") if subtract else F.lit(0.0))) / F.col("sigma")
    return got.select(*by, *PIXEL, "std", (snr if mask is None else F.when(F.col("valid"), snr).otherwise(0.0)).alias("snr"))


def welford(df: DataFrame, by: list[str], value: str = "flux") -> DataFrame:
    """Mergeable state of each group: (by..., n, mean, m2); NaN and infinities are skipped."""
    v = finite(F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))


def welford_merge(states: DataFrame, by: list[str]) -> DataFrame:
    """One state a group from many, as if all samples had been seen at once; empty states change nothing."""
    n, s = F.sum("n"), F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0)))
    sq = F.sum(F.col("m2") + F.col("n") * F.coalesce("mean", F.lit(0.0)) * F.coalesce("mean", F.lit(0.0)))
    return states.groupBy(*by).agg(n.alias("n"), F.try_divide(s, n).alias("mean"), F.coalesce(F.greatest(F.lit(0.0), sq - F.try_divide(s * s, n)), F.lit(0.0)).alias("m2"))


def welford_prefix(states: DataFrame, by: list[str], order: str = "chunk") -> DataFrame:
    """Each state merged with all before it in the order of a column: what a search that goes on from chunk to chunk has seen by then.

    A group's states are one row a chunk, so the window runs over chunks, never over samples.
    """
    row = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.coalesce("mean", F.lit(0.0))
    sums = states.withColumns({"__n": F.sum("n").over(row), "__s": F.sum(F.col("n") * mean).over(row), "__q": F.sum(F.col("m2") + F.col("n") * mean * mean).over(row)})
    m2 = F.coalesce(F.greatest(F.lit(0.0), F.col("__q") - F.try_divide(F.col("__s") * F.col("__s"), F.col("__n"))), F.lit(0.0))
    return sums.select(*(c for c in states.columns if c not in ("n", "mean", "m2")), F.col("__n").alias("n"), F.try_divide("__s", "__n").alias("mean"), m2.alias("m2"))


def welford_std(states: DataFrame, ddof: int = 1) -> Column:
    return F.when(F.col("n") > ddof, F.sqrt(F.col("m2") / (F.col("n") - ddof)))


def ema_highpass(lc: DataFrame, tau: float, by: list[str] = PIXEL, first_step: float | None = None, skip_nan: bool = True) -> DataFrame:
    """Flux less its exponential mean: (by..., t, high).  The mean starts at the group's; NaN is skipped.

    The step before the first sample is first_step (the cadence); without it the first sample changes
    nothing.  Without skip_nan a NaN stays, and makes all that follows NaN, as plots have it.  A group is one
    pixel's light curve.  The recursion is a sum of samples with falling weights, so windows do it: prefix sums
    within stretches of REACH time constants, in which weights keep in range, and the stretch before; what lies
    further back weighs less than exp(-REACH).
    """
    v = finite(F.col("flux")) if skip_nan else F.col("flux").cast("double")
    group, first = Window.partitionBy(*by), first_step or 0.0
    src = lc.where(v.isNotNull()).select(*by, "t", v.alias("v"), F.avg(finite(F.col("flux"))).over(group).alias("mean"), F.min("t").over(group).alias("t0"))
    gap = F.coalesce(F.col("t") - F.lag("t").over(group.orderBy("t", "v")), F.lit(first))
    reach = REACH * tau
    src = src.withColumns({"stretch": F.floor((F.col("t") - F.col("t0")) / reach).cast("long"), "b": (1 - F.exp(-gap / tau)) * F.col("v")})
    since = F.col("t") - F.col("t0") - F.col("stretch") * reach
    here = F.sum(F.col("b") * F.exp(since / tau)).over(Window.partitionBy(*by, "stretch").orderBy("t", "v").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(F.col("b") * F.exp((since - reach) / tau)).over(group.orderBy("stretch").rangeBetween(-1, -1)), F.lit(0.0))
    src = src.withColumns({"here": here, "before": before, "broken": F.bool_or(F.isnan("v")).over(group.orderBy("t", "v").rowsBetween(Window.unboundedPreceding, 0))})
    ema = F.exp(-since / tau) * (F.col("here") + F.col("before")) + F.col("mean") * F.exp(-(F.col("t") - F.col("t0") + first) / tau)
    return src.select(*by, "t", F.when(F.col("broken"), F.lit(float("nan"))).otherwise(F.col("v") - ema).alias("high"))


def peak_time(cube: DataFrame, policy: str = "peak_absdev", by: list[str] = ()) -> DataFrame:
    """(by..., y, x, t) of each pixel's peak over good samples, the first on a tie; policy `peak_flux` takes the largest flux, `peak_absdev` the largest deviation from the mean."""
    good = with_empty(cube, by).where((F.col("flux") != 0) & finite(F.col("flux")).isNotNull() & ~F.col("empty"))
    mean = F.avg("flux").over(Window.partitionBy(*by, *PIXEL))
    score = F.round(F.abs(F.col("flux") - mean), 9) if policy == "peak_absdev" else F.col("flux")
    return good.withColumn("score", score).groupBy(*by, *PIXEL).agg(F.max_by("t", F.struct("score", -F.col("t"))).alias("t"))


def frame_means(cube: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., t, mean) of each frame's finite pixels."""
    return cube.groupBy(*by, "t").agg(F.avg(finite(F.col("flux"))).alias("mean"))


def window_image(cube: DataFrame, start: int, stop: int, by: list[str] = ()) -> DataFrame:
    """(by..., y, x, flux): the mean of frames start to stop - 1."""
    return cube.where(F.col("t").between(start, stop - 1)).groupBy(*by, *PIXEL).agg(F.avg(finite(F.col("flux"))).alias("flux"))


# Snippets and light curves


def snippets(cube: DataFrame, cand: DataFrame, half_t: int, half_xy: int, pad: str = "constant", value: float = 0.0) -> DataFrame:
    """(cand, dt, dy, dx, flux): the cube around candidates (cand, t, y, x); edge padding clamps to what exists."""
    steps = lambda h: F.explode(F.sequence(F.lit(-h).cast("long"), F.lit(h).cast("long")))
    grid = cand.select("cand", F.col("t").alias("ct"), F.col("y").alias("cy"), F.col("x").alias("cx")).withColumn("dt", steps(half_t)).withColumn("dy", steps(half_xy)).withColumn("dx", steps(half_xy))
    at = {"t": F.col("ct") + F.col("dt"), "y": F.col("cy") + F.col("dy"), "x": F.col("cx") + F.col("dx")}
    if pad == "edge":
        e = cube.agg(*(f(c).alias(f"{n}_{c}") for c in at for n, f in (("lo", F.min), ("hi", F.max))))
        grid = grid.join(F.broadcast(e))  # one row
        at = {c: F.greatest(F.col(f"lo_{c}"), F.least(F.col(f"hi_{c}"), v)) for c, v in at.items()}
    grid = grid.withColumns(at)
    return grid.join(cube.select("t", "y", "x", "flux"), ["t", "y", "x"], "left").select("cand", "dt", "dy", "dx", F.coalesce("flux", F.lit(value)).alias("flux"))


def snippet_peak(snips: DataFrame) -> DataFrame:
    """(cand, dt, flux) where the centre pixel peaks, the first on a tie."""
    mid = snips.where("dy = 0 and dx = 0 and not isnan(flux)")
    return mid.groupBy("cand").agg(F.max_by("dt", F.struct("flux", -F.col("dt"))).alias("dt"), F.max("flux").alias("flux"))


def window_means(cube: DataFrame, widths: list[int], by: list[str] = ()) -> DataFrame:
    """(by..., width, t, y, x, flux): means of the full windows of all widths, by their first time, from one pass."""
    each = F.array(*(F.struct(F.lit(w).cast("long").alias("width"), F.avg("flux").over(along(w, by)).alias("flux"), (F.count("flux").over(along(w, by)) == w).alias("full")) for w in widths))
    return cube.select(*by, "t", *PIXEL, each.alias("each")).select(*by, "t", *PIXEL, F.inline("each")).where("full").drop("full")


def smoothed_snippets(cube: DataFrame, cand: DataFrame, widths: list[int], length: int = 25, size: int = 50, pad: str = "constant", value: float = 0.0, centre: str = "right", by: list[str] = ()) -> DataFrame:
    """(by..., cand, k, dy, dx, centre, flux): `length` smoothed frames and size x size pixels around candidates (by..., cand, t, y, x, width), t being the first time of their window.

    Frames are means over the candidate's own width; centre is the time at a frame's middle.  What lies outside of the
    smoothed cube is the pad value, or with pad `edge` the nearest that exists.  Widths that no candidate may have are left out.
    """
    steps = lambda n: F.explode(F.sequence(F.lit(-(n // 2)).cast("long"), F.lit(n - n // 2 - 1).cast("long")))
    grid = cand.select(*by, "cand", "width", F.col("t").alias("ct"), F.col("y").alias("cy"), F.col("x").alias("cx")).withColumn("k", steps(length)).withColumn("dy", steps(size)).withColumn("dx", steps(size))
    at = {"t": F.col("ct") + F.col("k"), "y": F.col("cy") + F.col("dy"), "x": F.col("cx") + F.col("dx")}
    shift = F.floor(F.col("width") / 2) if centre == "right" else F.floor((F.col("width") - 1) / 2)
    grid = grid.withColumn("centre", (at["t"] + shift).cast("long"))
    if pad == "edge":
        ends = cube.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in at for n, f in (("lo", F.min), ("hi", F.max))))
        grid = grid.join(F.broadcast(ends), list(by)) if by else grid.join(F.broadcast(ends))  # a row an observation
        last = {"t": F.col("hi_t") - F.col("width") + 1, "y": F.col("hi_y"), "x": F.col("hi_x")}
        at = {c: F.greatest(F.col(f"lo_{c}"), F.least(last[c], v)) for c, v in at.items()}
    grid = grid.withColumns(at)
    found = grid.join(window_means(cube, widths, by), [*by, "width", "t", *PIXEL], "left")
    return found.select(*by, "cand", "k", "dy", "dx", "centre", F.coalesce("flux", F.lit(value)).alias("flux"))


def map_snippets(maps: DataFrame, cand: DataFrame, size: int = 50, value: str = "std") -> DataFrame:
    """(cand, dy, dx, flux): size x size pixels of one map (y, x, std) around candidates (cand, y, x), the nearest pixel beyond its edges."""
    one = maps.select(F.lit(0).cast("long").alias("t"), *PIXEL, F.col(value).alias("flux"))
    own = cand.select("cand", F.lit(0).cast("long").alias("t"), *PIXEL, F.lit(1).cast("long").alias("width"))
    return smoothed_snippets(one, own, [1], 1, size, "edge").drop("k", "centre")


def light_curves(cube: DataFrame, cand: DataFrame, width: int) -> DataFrame:
    """(cand, t, flux, smooth) at candidates' pixels; smooth is the forward mean of full windows."""
    w = Window.partitionBy("cand").orderBy("t").rowsBetween(0, width - 1)
    both = cand.select("cand", "y", "x").join(cube, ["y", "x"])
    return both.select("cand", "t", "flux", F.when(F.count("flux").over(w) == width, F.avg("flux").over(w)).alias("smooth"))

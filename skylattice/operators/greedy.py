"""Order-dependent selection, settled tile by tile or as folds, and spatial maximum filters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def max_filter(df: DataFrame, before: int, after: int, by: list[str], value: str = "snr") -> DataFrame:
    """Adds `top`, the largest value in the box of `before` pixels before to `after` after, in y and x: two separable passes."""
    row = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(-before, after)
    col = Window.partitionBy(*by, "x").orderBy("y").rangeBetween(-before, after)
    return df.withColumn("top", F.max(value).over(row)).withColumn("top", F.max("top").over(col))


def local_maxima(snr: DataFrame, size: int, by: list[str], threshold: float) -> DataFrame:
    """Pixels at or over the threshold that no other in the size-wide window exceeds (an even window reaches one further back).

    The map must be dense: every pixel has a row, those under the threshold count as absent.
    """
    masked = snr.withColumn("snr", F.when(~F.isnan("snr") & (F.col("snr") >= threshold), F.col("snr")))
    return max_filter(masked, size // 2, size - 1 - size // 2, by).where(F.col("snr") >= F.col("top"))


def _fold(df: DataFrame, by: list[str], item: Column, kept_type: str, step) -> DataFrame:
    zero = F.array().cast(f"array<{kept_type}>")
    src = df.groupBy(*by) if by else df.groupBy(F.lit(0).alias("all"))
    return src.agg(F.array_sort(F.collect_list(item)).alias("items")).select(*by, F.inline(F.aggregate("items", zero, step)))


TILE = 128  # pixels a side, and TILE_TIMES samples, of the tiles that are settled in one task
TILE_TIMES = 64
UNKNOWN, KEPT, DROPPED = 0, 1, 2
ROUNDED = 6  # distinct times that rounding may put on the wrong side of a sum


def _settle_tile(pdf, axes: dict[str, int], rank: list[str], cap: tuple[str, int] | None):
    """States of a tile's candidates, as far as they follow from those in it.

    In the order of rank: who has a kept better one in reach (on all axes), or `cap` kept better ones of its own
    value of a column, is dropped; who has none, nor one that is still unknown, is kept.  Candidates of the margin
    (not `own`) have neighbours that aren't here, so they can be dropped, not kept.
    """
    import numpy as np

    order = np.lexsort([pdf[c].to_numpy() for c in reversed(rank)])
    at = np.stack([pdf[c].to_numpy().astype(np.int64) for c in axes], 1)[order]
    own, state = pdf["own"].to_numpy()[order], pdf["state"].to_numpy()[order].astype(np.int64)
    reach = np.array(list(axes.values()))
    cells = at // (reach + 1)
    shifts = np.stack(np.meshgrid(*[[-1, 0, 1]] * len(axes), indexing="ij"), -1).reshape(-1, len(axes)).tolist()
    held: dict[tuple, list[int]] = {}
    counts: dict[int, list[int]] = {}
    group = pdf[cap[0]].to_numpy()[order].tolist() if cap else None
    places, cells, reach = at.tolist(), cells.tolist(), reach.tolist()
    for i, (place, cell) in enumerate(zip(places, cells, strict=True)):
        if state[i] == UNKNOWN:
            near, doubt = False, not own[i]
            for shift in shifts:
                for j in held.get(tuple(c + d for c, d in zip(cell, shift, strict=True)), ()):
                    if all(abs(a - b) <= r for a, b, r in zip(place, places[j], reach, strict=True)):
                        near, doubt = near or state[j] == KEPT, True
            kept, open_ = counts.get(group[i], (0, 0)) if cap else (0, 0)
            if near or cap and kept >= cap[1]:
                state[i] = DROPPED
            elif not doubt and (not cap or kept + open_ < cap[1]):
                state[i] = KEPT
        if state[i] != DROPPED:
            held.setdefault(tuple(cell), []).append(i)
            if cap:
                counts.setdefault(group[i], [0, 0])[int(state[i] == UNKNOWN)] += 1
    out = pdf.iloc[order].assign(state=state)
    return out[out["own"]]


def greedy(df: DataFrame, by: list[str], axes: dict[str, int], rank: list[str], cap: tuple[str, int] | None = None, tiles: dict[str, int] | None = None) -> DataFrame:
    """The candidates that a walk in the order of rank keeps: none lies in reach, on every axis, of a better one that is kept.

    axes: how far a candidate reaches along each column; cap: (column, most kept of one value of it).  Tiles of
    the axes, with a margin of their reach, are settled side by side; what hangs on a candidate of another tile
    waits for its state in the next round.  A round settles at least the best of those open, chains within a
    tile whole, so rounds are as many as a chain crosses tiles.  No task holds more than a tile; with a cap, tiles
    are cut along its column alone, so that all of one value are in one.
    """
    tiles = {c: n for c, n in (tiles or {c: TILE_TIMES if c == "c" else TILE for c in axes}).items() if not cap or c == cap[0]}
    cols, now = df.columns, df.withColumn("state", F.lit(UNKNOWN).cast("long"))
    names = now.columns

    def tile(pdf):
        return _settle_tile(pdf, axes, rank, cap)[names]

    while True:
        spread, own = now, F.lit(True)
        for c, size in tiles.items():
            span = F.sequence(F.floor((F.col(c) - axes[c]) / size), F.floor((F.col(c) + axes[c]) / size))
            spread, own = spread.withColumn(f"__{c}", F.explode(span)), own & (F.col(f"__{c}") == F.floor(F.col(c) / size))
        spread = spread.withColumn("own", own)
        now = settled(spread.groupBy(*by, *(f"__{c}" for c in tiles)).applyInPandas(tile, now.schema))
        if now.where(F.col("state") == UNKNOWN).isEmpty():
            return now.where(F.col("state") == KEPT).select(*cols)


def nms_2d(peaks: DataFrame, radius: int, by: list[str] = ()) -> DataFrame:
    """Peaks in order of S/N that lie in no box of a kept one: (by..., y, x, snr).

    Peaks that are not `clear` (where there is that column) neither stay nor suppress.
    """
    peaks = peaks.where("clear") if "clear" in peaks.columns else peaks
    rows = peaks.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("snr").cast("double").alias("snr"), (-F.col("snr").cast("double")).alias("__o"))
    return greedy(rows, list(by), {"y": radius, "x": radius}, ["__o", "y", "x"]).drop("__o")


def group_widths(det: DataFrame, radius: int, time_radius: int, policy: str = "max_snr", max_per_centre: int | None = None, by: list[str] = ()) -> DataFrame:
    """Detections of all widths, best first by policy, dropping what lies within a kept one's box and twice the time radius; those not `clear` (where there is that column) go first."""
    det = det.where("clear") if "clear" in det.columns else det
    first = {"max_snr": F.lit(0), "prefer_short": F.col("width"), "prefer_long": -F.col("width")}[policy].cast("long")
    cols = ["c", "y", "x", "width"]
    rows = det.select(*by, *(F.col(c).cast("long").alias(c) for c in cols), F.col("snr").cast("double").alias("snr"), first.alias("__p"), (-F.col("snr").cast("double")).alias("__o"))
    cap = ("c", max_per_centre) if max_per_centre is not None else None
    return greedy(rows, list(by), {"c": 2 * time_radius, "y": radius, "x": radius}, ["__p", "__o", *cols], cap).drop("__p", "__o")


def nms_per_width(snr: DataFrame, radius: int, time_radius: int, threshold: float, by: list[str] = ("width",)) -> DataFrame:
    """Frame by frame in time order: the frame's local maxima among pixels that no earlier peak suppresses.

    A peak of frame s suppresses its box in frames up to s + time_radius, and a frame looks time_radius
    back, so an earlier peak reaches 2 * time_radius frames.  All local maxima of a frame are kept, but those
    whose window is not `clear` (where there is that column): they are maxima of their frame, and then go without effect.
    Only pixels over the threshold enter the fold, so its arrays stay small.
    """
    lo, hi = radius // 2, radius - 1 - radius // 2
    over = snr.where(~F.isnan("snr") & (F.col("snr") >= threshold))
    clear = F.col("clear") if "clear" in snr.columns else F.lit(True)
    px = F.struct(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("snr").cast("double").alias("snr"), clear.alias("clear"))
    frames = over.groupBy(*by, F.col("t").cast("long").alias("t")).agg(F.array_sort(F.collect_list(px)).alias("px"))

    def step(kept, f):
        free = F.filter(f["px"], lambda p: ~F.exists(kept, lambda k: (k["t"] >= f["t"] - 2 * time_radius) & (k["t"] < f["t"]) & (F.abs(k["y"] - p["y"]) <= radius) & (F.abs(k["x"] - p["x"]) <= radius) & F.lit(time_radius > 0)))
        best = F.filter(free, lambda p: ~F.exists(free, lambda q: (q["y"] - p["y"]).between(-lo, hi) & (q["x"] - p["x"]).between(-lo, hi) & (q["snr"] > p["snr"])))
        return F.concat(kept, F.transform(F.filter(best, lambda p: p["clear"]), lambda p: F.struct(f["t"].alias("t"), p["y"].alias("y"), p["x"].alias("x"), p["snr"].alias("snr"))))

    return _fold(frames, list(by), F.struct("t", "px"), "struct<t:bigint,y:bigint,x:bigint,snr:double>", step)


def anchored_groups(df: DataFrame, time: str, tolerance: float, by: list[str]) -> DataFrame:
    """Adds `grp`: rows in time order, a group lasting while the time is within tolerance of the group's first.

    Not a session window, which would chain.  A gap over the tolerance starts a group whatever came before, so
    the times between two such gaps are an island of their own.  An island no longer than the tolerance is one
    group; in others each time points at the first time beyond its tolerance, and the groups' first times are
    those that pointers lead to from the island's first: pointers are doubled, so rounds are the logarithm of
    an island's groups.
    """
    by, at, row = list(by), F.col("__at"), Window.unboundedPreceding
    times = df.select(*by, F.col(time).alias("__at")).distinct()
    order = Window.partitionBy(*by).orderBy("__at")
    gap = at - F.lag("__at").over(order)
    isles = times.withColumn("__isle", F.sum((gap.isNull() | (gap > tolerance)).cast("long")).over(order.rowsBetween(row, 0)))
    own = Window.partitionBy(*by, "__isle")
    isles = settled(isles.withColumns({"__first": F.min("__at").over(own), "__long": F.max("__at").over(own) - F.min("__at").over(own) > tolerance}))
    firsts = isles.where(at == F.col("__first")).select(*by, "__isle", "__at")
    wide = isles.where("__long")
    if not wide.isEmpty():
        # Each time asks for the first whose distance is over the tolerance: askers and times in one order, from the
        # last on.  Sums round otherwise than differences, so an asker stands a little before and is told of several.
        ahead = Window.partitionBy(*by, "__isle").orderBy("__at")
        told = wide.withColumn("__to", F.array(*(F.lead("__at", k).over(ahead) for k in range(ROUNDED))))
        when = at + tolerance - (F.abs(at) + tolerance) * 4.5e-16
        asks = told.select(*by, "__isle", when.cast("double").alias("__when"), F.lit(1).alias("__kind"), at.alias("__from"), F.lit(None).cast(told.schema["__to"].dataType).alias("__to"))
        tells = told.select(*by, "__isle", at.cast("double").alias("__when"), F.lit(0).alias("__kind"), F.lit(None).cast(told.schema["__at"].dataType).alias("__from"), "__to")
        back = Window.partitionBy(*by, "__isle").orderBy(F.desc("__when"), "__kind").rowsBetween(row, 0)
        steps = asks.unionAll(tells).withColumn("__to", F.last("__to", True).over(back)).where("__kind = 1")
        steps = steps.withColumn("__to", F.get(F.filter("__to", lambda x: x - F.col("__from") > tolerance), F.lit(0))).where("__to is not null").select(*by, "__isle", "__from", "__to")
        keys = [*by, "__isle"]
        steps, reached = settled(steps), firsts
        while not steps.isEmpty():
            reached = settled(reached.unionAll(_led(reached, steps, keys)).distinct())
            then = steps.select(*keys, F.col("__from").alias("__to"), F.col("__to").alias("__then"))
            steps = settled(_same(steps, then, [*keys, "__to"]).select(*keys, "__from", F.col("__then").alias("__to")))
        firsts = reached
    began = _same(times, firsts.select(*by, "__at", F.lit(1).alias("__new")), [*by, "__at"], "left")
    grouped = settled(began.select(*by, "__at", (F.count("__new").over(order.rowsBetween(row, 0)) - 1).alias("grp")))
    return _same(df, grouped.withColumnRenamed("__at", time), [*by, time])


def _led(reached: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Where the reached times' pointers lead."""
    on = steps.withColumnRenamed("__from", "__at")
    return _same(reached, on, [*keys, "__at"]).select(*keys, F.col("__to").alias("__at"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys of which null equals null."""
    other = b.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return a.join(other, on, how).drop(*(f"__r{i}" for i in range(len(keys))))

"""Visibilities to images: weights, collapses of correlations, direct Fourier sums; large images are gridded (see gridding).

Rows are (t, row, chan, corr, u, v, w, re, im, flag, weight), w where the w term counts.  Direct sums cost visibilities times
pixels.  The phase of a pixel is a product of one along x and one along y, so a block of visibilities
makes its share of an image as a product of two matrices; a task adds up the shares of its rows and hands
on partial images, so visibilities are never shuffled and the grid is no part of the plan.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gridding import gridded_image

CELL = ["t", "row", "chan"]
# Codes of correlations.
CORRELATIONS = {5: "RR", 6: "RL", 7: "LR", 8: "LL", 9: "XX", 10: "XY", 11: "YX", 12: "YY"}


def correlation_label(code):
    known = F.create_map(*(F.lit(x) for kv in CORRELATIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, code), code.cast("string"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table, if it has these columns; says which it lacks."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"no column {', '.join(lost)}; there are {', '.join(df.columns)}")
    return df


def weight_source(vis: DataFrame) -> DataFrame:
    """`weight` from weight_spectrum where the table has that column, a channel's own, else as it is, a row's."""
    return vis.withColumn("weight", F.col("weight_spectrum")).drop("weight_spectrum") if "weight_spectrum" in vis.columns else require_columns(vis, "weight")


def uv_wavelengths(vis: DataFrame, channels: DataFrame) -> DataFrame:
    """u, v, w from metres to wavelengths of each row's channel: channels is (chan, wavelength_m), one row a channel of the one spectral window."""
    both = vis.join(F.broadcast(channels.select("chan", "wavelength_m")), "chan")
    return both.withColumns({c: F.col(c) / F.col("wavelength_m") for c in ("u", "v", "w") if c in vis.columns}).drop("wavelength_m")


def channel_range(vis: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Channels start to stop - 1, all to the end without stop."""
    return vis.where((F.col("chan") >= start) & (F.lit(True) if stop is None else F.col("chan") < stop))


def flag_weights(vis: DataFrame) -> DataFrame:
    """Flagged samples weigh nothing."""
    return vis.withColumn("weight", F.when(F.col("flag"), 0.0).otherwise(F.col("weight").cast("double")))


def _place(vis: DataFrame) -> list[str]:
    """The columns of a row's place: (u, v), and w where there is one."""
    return [c for c in ("u", "v", "w") if c in vis.columns]


def average_correlations(vis: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weighted means over correlations; 0 without weight."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum("weight")), F.lit(0.0))
    return vis.groupBy(*by, *CELL, *_place(vis)).agg(mean("re").alias("re"), mean("im").alias("im"), F.sum("weight").alias("weight"))


def single_correlation(vis: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Rows of one correlation; a label that the table lacks is an error."""
    if not vis.where(F.col("corr") == label).limit(1).count():
        raise ValueError(f"no correlation {label}")
    return vis.where(F.col("corr") == label).select(*by, *CELL, *_place(vis), "re", "im", "weight")


def indexed_correlation(vis: DataFrame, index: int = 0, labels: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """Rows of the correlation at a place in the table's order of labels (sorted where it isn't given)."""
    names = labels if labels is not None else sorted(r[0] for r in vis.select("corr").distinct().collect())
    if not 0 <= index < len(names):
        raise ValueError(f"no correlation {index} of {names}")
    return vis.where(F.col("corr") == names[index]).select(*by, *CELL, *_place(vis), "re", "im", "weight")


def stokes_i(vis: DataFrame, basis: str = "auto", present: tuple[str, ...] = ("XX", "YY"), by: list[str] = ()) -> DataFrame:
    """Mean of the two parallel hands that are there; weight 4/(1/w1 + 1/w2), or the one present."""
    pair = {"linear": ("XX", "YY"), "circular": ("RR", "LL")}
    if basis == "auto":
        basis = "linear" if set(pair["linear"]) & set(present) else "circular"
    a, b = pair[basis]
    if not {a, b} & set(present):
        raise ValueError(f"no {basis} correlations")
    pick = lambda c, k: F.max(F.when(F.col("corr") == k, F.col(c)))
    wide = vis.where(F.col("corr").isin(a, b)).groupBy(*by, *CELL, *_place(vis)).agg(*(pick(c, k).alias(f"{c}_{k}") for c in ("re", "im", "weight") for k in (a, b)))
    mean = lambda c: F.when(F.col(f"{c}_{a}").isNotNull() & F.col(f"{c}_{b}").isNotNull(), (F.col(f"{c}_{a}") + F.col(f"{c}_{b}")) / 2).otherwise(F.coalesce(f"{c}_{a}", f"{c}_{b}"))
    both = F.coalesce(F.try_divide(4 * F.col(f"weight_{a}") * F.col(f"weight_{b}"), F.col(f"weight_{a}") + F.col(f"weight_{b}")), F.lit(0.0))
    weight = F.when(F.col(f"weight_{a}").isNotNull() & F.col(f"weight_{b}").isNotNull(), both).otherwise(F.coalesce(f"weight_{a}", f"weight_{b}"))
    return wide.select(*by, *CELL, *_place(vis), mean("re").alias("re"), mean("im").alias("im"), weight.alias("weight"))


def normalise_weights(vis: DataFrame, by: list[str] = ("t",)) -> DataFrame:
    """Weights over the largest of their frame; all 0 if the frame is flagged."""
    top = F.max("weight").over(Window.partitionBy(*by))
    return vis.withColumn("weight", F.when(top > 0, F.col("weight") / top).otherwise(0.0))


BLOCK_ROWS, HELD_IMAGES = 1024, 16


def dirty_image(vis: DataFrame, n: int, cell: float, by: list[str] = ("t",)) -> DataFrame:
    """(by..., y, x, flux): weighted adjoint Fourier sums over an n x n grid, over the number of weighted samples.

    A task holds HELD_IMAGES partial images at most: rows of one frame should lie together, as they do in
    tables written in time order, or partial images are many.
    """
    by = list(by)
    keys = vis.select(*by).schema
    schema = keys
    for name, kind in (("y", "long"), ("x", "long"), ("total", "double"), ("n", "long")):
        schema = schema.add(name, kind)
    at = (np.arange(n) - (n - 1) / 2) * cell * 2j * math.pi
    src = vis.where("weight > 0").select(*by, *(F.col(c).cast("double") for c in ("u", "v", "re", "im", "weight")))
    pixel = [pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n))]

    def run(batches):
        held: dict[tuple, list] = {}
        kinds: list = []

        def images():
            for key, (image, count) in held.items():
                cols = [pa.repeat(pa.scalar(v, k), n * n) for v, k in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *pixel, pa.array(image.ravel()), pa.array(np.full(n * n, count))], names=schema.names)
            held.clear()

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            frames = pa.table([batch.column(c) for c in by], names=by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(batch), np.int64)
            order = np.argsort(frames, kind="stable")
            groups = {tuple(batch.column(c)[int(r[0])].as_py() for c in by): r for r in np.split(order, np.flatnonzero(np.diff(frames[order])) + 1) if len(r)}
            u, v, re, im, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "re", "im", "weight"))
            for key, rows in groups.items():
                if key not in held and len(held) >= HELD_IMAGES:
                    yield from images()
                own = held.setdefault(key, [np.zeros((n, n)), 0])
                for a in range(0, len(rows), BLOCK_ROWS):
                    r = rows[a : a + BLOCK_ROWS]
                    across, down = np.exp(np.outer(u[r], at)), np.exp(np.outer(v[r], at)) * (weight[r] * (re[r] + 1j * im[r]))[:, None]
                    own[0] += (down.T @ across).real
                    own[1] += len(r)
        yield from images()

    parts = src.mapInArrow(run, schema)
    return parts.groupBy(*by, "y", "x").agg((F.sum("total") / F.sum("n")).alias("flux"))


GRIDDED_FROM = 32  # pixels a side


def image(vis: DataFrame, n: int, cell: float, by: list[str] = ("t",), w_term: bool = False, epsilon: float = 1e-6) -> DataFrame:
    """(by..., y, x, flux): by gridding from GRIDDED_FROM pixels a side on, or where the w term counts, else by direct sums."""
    if w_term or n >= GRIDDED_FROM:
        return gridded_image(vis, n, cell, by, w_term, epsilon)
    return dirty_image(vis, n, cell, by)


def frame_images(vis: DataFrame, n: int, cell: float, mode: str = "average", label: str = "XX", by: list[str] = ("t",), w_term: bool = False, epsilon: float = 1e-6) -> DataFrame:
    """Images of all frames from raw visibilities: weights, flags, one of the collapses (average, single, stokesI), weights over their frame's largest, Fourier sums."""
    vis = flag_weights(weight_source(require_columns(vis, *CELL, "corr", "u", "v", "re", "im", "flag")))
    more = [c for c in by if c not in CELL]
    if mode == "stokesI":
        flat = stokes_i(vis, present=tuple(r[0] for r in vis.select("corr").distinct().collect()), by=more)
    else:
        flat = single_correlation(vis, label, more) if mode == "single" else average_correlations(vis, more)
    return image(normalise_weights(flat, by), n, cell, by, w_term, epsilon)

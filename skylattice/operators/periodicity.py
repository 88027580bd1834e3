"""Periodicity: direct sums in frequency, stitching of blocks, power, harmonic sums, detection."""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robust import clipped_sigma, mad_sigma
from ..functions.sky import K_DM
from .cube import above, top_k


def block_spectrum(lc: DataFrame, nf: int, block: int) -> DataFrame:
    """(y, x, block, k, re, im): partial Fourier sums of blocks of time, phases from the block's start."""
    b = F.floor(F.col("t") / block).cast("long")
    src = lc.withColumn("block", b).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nf - 1).cast("long"))))
    phase = 2 * math.pi * F.col("k") * (F.col("t") - F.col("block") * block) / (2.0 * nf)
    return src.groupBy("y", "x", "block", "k").agg(F.sum(F.col("flux") * F.cos(phase)).alias("re"), F.sum(F.col("flux") * F.sin(phase)).alias("im"))


def adjoint_blocks(vis: DataFrame, npix: int, cell: float, dt: float, nf: int, fmin: float = 0.0, dm: float = 0.0, block_rows: int = 20_000, channels: tuple[int, int | None] = (0, None)) -> DataFrame:
    """(block, t0, y, x, k, re, im): partial adjoint transforms (u, v, t) -> (m, l, f) of blocks of rows in time order.

    vis: (time, u, v, freq_hz, re, im, flag) in seconds and wavelengths, and chan where a range of channels is
    asked for.  Times are less the dispersion delay of the row's channel, phases of t count from the block's
    first time t0.  Pixels are -npix // 2 and on, cell radians apart; bins are f = k / (nf dt) from fmin up to, not with, half of
    1 / dt.  A phase is a product of three, one an axis, so a block is a product of matrices.
    """
    df = 1.0 / (nf * dt)
    ks = np.arange(math.ceil(fmin / df - 1e-9), (nf + 1) // 2)
    grid = -2j * math.pi * cell * (np.arange(npix) - npix // 2)
    first, last = channels
    if first or last is not None:
        vis = vis.where((F.col("chan") >= first) & (F.lit(True) if last is None else F.col("chan") < last))
    src = vis.where("not flag").select(*(F.col(c).cast("double") for c in ("time", "u", "v", "freq_hz", "re", "im")))
    dealt = src.repartitionByRange("time").sortWithinPartitions("time", "u", "v", "freq_hz")
    names = ["block", "t0", "y", "x", "k", "re", "im"]
    at = [x.ravel() for x in np.meshgrid(np.arange(npix), np.arange(npix), ks, indexing="ij")]

    def run(batches):
        part, block, held = TaskContext.get().partitionId(), 0, []

        def transform(rows: pa.Table):
            time, u, v, freq, re, im = (rows.column(c).to_numpy() for c in ("time", "u", "v", "freq_hz", "re", "im"))
            t = time - time[0] - K_DM * dm * 1e-3 / (freq * 1e-6) ** 2
            out = np.zeros((npix, npix * len(ks)), np.complex128)
            for a in range(0, len(rows), 256):
                r = slice(a, a + 256)
                tone = np.exp(2j * math.pi * df * np.outer(t[r], ks)) * (re[r] + 1j * im[r])[:, None]
                side = np.exp(np.outer(u[r], grid))
                out += np.exp(np.outer(v[r], grid)).T @ (side[:, :, None] * tone[:, None, :]).reshape(len(side), -1)
            out = out.ravel()
            many = len(out)
            return pa.RecordBatch.from_arrays([pa.array(np.full(many, (part << 32) + block)), pa.array(np.full(many, time[0])), *(pa.array(x) for x in at), pa.array(out.real.copy()), pa.array(out.imag.copy())], names=names)

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while len(rows) >= block_rows:
                yield transform(rows.slice(0, block_rows))
                rows, block = rows.slice(block_rows), block + 1
            held = rows.to_batches()
        if sum(map(len, held)):
            yield transform(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "block long, t0 double, y long, x long, k long, re double, im double")


def stitched(parts: DataFrame, nf: int, dt: float) -> DataFrame:
    """Blocks of adjoint_blocks turned by exp(+2 pi i f t0) and added: (y, x, k, re, im)."""
    turn = 2 * math.pi * F.col("k") / (nf * dt) * F.col("t0")
    re = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)
    im = F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
    return parts.groupBy("y", "x", "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def stitch(parts: DataFrame, nf: int, block: int) -> DataFrame:
    """Blocks turned by exp(+2 pi i f t0) and added: (y, x, k, re, im)."""
    turn = 2 * math.pi * F.col("k") * F.col("block") * block / (2.0 * nf)
    re = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)
    im = F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
    return parts.groupBy("y", "x", "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def power(spectrum: DataFrame) -> DataFrame:
    return spectrum.select("y", "x", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def frequencies(k: Column, nf: int, dt: float) -> Column:
    return k / (2.0 * nf * dt)


def harmonic_sum(cube: DataFrame, nharm: int, nf: int) -> DataFrame:
    """(y, x, h, k, power): sums over m = 1..h of bin m*k, for k < nf // h.

    A bin contributes to few sums, so each row is sent to the (h, k) it serves; bins are array places.
    """
    m = cube.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(nharm)))).where("k % m = 0").withColumn("base", F.expr("k div m"))
    hs = m.withColumn("h", F.explode(F.sequence(F.col("m"), F.lit(nharm)))).where(F.col("base") < F.floor(F.lit(nf) / F.col("h")))
    return hs.groupBy("y", "x", "h", F.col("base").alias("k")).agg(F.sum("power").alias("power"))


def periodicity(summed: DataFrame, threshold: float, nf: int, dt: float, estimator: str = "mad", clip: float = 3.0, keep: int | None = None) -> DataFrame:
    """Bins whose summed power over the map's spread reaches the threshold: (y, x, h, k, snr, f_hz, period_s); bin 0 has no period."""
    sigma = mad_sigma(summed, "power", ["h", "k"]) if estimator == "mad" else clipped_sigma(summed, "power", ["h", "k"], clip)
    snr = summed.where("k > 0").join(sigma, ["h", "k"]).select("y", "x", "h", "k", (F.col("power") / F.col("sigma")).alias("snr"))
    f = frequencies(F.col("k"), nf, dt)
    got = above(snr, threshold).withColumns({"f_hz": f, "period_s": 1 / f})
    return top_k(got, keep, ties=["h", "k", "y", "x"]) if keep else got


def best_frequency(cube: DataFrame) -> DataFrame:
    """(y, x, top, k): the largest power of a pixel and its bin, the first on a tie."""
    return cube.groupBy("y", "x").agg(F.max("power").alias("top"), F.max_by("k", F.struct("power", -F.col("k"))).alias("k"))

"""The searches composed: visibilities to images to candidates, and candidates to events, sources and observations.

Cubes of all chunks, scans and beams are one table; `by` names the columns that tell them apart.  A search
of a cube is one plan over it: nothing is written between its steps and no chunk is a job of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogues as K
from . import cube as C
from . import greedy as G
from . import imaging as I
from . import periodicity as P
from . import timeaxis as A
from .graph import settled
from .gridding import gridded_spectrum


@dataclass(frozen=True)
class Settings:
    """What a search takes; defaults are those of the command line."""

    npix: int = 384
    cell: float = 22 / 206265
    ra0: float = 0.0
    dec0: float = 0.0
    field_name: str = ""
    dt: float = 1.0
    t0: float = 0.0
    chunk: int = 512
    overlap: int = 0
    corr_mode: str = "single"
    single_pol: str = "XX"
    widths: list[int] = field(default_factory=lambda: [1, 2, 4, 8, 16, 32, 64])
    threshold: float = 8.0
    var_threshold: float = 8.0
    var_keep: int | None = None
    clip: float = 3.0
    radius: int = 6
    time_radius: int = 2
    group_time_radius: int = 8
    policy: str = "max_snr"
    max_per_centre: int | None = 1
    tau: float | None = None
    dedupe_overlap: bool = False
    cumulative: bool = False
    w_term: bool = False
    epsilon: float = 1e-6


def chunked(cube: DataFrame, size: int, overlap: int = 0, by: list[str] = ()) -> DataFrame:
    """The cube with a column `chunk`: frames of an overlap stand in both chunks."""
    axis = cube.select(*by, "t").distinct()
    parts = A.chunks(axis if by else axis.withColumn("all", F.lit(0)), size, overlap, "t", list(by) or ["all"])
    return cube.join(parts.select(*by, "t", "chunk"), [*by, "t"])


def variance_candidates(cube: DataFrame, s: Settings, by: list[str] = (), mask: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """(by..., y, x, snr, std, t): pixels whose spread in time stands out, the best of each neighbourhood, with the time of their peak.

    var_keep: so many pixels over the threshold, the best, lend their spread to the candidates; others have their S/N there.

    states: Welford states of the pixels (see final_states), where they are not the cube's own.  With the setting `cumulative`
    a chunk's spread is that of all samples up to its end, and its peak its own.
    """
    by = list(by)
    src = C.ema_highpass(cube, s.tau, [*by, *C.PIXEL], s.dt).withColumnRenamed("high", "flux") if s.tau else cube
    if states is None:
        states = C.welford(src, [*by, *C.PIXEL])
        if s.cumulative and "chunk" in by:
            states = C.welford_prefix(states, [c for c in by if c != "chunk"] + C.PIXEL)
    stds = states.select(*by, *C.PIXEL, C.welford_std(states).alias("std")).where("std is not null")
    snr = C.variance_snr(stds, "clipped_rms", s.clip, by=by, mask=mask).withColumn("snr", F.round("snr", 6))
    peaks = G.nms_2d(G.local_maxima(snr, s.radius, by, s.var_threshold), s.radius, by)
    if s.var_keep is not None:
        stds = C.top_k(C.above(snr, s.var_threshold), s.var_keep, by, ["y", "x"]).select(*by, *C.PIXEL, "std")
    peaks = peaks.join(stds, [*by, *C.PIXEL], "left").withColumn("std", F.coalesce("std", "snr"))
    return peaks.join(C.peak_time(cube, "peak_absdev", by), [*by, *C.PIXEL], "left")


def boxcar_candidates(cube: DataFrame, s: Settings, by: list[str] = (), mask: DataFrame | None = None) -> DataFrame:
    """(by..., t, y, x, width, snr, center_idx): windows of all widths that stand out in their frame, one of each neighbourhood in place, time and width."""
    by = list(by)
    snr = C.boxcar_snrs(C.subtract_mean(cube, by=by), s.widths, clip=s.clip, by=by, mask=mask, places=6)
    kept = G.nms_per_width(snr, s.radius, s.time_radius, s.threshold, [*by, "width"])
    centred = kept.withColumn("c", F.col("t") + F.expr("width div 2"))
    best = G.group_widths(centred, s.radius, s.group_time_radius, s.policy, s.max_per_centre, by)
    return best.select(*by, (F.col("c") - F.expr("width div 2")).alias("t"), "y", "x", "width", "snr", F.col("c").alias("center_idx"))


def tagged(found: DataFrame, s: Settings, by: list[str], kind: str) -> DataFrame:
    """Candidates with time tags, sky position and name, by the catalogue's column names."""
    if kind == "boxcar":
        got = C.time_tags(found, F.col("width"), s.t0, s.dt).withColumns({"width_samples": F.col("width"), "t0_idx": F.col("t"), "t1_idx_excl": F.col("t") + F.col("width")})
    else:  # the sample of the peak; all zero where a pixel has no good sample
        at = F.lit(s.t0) + F.col("t") * s.dt
        index, zero = F.coalesce("t", F.lit(0).cast("long")), F.lit(0.0)
        got = found.withColumns({"time_start": F.coalesce(at - s.dt / 2, zero), "time_end": F.coalesce(at + s.dt / 2, zero), "time_center": F.coalesce(at, zero), "duration": F.when(F.col("t").isNull(), 0.0).otherwise(F.lit(float(s.dt)))})
        got = got.withColumns({"center_idx": index, "t0_idx": index, "t1_idx_excl": F.when(F.col("t").isNull(), index).otherwise(index + 1), "width_samples": F.lit(1).cast("long")})
    sky = K.annotate(got, s.npix, s.npix, s.cell, s.cell, s.ra0, s.dec0, s.field_name)
    return sky.withColumn("kind", F.lit(kind)).drop("t", "width")


def search_cube(cube: DataFrame, s: Settings, by: list[str] = (), boxcar: bool = True, variance: bool = True, mask: DataFrame | None = None) -> DataFrame:
    """Candidates of both searches: (by..., kind, y, x, snr, ... of the catalogue)."""
    parts = [tagged(find(cube, s, by, mask), s, list(by), kind) for kind, find, on in (("boxcar", boxcar_candidates, boxcar), ("variance", variance_candidates, variance)) if on]
    found = K.union_by_name(*parts)
    if s.dedupe_overlap and "chunk" in by:  # a candidate of an overlap is found in both chunks: the earlier one keeps it
        keys = [c for c in by if c != "chunk"]
        found = found.withColumn("__rank", F.row_number().over(C.Window.partitionBy(*keys, "kind", *C.PIXEL, "center_idx", "width_samples", "time_center").orderBy("chunk"))).where("__rank = 1").drop("__rank")
    return found


def search(vis: DataFrame, s: Settings, by: list[str] = (), products=None, **what) -> DataFrame:
    """From visibilities (by..., t, row, chan, corr, u, v, re, im, flag, weight; w with the w term) to candidates, chunk by chunk.

    products: called with the images and the candidates, both settled, to write what else is wanted.
    """
    images = settled(I.frame_images(vis, s.npix, s.cell, s.corr_mode, s.single_pol, [*by, "t"], s.w_term, s.epsilon))
    found = search_cube(chunked(images, s.chunk, s.overlap, by), s, [*by, "chunk"], **what)
    if products:
        found = settled(found)
        products(images, found)
    return found


def final_states(cube: DataFrame, by: list[str] = ()) -> DataFrame:
    """Welford states of whole observations from those of their chunks: samples of overlaps count in both."""
    by = list(by)
    return C.welford_merge(C.welford(cube, [*by, "chunk", *C.PIXEL]), [*by, *C.PIXEL])


def final_variance(cube: DataFrame, s: Settings, by: list[str] = ()) -> DataFrame:
    """The variance search of whole observations, from the merged states of a chunked cube."""
    return tagged(variance_candidates(cube.drop("chunk").distinct(), s, by, states=final_states(cube, by)), s, list(by), "variance")


def periodic(vis: DataFrame, npix: int, cell: float, fmin: float = 0.5, dm: float = 0.0, nf: int | None = None, threshold: float = 7.0, nharm: int = 8, estimator: str = "clipped_rms", block_rows: int = 20_000, keep: int | None = None) -> DataFrame:
    """Periodicity candidates (y, x, snr, f_hz, period_s, nharm_used) of visibilities (time, u, v, freq_hz, re, im, flag)."""
    axis = vis.select("time").distinct()
    dt = A.cadence(axis).first().cadence
    if nf is None:
        many = axis.count()
        nf = 1 << max(0, many - 1).bit_length()
    if npix >= I.GRIDDED_FROM:
        spectrum = P.power(gridded_spectrum(vis, npix, cell, dt, nf, fmin, dm))
    else:
        spectrum = P.power(P.stitched(P.adjoint_blocks(vis, npix, cell, dt, nf, fmin, dm, block_rows), nf, dt))
    low = int(-(-fmin * nf * dt // 1))  # bins count from the first kept one, as harmonics of places do
    bins = (nf + 1) // 2 - low
    found = P.periodicity(P.harmonic_sum(settled(spectrum).withColumn("k", F.col("k") - low), nharm, bins), threshold, nf, dt, estimator, keep=keep)
    f = (F.col("k") + low) / (nf * dt)
    return found.withColumns({"f_hz": f, "period_s": 1 / f, "nharm_used": F.col("h").cast("long")}).drop("h")


# Aggregation


def event_table(det: DataFrame, tolerance: float, arcsec: float) -> DataFrame:
    """Events of detections (id, time, ra, dec, beam, scan, snr, width): near in time (anchored groups of a scan) and place."""
    grouped = G.anchored_groups(det, "time", tolerance, ["scan"]).withColumn("grp", F.concat_ws("/", "scan", F.col("grp").cast("string")))
    return settled(K.events(K.sky_components(grouped, arcsec, "grp")))


def numbered_events(events: DataFrame) -> DataFrame:
    return K.number(events, "event_id", "time", "ra", "dec").drop("component")


def source_table(events: DataFrame, arcsec: float) -> DataFrame:
    """Sources of numbered events, through all time, the strongest first."""
    clustered = K.sky_components(events.withColumn("id", F.col("event_id")), arcsec)
    return K.number(K.sources(clustered).drop("component"), "source_id", F.desc("max_snr"), "ra", "dec")


def scan_sources(events: DataFrame, arcsec: float) -> DataFrame:
    """Sources of each scan apart, with ids."""
    per_scan = K.sky_components(events.withColumns({"id": F.col("event_id"), "scan": F.col("scan_ids")}), arcsec, "scan")
    found = K.sources(per_scan.withColumn("component", F.struct("scan", "component")))
    return settled(found.withColumns({"scan": F.col("component.scan"), "id": F.col("component.component")}).drop("component"))


def observation_table(supers: DataFrame, arcsec: float, catalogues: list[tuple[str, DataFrame]] = (), radius: float = 10.0) -> DataFrame:
    """Sources of all scans, matched with catalogues (src_name, ra, dec) in the order given."""
    found = K.observations(K.sky_components(supers, arcsec)).withColumnRenamed("component", "id")
    if catalogues:
        found = settled(found)
        found = found.join(K.crossmatch(found.select("id", "ra", "dec"), list(catalogues), radius), "id")
    return found

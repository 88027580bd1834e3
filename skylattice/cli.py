"""Command line: search, consolidate, aggregate, aggregate_obs and periodicity over Parquet tables.

    python -m skylattice.cli search --vis VIS --out FOLDER [--by scan,beam] ...
    python -m skylattice.cli consolidate --inputs FOLDER... --out FOLDER
    python -m skylattice.cli aggregate --candidates FOLDER --out FOLDER ...
    python -m skylattice.cli aggregate_obs --events FOLDER --out FOLDER [--psr FILE] [--survey FILE] ...
    python -m skylattice.cli periodicity --vis VIS --out FOLDER ...
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sky
from .operators import catalogues as K
from .operators import cube as C
from .operators import search as S
from .operators import timeaxis as A
from .sources import fits, readers, snapshots, writers

SEXAGESIMAL_RAD = 206265  # fixed value: arc seconds of a radian, as the pixel size has it


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skylattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("search", help="visibilities to candidates")
    p.add_argument("--vis", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--by", help="columns that tell observations apart, by commas; without it the scan, where the table has one")
    p.add_argument("--spw", help="(chan, freq_hz); with it and --pol the table is in metres and has numbers for correlations")
    p.add_argument("--pol", help="(corr, code)")
    p.add_argument("--fields", help="(name, ra0_rad, dec0_rad): the phase centre, of --field or of the first")
    p.add_argument("--epsilon", type=float, default=1e-6)
    p.add_argument("--wgridding", action=argparse.BooleanOptionalAction, default=True, help="the w term, where the table has w")
    p.add_argument("--chunk-size", type=int, default=512)
    p.add_argument("--overlap-seconds", type=float, default=10.0)
    p.add_argument("--corr-mode", choices=["average", "single", "stokesI"], default="single")
    p.add_argument("--single-pol", default="XX")
    p.add_argument("--npix", type=int, default=384)
    p.add_argument("--pixsize-arcsec", type=float, default=22.0)
    p.add_argument("--ra-deg", type=float, default=0.0)
    p.add_argument("--dec-deg", type=float, default=0.0)
    p.add_argument("--field", default="")
    p.add_argument("--start", type=float)
    p.add_argument("--end", type=float)
    p.add_argument("--boxcar-widths", type=int, nargs="+", default=[1, 2, 4, 8, 16, 32, 64])
    p.add_argument("--threshold-sigma", type=float, default=8.0)
    p.add_argument("--var-threshold-sigma", type=float, default=8.0)
    p.add_argument("--var-keep-top-k", type=int)
    p.add_argument("--var-highpass-cutoff", type=float, default=30.0, help="time constant in seconds of the mean taken off before the variance; 0 for none")
    p.add_argument("--rms-clip-sigma", type=float, default=3.0)
    p.add_argument("--nms-radius", type=int, default=6)
    p.add_argument("--boxcar", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--variance", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--cumulative-variance", action="store_true", help="a chunk's variance is that of all chunks up to it, as a search has it that goes on from one to the next")
    p.add_argument("--dedupe-overlap", action="store_true")
    p.add_argument("--votable", action="store_true")
    p.add_argument("--products", action="store_true", help="also maps of the spread in time (FITS), light curves, lines of text and a table a source")
    p = commands.add_parser("consolidate", help="catalogues of chunks to one table; the chunks' own go after the commit")
    p.add_argument("--inputs", required=True, nargs="+", help="Parquet folders")
    p.add_argument("--out", required=True)
    p.add_argument("--keep", action="store_true", help="leave the inputs")
    p = commands.add_parser("aggregate", help="candidates of beams to events and sources")
    p.add_argument("--candidates", required=True, help="a folder of candidate CSVs, or of Parquet")
    p.add_argument("--out", required=True)
    p.add_argument("--kind", choices=["boxcar", "variance"], default="boxcar")
    p.add_argument("--pattern", default="*.csv")
    p.add_argument("--time-tol", type=float, default=0.3)
    p.add_argument("--sky-tol-arcsec", type=float, default=35.0)
    p = commands.add_parser("aggregate_obs", help="events of all scans to the observation's sources")
    p.add_argument("--events", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--psr", help="a pulsar catalogue, columns apart by semicolons")
    p.add_argument("--survey", help="a survey's VOTable")
    p.add_argument("--sky-tol-arcsec", type=float, default=35.0)
    p.add_argument("--match-radius-arcsec", type=float, default=10.0)
    p = commands.add_parser("periodicity", help="visibilities to periodic candidates")
    p.add_argument("--vis", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--npix", type=int, default=384)
    p.add_argument("--pixsize-arcsec", type=float, default=22.0)
    p.add_argument("--ra-deg", type=float, default=0.0)
    p.add_argument("--dec-deg", type=float, default=0.0)
    p.add_argument("--fmin", type=float, default=0.5)
    p.add_argument("--dm", type=float, default=0.0)
    p.add_argument("--nfft-t", type=int)
    p.add_argument("--block-rows", type=int, default=20_000)
    p.add_argument("--threshold-sigma", type=float, default=7.0)
    p.add_argument("--nharm", type=int, default=8)
    p.add_argument("--spatial-estimator", choices=["mad", "clipped_rms"], default="clipped_rms")
    p.add_argument("--keep-top-k", type=int)
    return top


def run_search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Candidates as a catalogue, by kind; times become places on the time axis, in order."""
    vis = readers.visibilities(spark, a.vis, a.start, a.end)
    if bool(a.spw) != bool(a.pol):
        raise ValueError("--spw and --pol go together")
    if a.spw:
        vis = readers.search_rows(vis, spark.read.parquet(a.spw), spark.read.parquet(a.pol))
    centre = readers.phase_centre(spark.read.parquet(a.fields), a.field or None) if a.fields else (K.math.radians(a.ra_deg), K.math.radians(a.dec_deg), a.field)
    times = A.distinct_times(vis, "time", None).select("time")
    dt = A.time_bin(vis, "time").first().cadence
    first = times.agg(F.min("time").alias("t")).first().t or 0.0
    vis = vis.withColumn("t", F.round((F.col("time") - first) / dt).cast("long"))
    by = [c for c in ("scan" if a.by is None and "scan" in vis.columns else a.by or "").split(",") if c]
    s = S.Settings(
        npix=a.npix, cell=a.pixsize_arcsec / SEXAGESIMAL_RAD, ra0=centre[0], dec0=centre[1], field_name=centre[2], dt=dt, t0=first, chunk=a.chunk_size, overlap=int(a.overlap_seconds / dt), corr_mode=a.corr_mode, single_pol=a.single_pol,
        widths=a.boxcar_widths, threshold=a.threshold_sigma, var_threshold=a.var_threshold_sigma, var_keep=a.var_keep_top_k, clip=a.rms_clip_sigma, radius=a.nms_radius, tau=a.var_highpass_cutoff / dt if a.var_highpass_cutoff else None, dedupe_overlap=a.dedupe_overlap, cumulative=a.cumulative_variance, w_term=a.wgridding and "w" in vis.columns, epsilon=a.epsilon,
    )
    found = S.settled(S.search(vis, s, by, boxcar=a.boxcar, variance=a.variance, products=(lambda images, own: search_products(images, own, s, by, a.out)) if a.products else None))
    for kind in ("boxcar", "variance"):
        own = found.where(F.col("kind") == kind)
        if "scan" in by:
            own = own.withColumn("scan_id", F.col("scan"))
        writers.catalogue(K.candidate_table(own), f"{a.out}/{kind}", vot=a.votable)
    return found


def search_products(images: DataFrame, found: DataFrame, s: S.Settings, by: list[str], out: str) -> None:
    """std/NAMES.fits of each observation with its world coordinates, and by kind light curves, summaries and sources of the candidates."""
    spark = images.sparkSession
    words = spark.range(1).select(sky.tangent_header(s.npix, s.npix, s.cell, s.cell, s.ra0, s.dec0).alias("h")).first().h.asDict()
    folder = fits.local_path(f"{out}/std")
    os.makedirs(folder, exist_ok=True)
    for row in images.select(*by).distinct().collect() if by else [()]:  # a file an observation
        own, name = images, "_".join(str(v) for v in row) or "all"
        for c, v in zip(by, row, strict=True):
            own = own.where(F.col(c).eqNullSafe(v))
        fits.write_fits(C.std_map(own).select("y", "x", F.col("std").alias("value")), f"{folder}/{name}.fits", s.npix, s.npix, header=words, fill=float("nan"))
    for kind in ("boxcar", "variance"):
        own = found.where(F.col("kind") == kind)
        table = K.candidate_table(own)
        writers.summaries(table, f"{out}/{kind}/summaries")
        writers.by_source(table, f"{out}/{kind}/sources")
        places = own.select(*by, "srcname", "y", "x").distinct()
        curves = images.join(places, [*by, *C.PIXEL]).select(*by, "srcname", (F.lit(s.t0) + F.col("t") * s.dt).alias("time"), "flux")
        writers.light_curves(curves, f"{out}/{kind}/light_curves")


def run_aggregate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Events and sources; beam and scan come from the files' names."""
    schema = ", ".join(f"{c} {k}" for c, k, _ in K.CANDIDATE)
    raw = readers.csv_catalogue(spark, f"{a.candidates}/{a.pattern}" if a.pattern else a.candidates, schema)
    named = raw.select("*", *(c.alias(f"file_{k}") for k, c in K.parse_name(F.col("file")).items())).where(F.col("file_kind") == a.kind)
    det = K.number(named, "id", "time_center", "ra_deg", "dec_deg", "snr").select(
        "id", F.col("time_center").alias("time"), F.col("ra_deg").alias("ra"), F.col("dec_deg").alias("dec"), F.coalesce("file_beam", F.lit("")).alias("beam"), F.coalesce("file_scan_id", F.lit("")).alias("scan"), "snr", F.col("width_samples").alias("width")
    )
    events = S.settled(S.numbered_events(S.event_table(det, a.time_tol, a.sky_tol_arcsec)))
    writers.catalogue(events.withColumn("snr_all", F.array_join(F.transform("snr_all", lambda x: F.format_string("%.2f", x)), ",")), f"{a.out}/events")
    found = S.source_table(events, a.sky_tol_arcsec)
    writers.catalogue(found, f"{a.out}/super_summary")
    return found


def run_aggregate_obs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The observation's sources with their matches, and region files."""
    events = spark.read.parquet(f"{a.events}/parquet")
    cats = []
    if a.psr:
        cats.append(("PSRCAT", readers.pulsar_csv(spark, a.psr)))
    if a.survey:
        cats.append(("RACS", readers.survey_catalogue(spark, a.survey)))
    cats = [(n, c.select("src_name", F.col("ra_deg").alias("ra"), F.col("dec_deg").alias("dec"))) for n, c in cats]
    found = S.observation_table(S.scan_sources(events, a.sky_tol_arcsec), a.sky_tol_arcsec, cats, a.match_radius_arcsec)
    if not cats:
        found = found.withColumns({"source_name": F.lit("unknown"), "source_offset_arcsec": F.lit(None).cast("double"), "source_catalog": F.lit("")})
    hms, dms = K.sexagesimal(F.radians("ra"), F.radians("dec"))
    found = K.number(found.drop("id").withColumn("srcname", K.source_name(hms, dms)), "source_id", F.desc("max_snr"), "ra", "dec")
    writers.catalogue(found, f"{a.out}/observation")
    marks = found.select("ra", "dec", K.region_label(F.col("srcname"), F.col("max_snr"), F.col("source_name")).alias("label"))
    writers.regions(marks, f"{a.out}/regions_ds9", writers.MARK_ARCSEC, head=True)
    writers.annotations(marks, f"{a.out}/regions_kvis", writers.MARK_ARCSEC, head=True)
    return found


def run_periodicity(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = S.periodic(readers.visibilities(spark, a.vis), a.npix, a.pixsize_arcsec / SEXAGESIMAL_RAD, a.fmin, a.dm, a.nfft_t, a.threshold_sigma, a.nharm, a.spatial_estimator, a.block_rows, a.keep_top_k)
    sky = K.annotate(found, a.npix, a.npix, a.pixsize_arcsec / SEXAGESIMAL_RAD, a.pixsize_arcsec / SEXAGESIMAL_RAD, K.math.radians(a.ra_deg), K.math.radians(a.dec_deg))
    table = K.candidate_table(sky, K.PERIODICITY)
    writers.catalogue(table, f"{a.out}/periodicity")
    return table


def run_consolidate(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return snapshots.consolidate(spark, a.inputs, a.out, delete=not a.keep)


RUN = {"search": run_search, "consolidate": run_consolidate, "aggregate": run_aggregate, "aggregate_obs": run_aggregate_obs, "periodicity": run_periodicity}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"skylattice {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return RUN[a.command](spark, a)


if __name__ == "__main__":
    main()

"""Gridded images and spectra against direct sums; the search on the layout that the reader declares."""

import math

import numpy as np
import pytest

from skylattice.operators import gridding as G
from skylattice.operators import imaging as I
from skylattice.operators import periodicity as P
from skylattice.sources import fits, readers

VIS = "t long, u double, v double, w double, re double, im double, weight double"


def visibilities(seed, many=300):
    rng = np.random.default_rng(seed)
    return [(int(t), *map(float, x), float(g)) for t, x, g in zip(rng.integers(0, 3, many), np.c_[rng.normal(0, 300, (many, 2)), rng.normal(0, 200, many), rng.normal(size=(many, 2))], rng.random(many), strict=True)]


def image_of(df, n, by=()):
    got = df.toPandas().sort_values([*by, "y", "x"])
    return got.flux.to_numpy().reshape(-1, n, n)


@pytest.mark.parametrize("epsilon", [1e-4, 1e-6, 1e-12])
def test_gridded_image_is_the_direct_sum(spark, epsilon):
    df = spark.createDataFrame(visibilities(1), VIS)
    for by in (["t"], []):
        got, want = image_of(G.gridded_image(df, 24, 0.004, by, epsilon=epsilon), 24, by), image_of(I.dirty_image(df, 24, 0.004, by), 24, by)
        assert np.abs(got - want).max() <= epsilon


def test_gridded_image_with_the_w_term(spark):
    rows, n, cell, c = visibilities(2), 20, 0.006, 10.0
    got = image_of(G.gridded_image(spark.createDataFrame(rows, VIS), n, cell, ["t"], w_term=True, epsilon=1e-9, centre=c), n, ["t"])
    l, m = np.meshgrid((np.arange(n) - c) * cell, (np.arange(n) - c) * cell)
    bent = np.sqrt(1 - l * l - m * m) - 1
    for t in range(3):
        own = [r for r in rows if r[0] == t]
        want = sum((r[6] * (r[4] + 1j * r[5]) * np.exp(2j * math.pi * (r[1] * l + r[2] * m - r[3] * bent))).real for r in own) / (1 + bent) / len(own)
        assert np.abs(got[t] - want).max() < 1e-8


def test_tiles_that_are_given_out_early_add_up(spark, monkeypatch):
    """A task that may hold next to nothing hands on many partial tiles; null and repeated frames are frames of their own."""
    df = spark.createDataFrame(visibilities(3), VIS)
    want = image_of(G.gridded_image(df, 24, 0.004), 24, ["t"])
    monkeypatch.setattr(G, "HELD_BYTES", 1)
    monkeypatch.setattr(G, "CHUNK_ROWS", 7)
    monkeypatch.setattr(G, "CHUNK_BYTES", 1)
    assert np.abs(image_of(G.gridded_image(df, 24, 0.004), 24, ["t"]) - want).max() < 1e-12
    odd = spark.createDataFrame([(None, 1.0, 2.0, 0.0, 1.0, 0.0, 1.0), (None, 1.0, 2.0, 0.0, 1.0, 0.0, 1.0), (1, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0)], VIS)
    got = G.gridded_image(odd, 4, 0.01, epsilon=1e-10).toPandas()
    assert len(got) == 16 and got.t.isna().all()
    assert G.gridded_image(df.limit(0), 4, 0.01).count() == 0


@pytest.mark.parametrize("held", [1, 96 << 20])
def test_gridded_spectrum_is_the_direct_sum(spark, monkeypatch, held):
    monkeypatch.setattr(G, "HELD_BYTES", held)
    rng, many = np.random.default_rng(4), 300
    rows = [(float(1e5 + a), float(u), float(v), float(1e9 + f), float(x), float(y), bool(g < 0.1)) for a, u, v, f, x, y, g in zip(rng.random(many) * 100, *rng.normal(0, 30, (2, many)), rng.random(many) * 1e8, *rng.normal(size=(2, many)), rng.random(many), strict=True)]
    vis = spark.createDataFrame(rows, "time double, u double, v double, freq_hz double, re double, im double, flag boolean")
    order = ["y", "x", "k"]
    got = G.gridded_spectrum(vis, 7, 0.01, 0.5, 32, 0.1, 50.0, 1e-9).toPandas().sort_values(order)
    want = P.stitched(P.adjoint_blocks(vis, 7, 0.01, 0.5, 32, 0.1, 50.0), 32, 0.5).toPandas().sort_values(order)
    assert got[order].to_numpy().tolist() == want[order].to_numpy().tolist()
    assert np.abs(got[["re", "im"]].to_numpy() - want[["re", "im"]].to_numpy()).max() < 1e-6
    assert G.gridded_spectrum(vis.limit(0), 7, 0.01, 0.5, 32).count() == 0


DECLARED = readers.VISIBILITY


def declared(seed=5, scans=(1, 2)):
    """Two scans, two correlations by number, two channels, metres; a pulse of source (0, 0) in the second scan."""
    rng, rows = np.random.default_rng(seed), []
    for scan in scans:
        for t in range(24):
            for u in range(-9, 10, 3):
                for v in range(-9, 10, 3):
                    for chan in range(2):
                        for corr in range(2):
                            flux = 40.0 if scan == 2 and 10 <= t < 12 else 0.0
                            noise = rng.normal(0, 1, 2).tolist()
                            rows.append((1000.0 * scan + t * 0.5, scan, 0.5, u * 0.3, v * 0.3, 0.1 * u, chan, corr, flux + noise[0], noise[1], False, False, 1.0))
    return rows


def test_search_of_the_declared_layout(spark, tmp_path):
    from skylattice import cli

    spark.createDataFrame(declared(), DECLARED).write.parquet(str(tmp_path / "vis"))
    spark.createDataFrame([(0, 9.0e8), (1, 9.1e8)], "chan int, freq_hz double").write.parquet(str(tmp_path / "spw"))
    spark.createDataFrame([(0, 9), (1, 12)], "corr int, code int").write.parquet(str(tmp_path / "pol"))
    spark.createDataFrame([("other", 1.0, 0.1), ("mine", 2.0, -0.5)], "name string, ra0_rad double, dec0_rad double").write.parquet(str(tmp_path / "fields"))
    given = {k: str(tmp_path / k) for k in ("vis", "spw", "pol", "fields")}
    base = [x for k, v in given.items() for x in (f"--{k}", v)]
    own = ["--field", "mine", "--npix", "8", "--pixsize-arcsec", str(0.02 * 206265), "--chunk-size", "16", "--overlap-seconds", "2", "--boxcar-widths", "1", "2", "4", "--threshold-sigma", "4", "--var-threshold-sigma", "2", "--nms-radius", "3"]
    for mode in ("single", "stokesI"):
        found = cli.main(["search", *base, "--out", str(tmp_path / mode), "--corr-mode", mode, *own, *(["--products"] if mode == "stokesI" else [])], spark)
        best = found.where("kind = 'boxcar'").orderBy("snr", ascending=False).first()
        assert best.scan == 2 and best["chunk"] is not None and abs(best.time_center - 2005.25) <= 1.0
        assert found.where("kind = 'boxcar' and scan = 1 and snr > 8").count() == 0
        if mode == "stokesI":
            head, _ = fits.read_header(str(tmp_path / mode / "std/2.fits"))
            assert head["NAXIS1"] == 8 and head["CRVAL1"] == pytest.approx(math.degrees(2.0)) and fits.read_fits(spark, str(tmp_path / mode / "std/2.fits")).count() == 64
            curve = spark.read.parquet(str(tmp_path / mode / "boxcar/light_curves")).where(f"srcname = '{best.srcname}' and scan = 2")
            assert curve.count() == 24 and abs(curve.orderBy("flux", ascending=False).first().time - 2005.25) <= 1.0
            assert spark.read.text(str(tmp_path / mode / "boxcar/summaries")).count() == found.where("kind = 'boxcar'").count()
        row = spark.read.parquet(str(tmp_path / mode / "variance/parquet")).orderBy("snr", ascending=False).first()
        assert row.scan_id == 2 and row.t1_idx_excl == row.t0_idx + 1 == row.center_idx + 1 and row.duration == pytest.approx(0.5)
        assert row.time_end - row.time_start == pytest.approx(0.5) and row.phase_center_field == "mine"
        assert abs(math.radians(row.ra_deg) - 2.0) < 0.1
    with pytest.raises(ValueError, match="go together"):
        cli.main(["search", "--vis", given["vis"], "--spw", given["spw"], "--out", str(tmp_path / "x"), *own], spark)
    with pytest.raises(ValueError, match="no field"):
        readers.phase_centre(spark.read.parquet(given["fields"]), "none")


def test_rows_of_unknown_channels_and_windows_raise(spark):
    vis = spark.createDataFrame(declared(scans=(1,))[:8], DECLARED)
    spw, pol = spark.createDataFrame([(0, 9.0e8), (1, 9.1e8)], "chan int, freq_hz double"), spark.createDataFrame([(0, 9), (1, 5)], "corr int, code int")
    got = readers.search_rows(vis, spw, pol)
    first = got.where("chan = 0 and corr = 'XX'").first()
    assert first.u == pytest.approx(-2.7 * 9.0e8 / 299792458) and {r["corr"] for r in got.collect()} == {"XX", "RR"}
    for bad in ((spw.where("chan = 0"), pol), (spw, pol.where("corr = 0")), (spw.selectExpr("chan as spw", "chan", "freq_hz"), pol)):
        with pytest.raises(Exception, match="no channel|no known correlation|more than one spectral window"):
            readers.search_rows(vis, *bad).collect()
    with pytest.raises(ValueError, match="no column"):
        readers.search_rows(vis.drop("weight"), spw, pol)


def test_region_files_are_whole(spark, tmp_path):
    from skylattice.sources import writers

    marks = spark.createDataFrame([(150.0, -30.0, "a {b}"), (151.0, -31.0, "c")], "ra double, dec double, label string").coalesce(1)
    writers.regions(marks, str(tmp_path / "ds9"), writers.MARK_ARCSEC, head=True)
    writers.annotations(marks, str(tmp_path / "kvis"), writers.MARK_ARCSEC, head=True)
    lines = lambda name: next(p for p in (tmp_path / name).iterdir() if p.name.startswith("part") and p.stat().st_size).read_text().splitlines()
    assert lines("ds9")[:3] == writers.DS9_HEAD and '28.0"' in lines("ds9")[3]
    assert lines("kvis")[1] == "COORD W" and lines("kvis")[3].startswith("CIRCLE 150.000000 -30.000000 0.0077")

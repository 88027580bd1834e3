"""Hand-made cases and brute force: edges that the tables don't show."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import robust, sky
from skylattice.operators import catalogues as K
from skylattice.operators import cube as C
from skylattice.operators import greedy as G
from skylattice.operators import graph
from skylattice.operators import imaging as I
from skylattice.operators import periodicity as P
from skylattice.operators import search as E
from skylattice.operators import timeaxis as A
from skylattice.sources import readers, writers


def cube_of(spark, a):
    return spark.createDataFrame([(t, y, x, float(v)) for (t, y, x), v in np.ndenumerate(a)], "t long, y long, x long, flux double")


def test_constant_cube_has_no_detection(spark):
    c = C.subtract_mean(cube_of(spark, np.full((6, 3, 3), 5.0)))
    assert C.above(C.boxcar_snr(c, 2), 1.0).count() == 0


def test_injected_pulse_is_found(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(10, 1, (20, 5, 5))
    a[8:12, 2, 3] += 100
    got = C.multi_width(C.subtract_mean(cube_of(spark, a)), [1, 2, 4, 8])
    best = C.top_k(got, 1).first()
    assert (best.y, best.x) == (2, 3) and 8 <= best.t < 12
    # The spread differs from frame to frame, so the place of the pulse is where its own width sums most.
    most = got.where("width = 4").orderBy(F.desc("total")).first()
    assert (most.t, most.y, most.x) == (8, 2, 3)


def test_empty_frame_zeroes_its_windows(spark):
    a = np.random.default_rng(2).normal(10, 1, (8, 3, 3))
    a[4] = 0
    got = C.boxcar_snr(C.subtract_mean(cube_of(spark, a)), 2)
    assert {r.t for r in got.where("snr = 0").select("t").distinct().collect()} >= {3, 4}


def test_wide_window_gives_nothing(spark):
    assert C.boxcar_snr(C.subtract_mean(cube_of(spark, np.ones((3, 2, 2)))), 4).count() == 0


def test_nan_never_passes(spark):
    df = spark.createDataFrame([(0, 0, 0, float("nan")), (1, 0, 0, 9.0)], "t long, y long, x long, snr double")
    assert [r.t for r in C.above(df, 5.0).collect()] == [1]


def clip(vals, cumulative, sigma=3.0):
    vals = np.array(vals, float)
    mu = np.median(vals)
    s = 1.4826 * np.median(abs(vals - mu))
    if cumulative and s <= 0:
        return 1.0
    now = vals
    for _ in range(5):
        if s <= 0:
            break
        kept = (now if cumulative else vals)[abs((now if cumulative else vals) - mu) <= sigma * s]
        if not len(kept) or cumulative and len(kept) == len(now):
            break
        mu, s, now = kept.mean(), math.sqrt(((kept - kept.mean()) ** 2).sum() / max(1, len(kept) - 1)), kept
    return s if s > 0 else 1.0


@pytest.mark.parametrize("cumulative", [False, True])
@pytest.mark.parametrize("vals", [[1, 2, 3, 4, 5], [1, 1, 1, 1], [1, 2, 3, 4, 100], [7], [0, 1, 2, 3, 4, 5, 6, 50, 51, 900]])
def test_clipped_sigma(spark, vals, cumulative):
    df = spark.createDataFrame([(0, float(v)) for v in vals], "g int, v double")
    assert robust.clipped_sigma(df, "v", ["g"], cumulative=cumulative).first().sigma == pytest.approx(clip(vals, cumulative))


def test_welford_of_one_sample_has_no_spread(spark):
    m = C.welford_merge(C.welford(spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "k int, flux double"), ["k"]), ["k"])
    got = {r.k: r.s for r in m.select("k", C.welford_std(m).alias("s")).collect()}
    assert got[1] is None and got[2] == pytest.approx(math.sqrt(2))


def test_anchored_groups_are_no_sessions(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 0.2, 0.35, 0.6, 1.5)], "s string, t double")
    assert [r.grp for r in G.anchored_groups(df, "t", 0.3, ["s"]).orderBy("t").collect()] == [0, 0, 1, 1, 2]


def test_plateau_survives_maximum_but_not_greedy(spark):
    df = spark.createDataFrame([(0, y, x, 9.0 if (y, x) in ((1, 1), (1, 2)) else 0.0) for y in range(4) for x in range(4)], "t int, y int, x int, snr double")
    peaks = G.local_maxima(df, 3, ["t"], 5.0)
    assert peaks.count() == 2 and G.nms_2d(peaks, 1).count() == 1


def test_near_pairs_over_the_wrap_and_the_pole(spark):
    r = random.Random(3)
    spots = [(i, r.choice([0.001, 359.999, 180.0]) + r.random() * 0.01, r.choice([89.995, -89.99, 0.0]) + r.random() * 0.004) for i in range(60)]
    df = spark.createDataFrame(spots, "id long, ra double, dec double")
    got = {(x.a, x.b) for x in K.near_pairs(df, df, 20.0).collect()}

    def sep(p, q):
        u, v = (np.array([math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))]) for _, a, d in (p, q))
        return 2 * math.asin(min(1, np.linalg.norm(u - v) / 2)) * 180 / math.pi * 3600

    assert got == {(p[0], q[0]) for p in spots for q in spots if sep(p, q) <= 20.0}


def test_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, 10 + i * 30 / 3600, 0.0) for i in range(12)] + [(99, 50.0, 0.0)], "id long, ra double, dec double")
    got = {r.id: r.component for r in K.sky_components(df, 35.0).collect()}
    assert {got[i] for i in range(12)} == {0} and got[99] == 99


def test_crossmatch_falls_back(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 30.0, 0.0)], "id long, ra double, dec double")
    one = spark.createDataFrame([("A", 10.0, 0.0001)], "src_name string, ra double, dec double")
    two = spark.createDataFrame([("B", 10.0, 0.0), ("C", 20.0, 0.0)], "src_name string, ra double, dec double")
    got = {r.id: (r.source_name, r.source_catalog) for r in K.crossmatch(df, [("P", one), ("R", two)], 5.0).collect()}
    assert got == {1: ("A", "P"), 2: ("C", "R"), 3: ("unknown", "")}


def test_sexagesimal_carries(spark):
    df = spark.createDataFrame([(math.radians(15 * (23 + 59 / 60 + 59.97 / 3600)), math.radians(-(1 + 59 / 60 + 59.98 / 3600))), (-0.1, 0.0)], "ra double, dec double")
    got = df.select(*(c.alias(n) for c, n in zip(sky.sexagesimal(F.col("ra"), F.col("dec")), "hd", strict=True))).collect()
    assert (got[0].h, got[0].d) == ("00:00:00.0", "-02:00:00.0") and got[1].h.startswith("23:37:") and got[1].d == "+00:00:00.0"


def test_chunks_stop_at_the_scans_end(spark):
    axis = spark.createDataFrame([(t, 0 if t < 7 else 1) for t in range(10)], "time long, scan int")
    got = {(r.scan, r["first"], r["last"]) for r in A.chunk_bounds(axis, 3, 1).collect()}
    assert got == {(0, 0, 3), (0, 3, 6), (1, 7, 9)}


def test_pulsar_catalogue_skips_what_is_malformed(spark):
    raw = spark.createDataFrame([("J1", "01:00:00", "-10:30:00"), ("J2", "*", "1"), ("J3", "", "1"), ("J4", "xx:yy", "1")], "PSRJ string, RAJ string, DECJ string")
    assert [tuple(r) for r in readers.pulsar_catalogue(raw).collect()] == [("J1", 15.0, -10.5)]


def test_votable_and_sinks(spark, tmp_path):
    (tmp_path / "a.vot").write_text('<VOTABLE><RESOURCE><TABLE><FIELD name="Name"/><FIELD name="RA"/><DATA><TABLEDATA><TR><TD>s1</TD><TD>1.5</TD></TR><TR><TD>s2</TD><TD/></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>')
    got = readers.votable(spark, str(tmp_path / "a.vot"), "Name string, RA double, Dec double")
    assert [tuple(r) for r in got.orderBy("Name").collect()] == [("s1", 1.5, None), ("s2", None, None)]
    writers.catalogue(writers.to_sentinels(got), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/parquet")).orderBy("Name").collect()
    assert math.isnan(back[1].RA) and back[0].RA == 1.5
    writers.regions(spark.createDataFrame([(1.0, 2.0, "a{b}")], "ra double, dec double, label string"), str(tmp_path / "reg"))
    assert spark.read.text(str(tmp_path / "reg")).first().value == 'fk5; circle(1.000000,2.000000,20.0") # text={a(b)}'


def test_empty_catalogue_has_its_schema(spark):
    got = K.candidate_table(spark.createDataFrame([], "x long, snr double"))
    assert got.count() == 0 and len(got.columns) == 22


# Observations side by side


def two_beams(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(10, 1, (24, 6, 6)), rng.normal(50, 9, (18, 6, 6))
    a[5:9, 2, 3] += 40
    b[11:13, 4, 1] += 400
    rows = [(k, t + 3 * k, y, x, float(v)) for k, cube in enumerate((a, b)) for (t, y, x), v in np.ndenumerate(cube)]
    return spark.createDataFrame(rows, "beam int, t long, y long, x long, flux double")


SMALL = E.Settings(npix=6, cell=0.01, widths=[1, 2, 4], threshold=3.0, var_threshold=1.0, radius=3)


def test_two_observations_in_one_frame_give_what_each_gives_alone(spark):
    cubes = C.dense(two_beams(spark), ["beam"], empty=True)
    both = E.search_cube(cubes, SMALL, ["beam"])
    cols = ["kind", "y", "x", "snr", "width_samples", "t0_idx", "time_center", "srcname"]
    for k in (0, 1):
        alone = E.search_cube(C.dense(two_beams(spark).where(F.col("beam") == k).drop("beam"), empty=True), SMALL)
        got = sorted(map(str, both.where(F.col("beam") == k).select(*cols).collect()))
        assert got == sorted(map(str, alone.select(*cols).collect())) and len(got) > 1
    best = {r.beam: (r.y, r.x) for r in both.where("kind = 'variance'").orderBy("snr").collect()}
    assert best == {0: (2, 3), 1: (4, 1)}
    assert {(r.y, r.x) for r in both.where("kind = 'boxcar' and beam = 1 and snr > 6").collect()} == {(4, 1)}


def test_mask_and_empty_observations(spark):
    cube = C.dense(two_beams(spark), ["beam"])
    mask = cube.select("beam", "y", "x").distinct().withColumn("valid", ~((F.col("beam") == 0) & (F.col("y") == 2) & (F.col("x") == 3)))
    got = E.search_cube(cube, SMALL, ["beam"], mask=mask)
    assert not got.where("beam = 0 and y = 2 and x = 3").count() and got.where("beam = 1 and y = 4 and x = 1").count()
    clean = C.valid_only(cube, mask, ["beam"])
    assert clean.where("beam = 0 and y = 2 and x = 3").count() == 0 and clean.count() == cube.count() - 24
    assert E.search_cube(cube.limit(0), SMALL, ["beam"]).count() == 0
    assert C.dense(two_beams(spark).limit(0)).count() == 0


def test_zero_flux_windows_neither_stay_nor_suppress(spark):
    det = spark.createDataFrame([(0, 1, 1, 1, 9.0, False), (0, 2, 1, 1, 5.0, True), (0, 2, 4, 4, 7.0, False)], "c long, y long, x long, width long, snr double, clear boolean")
    assert [(r.y, r.snr) for r in G.group_widths(det, 2, 1).collect()] == [(2, 5.0)]
    assert [(r.y, r.snr) for r in G.nms_2d(det, 2).collect()] == [(2, 5.0)]
    snr = spark.createDataFrame([(1, 0, 1, 1, 9.0, False), (1, 0, 1, 2, 5.0, True), (1, 1, 1, 2, 4.0, True)], "width long, t long, y long, x long, snr double, clear boolean")
    # The zero-flux maximum hides its neighbour in its own frame, and has no effect later.
    assert [(r.t, r.x, r.snr) for r in G.nms_per_width(snr, 3, 2, 1.0).collect()] == [(1, 2, 4.0)]


def test_no_more_than_so_many_of_one_centre(spark):
    det = spark.createDataFrame([(5, 10 * k, 0, 1, 9.0 - k) for k in range(4)] + [(40, 0, 0, 1, 3.0)], "c long, y long, x long, width long, snr double")
    got = G.group_widths(det, 2, 1, max_per_centre=2)
    assert sorted((r.c, r.y) for r in got.collect()) == [(5, 0), (5, 10), (40, 0)]


def test_chunks_overlap_and_states_merge(spark):
    cube = C.dense(two_beams(spark), ["beam"])
    parts = graph.settled(E.chunked(cube, 10, 4, ["beam"]))
    assert parts.where("beam = 0").select("t", "chunk").distinct().count() == 14 + 14
    single = E.final_states(E.chunked(cube, 10, 0, ["beam"]), ["beam"])
    whole = C.welford(cube, ["beam", "y", "x"])
    a, b = ({(r.beam, r.y, r.x): (r.n, r.mean, r.m2) for r in d.collect()} for d in (single, whole))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1:] == pytest.approx(b[k][1:]) for k in a)
    found = E.final_variance(E.chunked(cube, 10, 0, ["beam"]), SMALL, ["beam"])
    assert {(r.beam, r.y, r.x) for r in found.collect()} >= {(0, 2, 3), (1, 4, 1)}
    twice = E.search_cube(parts, SMALL, ["beam", "chunk"], variance=False)
    once = E.search_cube(parts, E.Settings(**{**vars(SMALL), "dedupe_overlap": True}), ["beam", "chunk"], variance=False)
    assert once.count() == twice.select("beam", "y", "x", "center_idx", "width_samples").distinct().count() <= twice.count()


def plain_ema(ts, vs, tau, first, skip):
    mean = np.nanmean(vs)
    ema, last, out = mean, None, []
    for t, v in zip(ts, vs, strict=True):
        if skip and math.isnan(v):
            continue
        a = 1 - math.exp(-((t - last) if last is not None else first) / tau)
        ema, last = (1 - a) * ema + a * v, t
        out.append(v - ema)
    return out


@pytest.mark.parametrize("tau,skip", [(0.3, True), (5.0, True), (40.0, True), (5.0, False)])
def test_exponential_mean_is_the_recursion(spark, tau, skip):
    rng = np.random.default_rng(6)
    ts = np.cumsum(rng.integers(1, 60, 300))
    vs = rng.normal(1e4, 300, 300)
    vs[[4, 200]] = math.nan
    df = spark.createDataFrame([(0, 0, int(t), float(v)) for t, v in zip(ts, vs, strict=True)], "y long, x long, t long, flux double")
    got = [r.high for r in C.ema_highpass(df, tau, first_step=1.0, skip_nan=skip).orderBy("t").collect()]
    assert got == pytest.approx(plain_ema(ts, vs, tau, 1.0, skip), abs=1e-6, nan_ok=True)


def test_widths_in_samples():
    assert C.widths_in_samples([0.2, 2.5, 3.5, 7], 1.0) == [1, 2, 4, 7] and C.widths_in_samples([0, 1.9, 4]) == [1, 1, 4]


def test_peaks_by_flux_and_by_deviation(spark):
    a = np.full((5, 1, 1), 10.0)
    a[1], a[3] = 1.0, 14.0
    df = cube_of(spark, a)
    assert C.peak_time(df).first().t == 1 and C.peak_time(df, "peak_flux").first().t == 3
    assert {r.t: r["mean"] for r in C.frame_means(df).collect()}[3] == 14.0 and C.window_image(df, 1, 3).first().flux == 5.5


def test_smoothed_snippets_and_maps_at_the_edge(spark):
    a = np.arange(5 * 3 * 3, dtype=float).reshape(5, 3, 3)
    cand = spark.createDataFrame([(7, 3, 0, 2, 2)], "cand long, t long, y long, x long, width long")
    for pad in ("constant", "edge"):
        got = {(r.k, r.dy, r.dx): (r.flux, r.centre) for r in C.smoothed_snippets(cube_of(spark, a), cand, [1, 2], 3, 3, pad, -1.0).collect()}
        assert len(got) == 27 and got[0, 0, 0] == ((a[3, 0, 2] + a[4, 0, 2]) / 2, 4) and got[-1, 1, -1] == ((a[2, 1, 1] + a[3, 1, 1]) / 2, 3)
        assert got[1, 0, 0][0] == (-1.0 if pad == "constant" else got[0, 0, 0][0]) and got[0, -1, 1][0] == (-1.0 if pad == "constant" else got[0, 0, 0][0])
    left = C.smoothed_snippets(cube_of(spark, a), cand, [2], 1, 1, centre="left").first()
    assert left.centre == 3
    maps = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(3)], "y long, x long, std double")
    got = {(r.dy, r.dx): r.flux for r in C.map_snippets(maps, cand, 4).collect()}
    assert len(got) == 16 and got[0, 0] == 2.0 and got[-2, 1] == 2.0 and got[1, -2] == 10.0


# Images and spectra


def test_image_of_default_size_is_a_small_plan(spark):
    import time

    vis = spark.createDataFrame([(0, i, 0, 3.0 * i, -2.0 * i, 1.0, 0.5, 1.0) for i in range(20)], "t long, row long, chan long, u double, v double, re double, im double, weight double")
    began = time.time()
    plan = I.dirty_image(vis, 384, 1e-3)
    assert time.time() - began < 2
    got = np.zeros((384, 384))
    for r in plan.where("x < 3 or y = 383").collect():
        got[r.y, r.x] = r.flux
    at = (np.arange(384) - 191.5) * 1e-3
    u, v = 3.0 * np.arange(20), -2.0 * np.arange(20)
    phase = 2 * np.pi * (u[:, None, None] * at[None, None, :] + v[:, None, None] * at[None, :, None])
    want = (np.cos(phase) - 0.5 * np.sin(phase)).mean(0)
    assert np.allclose(got[:, :3], want[:, :3]) and np.allclose(got[383], want[383])


def test_images_of_a_flagged_frame_and_guards(spark):
    vis = spark.createDataFrame([(0, 0, 0, "XX", 1.0, 2.0, 1.0, 0.0, True, 1.0), (1, 0, 0, "XX", 1.0, 2.0, 1.0, 0.0, False, 2.0), (1, 0, 0, "YY", 1.0, 2.0, 3.0, 0.0, False, 2.0)], "t long, row long, chan long, corr string, u double, v double, re double, im double, flag boolean, weight double")
    for mode, top in (("average", 2.0), ("single", 1.0), ("stokesI", 2.0)):
        got = {(r.t, r.y, r.x): r.flux for r in I.frame_images(vis, 3, 0.01, mode).collect()}
        assert got[1, 1, 1] == pytest.approx(top) and not any(k[0] == 0 for k in got)
    with pytest.raises(ValueError, match="no correlation RR"):
        I.single_correlation(vis, "RR")
    assert I.indexed_correlation(vis, 1).count() == 1 and I.indexed_correlation(vis).count() == 2
    with pytest.raises(ValueError, match="no correlation 2"):
        I.indexed_correlation(vis, 2)
    with pytest.raises(ValueError, match="no column u"):
        I.frame_images(vis.drop("u"), 3, 0.01)
    own = I.weight_source(vis.withColumn("weight_spectrum", F.lit(7.0)))
    assert own.first().weight == 7.0 and "weight_spectrum" not in own.columns and I.weight_source(vis).first().weight == 1.0
    channels = spark.createDataFrame([(0, 0.5)], "chan long, wavelength_m double")
    assert I.uv_wavelengths(vis, channels).first().v == 4.0 and I.channel_range(vis, 1).count() == 0 and I.channel_range(vis, 0, 1).count() == 3


def test_adjoint_transform_in_blocks_is_the_direct_sum(spark):
    rng = np.random.default_rng(8)
    n, npix, nf, dt, cell, dm = 200, 4, 16, 0.25, 0.02, 30.0
    time, u, v, freq, re, im = np.sort(rng.uniform(5, 9, n)), *(rng.normal(0, 8, n) for _ in range(2)), rng.choice([8e8, 9e8], n), *(rng.normal(0, 1, n) for _ in range(2))
    flag = rng.random(n) < 0.1
    vis = spark.createDataFrame([tuple(map(float, r[:-1])) + (bool(r[-1]),) for r in zip(time, u, v, freq, re, im, flag, strict=True)], "time double, u double, v double, freq_hz double, re double, im double, flag boolean")
    want = np.zeros((npix, npix, nf // 2), complex)
    for j in np.flatnonzero(~flag):
        t = time[j] - 4.148808e3 * dm * 1e-3 / (freq[j] * 1e-6) ** 2
        for y in range(npix):
            for x in range(npix):
                for k in range(nf // 2):
                    want[y, x, k] += (re[j] + 1j * im[j]) * np.exp(2j * np.pi * (k / (nf * dt) * t - cell * (u[j] * (x - 2) + v[j] * (y - 2))))
    for block in (1000, 37):
        got = np.zeros_like(want)
        for r in P.stitched(P.adjoint_blocks(vis, npix, cell, dt, nf, 0.0, dm, block), nf, dt).collect():
            got[r.y, r.x, r.k] = r.re + 1j * r.im
        assert np.allclose(got, want, atol=1e-8)
    some = P.adjoint_blocks(vis, npix, cell, dt, nf, 0.6, dm)
    assert {r.k for r in some.select("k").distinct().collect()} == set(range(3, 8))  # f >= 0.6 at steps of 0.25


def test_a_pulsar_is_found_at_its_frequency(spark):
    rng = np.random.default_rng(12)
    base = rng.uniform(-20, 20, (16, 2))
    rows = []
    for i in range(128):
        for u, v in base.tolist():
            flux = 4 * (1 + math.cos(2 * math.pi * 0.125 * i))
            phase = 2 * math.pi * 0.02 * (u * 1 + v * 2)  # one pixel right of the centre, two down
            noise = rng.normal(0, 2, 2).tolist()
            rows.append((float(i), u, v, 9e8, flux * math.cos(phase) + noise[0], flux * math.sin(phase) + noise[1], False))
    vis = spark.createDataFrame(rows, "time double, u double, v double, freq_hz double, re double, im double, flag boolean")
    best = E.periodic(vis, 8, 0.02, 0.05, threshold=3.0, nharm=2, estimator="mad", keep=1).first()
    assert (best.y, best.x) == (6, 5) and best.f_hz == pytest.approx(0.125) and best.period_s == pytest.approx(8.0)


# Time axis


def test_time_columns_and_cadence(spark):
    df = spark.createDataFrame([(1.0, 10.0, 0.5), (2.0, 20.0, 0.5), (4.0, 30.0, -1.0)], "time double, time_centroid double, interval double")
    assert A.time_column(df) == "time_centroid" and A.time_column(df.drop("time_centroid")) == "time"
    with pytest.raises(ValueError):
        A.time_column(df.select("interval"))
    assert A.time_bin(df).first().cadence == 0.5 and A.time_bin(df.drop("interval")).first().cadence == 10.0
    assert A.distinct_times(df).count() == 3 and A.scan_count(df.withColumn("scan", F.lit(1))).first().scans == 1
    assert A.assert_uniform(df.select(F.col("time_centroid").alias("time"))).count() == 3
    with pytest.raises(Exception, match="not uniform"):
        A.assert_uniform(df.select("time")).count()


def test_nearest_time_across_empty_ranges(spark):
    r = random.Random(3)
    axis = [r.uniform(0, 10) for _ in range(20)] + [900.0, 1000.0, 1000.0]
    rows = [(i, r.choice([r.uniform(-50, 1100), r.choice(axis)])) for i in range(200)] + [(500, None), (501, 950.0)]
    df, marks = spark.createDataFrame(rows, "id long, time double"), spark.createDataFrame([(t,) for t in axis], "time double")
    want = {i: None if t is None else min(axis, key=lambda a: (abs(a - t), a)) for i, t in rows}
    for ranges in (1, 7, 4096):
        assert {x.id: x.time for x in K.nearest_time(df, marks, ranges).collect()} == want
    assert {x.time for x in K.nearest_time(df, marks.limit(0)).collect()} == {None}


def test_numbers_go_on_from_range_to_range(spark):
    r = random.Random(9)
    rows = [(r.randint(0, 40), r.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b double")
    got = K.number(df, "n", F.desc("a"), "b").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.n)] == sorted(rows, key=lambda x: (-x[0], x[1])) and {x.n for x in got} == set(range(500))
    assert K.number(df.limit(0), "n", "a").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_few_edges_are_those_of_the_rounds(spark, kind):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 3)]
    edges = spark.createDataFrame(rows, "a long, b long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    assert sorted(graph.connected_components(edges, few=1 << 20).collect()) == sorted(graph.connected_components(edges).collect())
    assert graph.connected_components(edges.limit(0), few=9).collect() == []


def test_hot_keys_are_dealt_out(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(30)]
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.component for x in found.collect()} == {k: 0 for k in range(3000)} | {5000 + k: 5000 for k in range(31)}
    rows = graph.salted(spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(3000)], "key string, v long"), "salt")
    table = spark.createDataFrame([("hot", 1), ("k0", 2)], "key string, w long")
    assert sum(r.w for r in graph.joined_evenly(rows, table, ["key"], "salt").collect()) == 2002
    assert graph.joined_evenly(rows, table, ["key"], "salt", "left").count() == 3000


# Names, files, sinks


def test_artefacts_by_contained_names(spark):
    names = ["J12.3-4", "J1", "a_b", "x"]
    files = ["obs_cand_J12.3-4x.png", "obs_J1_lc.txt", "obs_J1.csv", "obsJ1_x", "o_a_b_1.txt", "o_a_bc.txt", "_x_", "x_", "o_x", "cand_J1", "", "o_boxcar_J1_z", "o__x_"]
    got = K.artefact_match(spark.createDataFrame([(f,) for f in files], "artefact string"), spark.createDataFrame([(n,) for n in [*names, ""]], "srcname string"))
    want = {(f, n) for f in files for n in names if f"cand_{n}" in f or f"_{n}_" in f or f"_{n}." in f}
    assert {tuple(r) for r in got.collect()} == want
    other = K.artefact_match(spark.createDataFrame([(f,) for f in files], "artefact string"), spark.createDataFrame([("J1",)], "srcname string"), "variance")
    assert "o_boxcar_J1_z" not in {r.artefact for r in other.collect()}


def test_sub_rows_lookup_and_filling(spark):
    rows = spark.createDataFrame([(1, "a", 10.0, 0.0), (2, "b", 20.0, 0.0)], "id long, srcname string, ra double, dec double")
    none = spark.createDataFrame([("zz",)], "srcname string")
    spots = spark.createDataFrame([(50.0, 50.0)], "ra double, dec double")
    assert {r.id for r in K.component_match(rows, none, spots, sub_rows=rows.where("id = 2")).collect()} == {2}
    assert {r.id for r in K.component_match(rows, none, spots.union(rows.select("ra", "dec").limit(1)), sub_rows=rows.where("id = 2")).collect()} == {1}
    files = spark.createDataFrame([("z_beam02.fits",), ("a.fits",), ("b_beam02.fits",)], "file string")
    beams = spark.createDataFrame([("beam02",), ("beam09",)], "beam string")
    assert {r.beam: r.file for r in K.continuum_lookup(beams, files).collect()} == {"beam02": "b_beam02.fits", "beam09": "a.fits"}
    assert {r.file for r in K.continuum_lookup(beams, files.limit(0)).collect()} == {None}
    deg = spark.createDataFrame([(15.0, -1.5, "", None), (15.0, -1.5, "kept", "x")], "ra_deg double, dec_deg double, ra_hms string, dec_dms string")
    assert [(r.ra_hms, r.dec_dms) for r in K.fill_sexagesimal(deg).collect()] == [("01:00:00.0", "-01:30:00.0"), ("kept", "x")]
    some = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, component long")
    assert K.members(some, some.where("id = 1")).count() == 2
    named = spark.createDataFrame([("F.SB12345_beam03_20240101000000_boxcar_all.vot",), ("nothing",)], "file string")
    assert K.require_name(named, "beam", "scan_id").count() == 1


def test_annotation_and_strings(spark):
    det = spark.createDataFrame([(2, 1)], "x long, y long")
    got = K.annotate(det, 5, 3, 0.01, 0.01, 1.0, 0.5, "F").first()
    assert (got.l, got.m) == (0.0, 0.0) and got.ra_rad == pytest.approx(1.0) and got.dec_rad == pytest.approx(0.5) and got.srcname == "J" + got.ra_hms.replace(":", "") + got.dec_dms.replace(":", "")
    flipped = K.annotate(spark.createDataFrame([(3, 1)], "x long, y long"), 5, 3, 0.01, 0.01, 1.0, 0.5)
    assert flipped.first().l == -0.01 and K.annotate(det.withColumn("x", F.lit(3)), 5, 3, 0.01, 0.01, 1.0, 0.5, flip_u=False).first().l == 0.01
    one = spark.range(1).select(
        sky.timerange(F.lit(60000.5 * 86400), F.lit(60000.5 * 86400 + 1.25)).alias("range"), sky.timerange(F.lit(1.0), F.lit(None).cast("double")).alias("none"), sky.interval_option(F.lit(3), F.lit(7)).alias("interval"), sky.mjd(F.lit(86400.0)).alias("mjd"),
        sky.sexagesimal(F.lit(1.0), F.lit(-0.5), 3)[0].alias("fine"), sky.sexagesimal(F.lit(1.0), F.lit(-0.5), 0)[1].alias("coarse"), sky.arcsec_to_rad(F.lit(3600.0)).alias("rad"), sky.tangent_header(5, 3, 0.01, 0.01, 1.0, 0.5).alias("wcs"), K.safe_name(F.lit("a/b")).alias("safe"),
        K.region_label(F.lit("J{1}"), F.lit(7.26), F.lit("unknown")).alias("label"),
    ).first()
    assert one.range == "2023/02/25/12:00:00.000~2023/02/25/12:00:01.250" and one.none == "—" and one.interval == "-interval 3 7" and one.mjd == 1.0
    assert one.fine == "03:49:10.987" and one.coarse == "-28:38:52" and one.rad == pytest.approx(math.radians(1)) and one.safe == "a_b" and one.label == "J(1) S/N=7.3 ??"
    assert one.wcs.CRPIX1 == 3.0 and one.wcs.CDELT1 == pytest.approx(-math.degrees(0.01)) and one.wcs.CRVAL2 == pytest.approx(math.degrees(0.5))


def test_readers_of_tables_and_files(spark, tmp_path):
    vis = spark.createDataFrame([(float(t), 1, False, t == 2) for t in range(5)], "time_centroid double, scan int, flag boolean, flag_row boolean")
    vis.write.parquet(str(tmp_path / "vis"))
    got = readers.visibilities(spark, str(tmp_path / "vis"), 1.0, 3.0)
    assert sorted((r.time, r.flag) for r in got.collect()) == [(1.0, False), (2.0, True), (3.0, False)]
    spw = spark.createDataFrame([(0, 0, 299792458.0), (0, 1, 149896229.0)], "spw int, chan int, freq_hz double")
    assert sorted(r.wavelength_m for r in readers.one_window(spw).collect()) == [1.0, 2.0]
    with pytest.raises(Exception, match="more than one"):
        readers.one_window(spw.union(spw.withColumn("spw", F.lit(1)))).collect()
    fields = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "name string, ra0_rad double, dec0_rad double")
    assert readers.phase_centre(fields, "b") == (3.0, 4.0, "b")
    with pytest.raises(ValueError):
        readers.phase_centre(fields, "c")
    (tmp_path / "psr.csv").write_text("#;NAME;PSRJ;RAJ;DECJ\n;;;(hms);(dms)\n1;B1;J1;01:00:00;-10:30:00\n2;B2;J2;*;*\n")
    assert [tuple(r) for r in readers.pulsar_csv(spark, str(tmp_path / "psr.csv")).collect()] == [("J1", 15.0, -10.5)]
    folder = tmp_path / "cands" / "deep"
    folder.mkdir(parents=True)
    (folder / "F.SB12345_beam03_20240101000000_boxcar_all.csv").write_text("srcname,x\nJ1,3\n")
    (folder / "other.txt").write_text("x")
    found = readers.discover(spark, str(tmp_path / "cands"), "*.csv").collect()
    assert [(r.file, r.beam, r.kind, r.is_all) for r in found] == [("F.SB12345_beam03_20240101000000_boxcar_all.csv", "beam03", "boxcar", True)]
    assert [(r.srcname, r.x) for r in readers.csv_catalogue(spark, str(folder / "*.csv"), "srcname string, x long").collect()] == [("J1", 3)]
    assert readers.first_there(spark, [str(tmp_path / "no"), str(folder / "*.csv")], "srcname string, x long", "csv").count() == 1
    assert readers.first_there(spark, [str(tmp_path / "no")], "x long").count() == 0
    assert readers.catalogue_path(spark, "psr", "packaged") == "packaged"
    spark.conf.set("spark.skylattice.catalogue.psr", str(tmp_path / "psr.csv"))
    assert readers.catalogue_path(spark, "psr", "packaged") == str(tmp_path / "psr.csv")
    spark.conf.set("spark.skylattice.catalogue.psr", str(tmp_path / "gone.csv"))
    assert readers.catalogue_path(spark, "psr", "packaged") == "packaged"
    assert readers.derived_paths("/d/x.ms/") == {"base": "x", "folder": "/d/candidates", "chunk": "/d/candidates/x_chunk_{:06d}", "all": "/d/candidates/x_all"}


def test_sinks_read_back(spark, tmp_path):
    det = spark.createDataFrame([("J1/2", "01:00:00.0", "-01:00:00.0", 7.5, 4, 86400.0, 86401.0, 3, 7), ("J3<&>", None, None, 8.0, None, None, None, None, None)], "srcname string, ra_hms string, dec_dms string, snr double, width_samples long, time_start double, time_end double, t0_idx long, t1_idx_excl long")
    writers.votable(det, str(tmp_path / "vot"))
    back = readers.votable(spark, str(tmp_path / "vot/*.txt"), "srcname string, snr double, width_samples long")
    assert {tuple(r) for r in back.collect()} == {("J1/2", 7.5, 4), ("J3<&>", 8.0, None)}
    assert 'unit="s"' in "".join(r.value for r in spark.read.text(str(tmp_path / "vot")).collect())
    writers.summaries(det, str(tmp_path / "text"))
    assert "J1/2 01:00:00.0 -01:00:00.0 S/N=7.50 width=4 1858/11/18/00:00:00.000~1858/11/18/00:00:01.000 -interval 3 7" in {r.value for r in spark.read.text(str(tmp_path / "text")).collect()}
    writers.by_source(det, str(tmp_path / "own"))
    assert (tmp_path / "own" / "source=J1_2").is_dir()
    writers.annotations(spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, "")], "ra double, dec double, label string"), str(tmp_path / "ann"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ann")).collect()) == ["CIRCLE 1.000000 2.000000 0.005556", "CIRCLE 3.000000 4.000000 0.005556", "TEXT 1.006667 2.000000 a"]
    parts = [det.select("srcname", "snr").withColumn("level", F.lit(k)) for k in ("chunk", "obs")]
    writers.consolidate(parts, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).groupBy("level").count().count() == 2
    writers.maps(spark.createDataFrame([(0, 0, 1.5)], "y long, x long, std double"), str(tmp_path / "map"))
    assert dict(spark.read.parquet(str(tmp_path / "map")).dtypes)["std"] == "float"
    curve = spark.createDataFrame([("s", 1.0, 2.0)], "srcname string, time double, flux double")
    writers.light_curves(curve, str(tmp_path / "lc"))
    writers.light_curves(curve, str(tmp_path / "lct"), text=True)
    assert spark.read.text(str(tmp_path / "lct")).first().value == "1.000000000 2.000000000e+00" and spark.read.parquet(str(tmp_path / "lc")).count() == 1


def test_running_mean_in_event_time(spark, tmp_path):
    from skylattice.streaming import state

    rows = [(u, f"2024-01-01 00:00:{s:02d}", float(v)) for u, s, v in [(1, 0, 5), (1, 10, 7), (1, 30, 1), (2, 0, 4), (2, 5, 4)]]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.user_id: r for r in state.run_once(state.welford(stream, tau=20.0), "tau_out", "update").collect()}
    ema, want = 5.0, [0.0]
    for gap, v in ((10, 7.0), (20, 1.0)):
        a = 1 - math.exp(-gap / 20)
        ema = (1 - a) * ema + a * v
        want.append(v - ema)
    assert got[1].n == 3 and got[1]["mean"] == pytest.approx(np.mean(want)) and got[1].m2 == pytest.approx(np.var(want) * 3) and got[2].m2 == 0.0
    (tmp_path / "none").mkdir()
    assert state.run_once(state.dedupe(spark.readStream.schema(df.schema).parquet(str(tmp_path / "none")), ["user_id"]), "none_out").count() == 0
    plain = {r.user_id: r.n for r in state.run_once(state.welford(stream), "plain_out", "update").collect()}
    assert plain == {1: 3, 2: 2}


# Commands


def test_commands_from_visibilities_to_the_observation(spark, tmp_path):
    from skylattice import cli

    rng = np.random.default_rng(11)
    base = [(float(a), float(b)) for a in range(-9, 10, 3) for b in range(-9, 10, 3)]
    rows = []
    for t in range(24):
        for k, (u, v) in enumerate(base):
            phase = 2 * math.pi * 0.02 * (u * 2 + v * -1)
            flux = 40.0 if 10 <= t < 12 else 0.0
            noise = rng.normal(0, 1, 2).tolist()
            rows.append((100 + t * 0.5, k, 0, "XX", u, v, flux * math.cos(phase) + noise[0], -flux * math.sin(phase) + noise[1], False, 1.0, 7))
    spark.createDataFrame(rows, "time double, row long, chan long, corr string, u double, v double, re double, im double, flag boolean, weight double, scan int").write.parquet(str(tmp_path / "vis"))
    arcsec = 0.02 * 206265
    found = cli.main(["search", "--vis", str(tmp_path / "vis"), "--out", str(tmp_path / "out"), "--by", "scan", "--npix", "8", "--pixsize-arcsec", str(arcsec), "--chunk-size", "16", "--boxcar-widths", "1", "2", "4", "--threshold-sigma", "4", "--var-threshold-sigma", "2", "--nms-radius", "3", "--ra-deg", "150", "--dec-deg", "-30", "--votable"], spark)
    best = found.where("kind = 'boxcar'").orderBy(F.desc("snr")).first()
    assert abs(best.t0_idx - 10) <= 3 and best.scan == 7
    table = spark.read.parquet(str(tmp_path / "out/boxcar/parquet"))
    assert len(table.columns) == 22 and table.count() == found.where("kind = 'boxcar'").count() and table.first().scan_id == 7
    cands = tmp_path / "cands"
    cands.mkdir()
    for k, beam in enumerate(("beam01", "beam02")):
        table.toPandas().to_csv(cands / f"F.SB12345_{beam}_2024010100000{k}_boxcar_all.csv", index=False)
    sources = cli.main(["aggregate", "--candidates", str(cands), "--out", str(tmp_path / "agg")], spark)
    assert sources.agg(F.sum("n_detections_total")).first()[0] == 2 * table.count()
    (tmp_path / "psr.csv").write_text("PSRJ;RAJ;DECJ\nJhere;%s;%s\n" % (best.ra_hms, best.dec_dms))
    obs = cli.main(["aggregate_obs", "--events", str(tmp_path / "agg/events"), "--out", str(tmp_path / "obs"), "--psr", str(tmp_path / "psr.csv")], spark)
    assert obs.orderBy(F.desc("max_snr")).first().source_name == "Jhere" and obs.agg(F.max("n_scans")).first()[0] == 2
    assert spark.read.text(str(tmp_path / "obs/regions_kvis")).where("value like 'CIRCLE%' or value like 'TEXT%'").count() == 2 * obs.count()
    spark.read.parquet(str(tmp_path / "vis")).withColumn("freq_hz", F.lit(9e8)).write.parquet(str(tmp_path / "tones"))
    tones = cli.main(["periodicity", "--vis", str(tmp_path / "tones"), "--out", str(tmp_path / "per"), "--npix", "4", "--fmin", "0.1", "--threshold-sigma", "1", "--nharm", "2"], spark)
    assert len(tones.columns) == 17 and tones.count() == spark.read.parquet(str(tmp_path / "per/periodicity/parquet")).count()
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)

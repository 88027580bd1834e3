"""Greedy selection by tiles, and anchored groups, against walks over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import greedy as G


def walk(rows, axes, rank, cap=None):
    kept = []
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in rank)):
        if cap and sum(k[cap[0]] == r[cap[0]] for k in kept) >= cap[1]:
            continue
        if not any(all(abs(k[c] - r[c]) <= n for c, n in axes.items()) for k in kept):
            kept.append(r)
    return kept


def cands(seed, many, size=40, times=30):
    rng = random.Random(seed)
    return [{"c": rng.randrange(times), "y": rng.randrange(-size, size), "x": rng.randrange(size), "width": 2 ** rng.randrange(3), "snr": float(rng.randrange(8))} for _ in range(many)]


@pytest.mark.parametrize("tile", [16, 128])
def test_peaks_by_tiles_are_those_of_the_walk(spark, tile, monkeypatch):
    monkeypatch.setattr(G, "TILE", tile)
    rows = [{"beam": b, **r} for b in (1, None) for r in cands(tile, 250)] + [{"beam": 1, "c": 0, "y": k, "x": 0, "width": 1, "snr": 50.0 - k} for k in range(-60, 60)]
    df = spark.createDataFrame(rows, "beam long, c long, y long, x long, width long, snr double")
    got = sorted((r.beam or 0, r.y, r.x, r.snr) for r in G.nms_2d(df, 2, ["beam"]).collect())
    want = []
    for b in (1, None):
        own = [r | {"o": -r["snr"]} for r in rows if r["beam"] == b]
        want += [(b or 0, r["y"], r["x"], r["snr"]) for r in walk(own, {"y": 2, "x": 2}, ["o", "y", "x"])]
    assert got == sorted(want)


@pytest.mark.parametrize(("policy", "cap"), [*zip(("max_snr", "prefer_short", "prefer_long"), (2, None, 1), strict=True)])
def test_widths_by_tiles_are_those_of_the_walk(spark, policy, cap, monkeypatch):
    monkeypatch.setattr(G, "TILE", 9)
    monkeypatch.setattr(G, "TILE_TIMES", 12)
    rows = cands(17, 200)
    got = G.group_widths(spark.createDataFrame(rows, "c long, y long, x long, width long, snr double"), 3, 2, policy, cap)
    sign = {"max_snr": 0, "prefer_short": 1, "prefer_long": -1}[policy]
    own = [r | {"o": -r["snr"], "p": sign * r["width"]} for r in rows]
    want = walk(own, {"c": 4, "y": 3, "x": 3}, ["p", "o", "c", "y", "x", "width"], ("c", cap) if cap else None)
    assert sorted(map(tuple, got.select("c", "y", "x", "width", "snr").collect())) == sorted((r["c"], r["y"], r["x"], r["width"], r["snr"]) for r in want)


def test_nothing_to_select(spark):
    none = spark.createDataFrame([], "c long, y long, x long, width long, snr double")
    assert G.nms_2d(none, 2).collect() == [] and G.group_widths(none, 2, 1).collect() == []


def groups_of(times, tolerance):
    out, first, grp = {}, None, -1
    for t in sorted(set(times)):
        if first is None or t - first > tolerance:
            first, grp = t, grp + 1
        out[t] = grp
    return out


@pytest.mark.parametrize("seed", range(2))
def test_anchored_groups_are_those_of_the_walk(spark, seed):
    """Times with long islands, so pointers are followed; times a tolerance apart; a scan without a name; repeated rows."""
    rng, rows = random.Random(seed), []
    for scan in ("a", "b", None):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0.0, 0.1, 0.25, 0.3, 0.31, 2.0] if seed % 2 else [0.05, 0.1, 0.3])
            rows += [(scan, round(t, 6))] * rng.choice([1, 2])
    df = spark.createDataFrame(rows, "scan string, time double")
    got = G.anchored_groups(df, "time", 0.3, ["scan"])
    assert got.columns == ["scan", "time", "grp"] and got.count() == len(rows)
    for scan in ("a", "b", None):
        want = groups_of([t for s, t in rows if s == scan], 0.3)
        assert {(r.time, r.grp) for r in got.where(F.col("scan").eqNullSafe(scan)).collect()} == set(want.items())


def test_anchored_groups_run_no_python(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, 5)], "scan int, time long")
    plan = G.anchored_groups(df, "time", 3, ["scan"])
    assert [r.grp for r in plan.orderBy("time").collect()] == [0, 0, 1]
    assert "Arrow" not in plan._jdf.queryExecution().toString() and "Python" not in plan._jdf.queryExecution().toString().replace("ExistingRDD", "")


def test_cumulative_chunks_are_searched_as_one_prefix(spark):
    """Chunk k finds what a search of chunks 0 to k in one finds."""
    from skylattice.operators import cube as C
    from skylattice.operators import search as E

    rng = random.Random(3)
    rows = [(t, y, x, rng.gauss(5, 1) + (rng.gauss(0, 9) if (y, x) == (3, 4) and t >= 20 else 0)) for t in range(36) for y in range(8) for x in range(8)]
    cube = spark.createDataFrame([(t // 12, *r) for t, *r in [(r[0], *r) for r in rows]], "chunk long, t long, y long, x long, flux double")
    s = E.Settings(npix=8, var_threshold=2.0, radius=3, cumulative=True)
    got = E.settled(E.variance_candidates(cube, s, ["chunk"]))
    alone = E.Settings(npix=8, var_threshold=2.0, radius=3)
    for k in range(3):
        want = E.variance_candidates(cube.where(F.col("chunk") <= k).drop("chunk"), alone)
        pick = lambda df: sorted((r.y, r.x, round(r.snr, 5), round(r.std, 6)) for r in df.collect())
        assert pick(got.where(F.col("chunk") == k)) == pick(want)
    assert got.where("chunk = 2 and y = 3 and x = 4").count() == 1
    states = C.welford(cube, ["chunk", "y", "x"])
    assert C.welford_prefix(states.limit(0), ["y", "x"]).count() == 0

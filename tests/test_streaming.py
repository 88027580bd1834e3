"""Moments of a stream in event order: late events, events out of order, keys that fall silent."""

import math
import random

import pytest

from skylattice.streaming import state as S

KIND = "user_id long, ts timestamp, value double"


def walked(rows, tau):
    n, mean, m2, ema, last = 0, 0.0, 0.0, math.nan, None
    for at, x in sorted(rows):
        a = 0.0 if last is None else 1 - math.exp(-(at - last) / tau)
        ema = x if math.isnan(ema) else (1 - a) * ema + a * x
        last, x, n = at, x - ema, n + 1
        d = x - mean
        mean, m2 = mean + d / n, m2 + d * (x - mean - d / n)
    return n, mean, m2


def test_moments_in_event_order(spark, tmp_path):
    import datetime as dt

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    rng, zero = random.Random(4), dt.datetime(2024, 1, 1)
    events = [(u, t, rng.gauss(0, 1)) for t in range(0, 60, 2) for u in (1, 2) if u == 1 or t < 10]
    batches = [events[:12], events[12:30], events[30:] + [(1, 0.5, 99.0)], [(9, 400, 0.0)], [(9, 500, 0.0)]]
    for batch in batches:
        rng.shuffle(batch)
    # In its batch an event may come in any order; the one at 0.5 s is behind what was taken by then.
    for k, batch in enumerate(batches):
        spark.createDataFrame([(u, zero + dt.timedelta(seconds=t), v) for u, t, v in batch], KIND).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    try:
        got = S.run_once(S.ordered_welford(src, tau=5.0, late="4 seconds", idle=60.0), "ordered").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    own = lambda u: [(t, v) for e in (events,) for w, t, v in e if w == u]
    for u in (1, 2):
        done = [r for r in got if r.user_id == u and r.closed]
        assert len(done) == 1
        n, mean, m2 = walked(own(u), 5.0)
        assert (done[0].n, done[0].mean, done[0].m2) == (n, pytest.approx(mean), pytest.approx(m2))
    assert not [r for r in got if r.user_id == 9 and r.closed]
    assert any(not r.closed and 0 < r.n < 30 for r in got if r.user_id == 1)

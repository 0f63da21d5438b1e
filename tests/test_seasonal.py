"""Seasonal order statistics against brute force: ties, gaps, NULLs, long calendars, windows of any width."""

import datetime as dt

import numpy as np
import pytest

from tidemark.functions.seasonal import season_stats
from tidemark.operators import climatology as cl

rng = np.random.default_rng(12)


def brute(site, doy, year, v, window):
    out = []
    for i in range(len(site)):
        gap = np.abs(doy - doy[i])
        x = v[(site == site[i]) & (year != year[i]) & (np.minimum(gap, 365 - gap) <= window) & np.isfinite(v)]
        med = np.median(x) if len(x) else np.nan
        out.append((len(x), med, np.median(np.abs(x - med)) if len(x) else np.nan, int((x < v[i]).sum())))
    return [np.array(c) for c in zip(*out, strict=True)]


@pytest.mark.parametrize("window", [0, 1, 45, 100, 182, 183, 400])
def test_against_brute_force(window):
    for _ in range(15):
        n = int(rng.integers(1, 250))
        site, doy = np.sort(rng.integers(0, 5, n)), rng.integers(1, 367, n)
        year, v = rng.integers(2000, 2001 + int(rng.integers(1, 8)), n), rng.normal(0, 3, n).round(int(rng.integers(0, 3)))
        v[rng.random(n) < 0.1] = np.nan
        for got, want in zip(season_stats(site, doy, year, v, window), brute(site, doy, year, v, window), strict=True):
            np.testing.assert_array_equal(got, want)


def test_a_site_of_twenty_thousand_days():
    n = 20_000
    day = np.arange(n)
    date = [dt.date(1960, 1, 1) + dt.timedelta(days=int(k)) for k in day]
    doy, year = np.array([x.timetuple().tm_yday for x in date]), np.array([x.year for x in date])
    v = rng.normal(size=n).round(2)
    count, median, mad, below = season_stats(np.zeros(n, int), doy, year, v, 45)
    for i in rng.integers(0, n, 40):
        gap = np.abs(doy - doy[i])
        x = v[(year != year[i]) & (np.minimum(gap, 365 - gap) <= 45)]
        assert (count[i], median[i], mad[i], below[i]) == (len(x), np.median(x), np.median(np.abs(x - np.median(x))), (x < v[i]).sum())


def test_blocks_keep_sites_whole_and_null_keys_and_dates(spark):
    rows = [(None if s == 0 else f"s{s}", dt.date(2000 + y, 6, 1 + s % 7), float((7 * y + s) % 11)) for s in range(40) for y in range(9)]
    rows += [("s1", None, 3.0), ("s2", dt.date(2004, 6, 20), None), ("s3", dt.date(2004, 6, 21), float("nan"))]
    df = spark.createDataFrame(rows, "k string, d date, v double").repartition(3)
    got = {(r.k, r.d): r for r in cl.robust_anomaly(df, ["k"], {"v": 0.5}).collect()}
    assert len(got) == len(rows)
    for k, d, v in rows:
        r = got[k, d]
        if d is None:
            assert (r.v_n, r.v_med, r.v_z) == (0, None, None)
            continue
        past = np.array([x for a, b, x in rows if a == k and b is not None and b.year != d.year and x is not None and not np.isnan(x)])
        assert r.v_n == len(past) and r.v_med == np.median(past)
        if v is None or np.isnan(v):
            assert r.v_z is None and r.v_pct is None
        else:
            scale = 1.4826 * np.median(np.abs(past - np.median(past))) + 0.5
            assert r.v_z == pytest.approx((v - np.median(past)) / scale) and r.v_pct == pytest.approx(100 * (past < v).mean())


def test_persistence_reads_the_season_of_region_pixels(spark):
    daily = spark.createDataFrame([(p, dt.date(2000 + y, 6, 1), float(v)) for p, vs in {1: (9, 0, 9, 0, 9), 2: (9, 0, 9, 9, 9), 3: (0, 0, 0, 0, 0)}.items() for y, v in enumerate(vs)], "px int, d date, v double")
    region = spark.createDataFrame([(7, p, dt.date(2004, 6, 1), 0.0, 1.0) for p in (1, 2)], "label int, px int, d date, v_med double, v_scale double")
    got = cl.persistence(region, daily, ["label"], ["px"], "v", z_min=4.0).first()
    assert got.persistence_frac == 0.75           # 2000, 2002 and 2003 (one of two pixels) of four past years


def test_short_and_long_sites_agree():
    from tidemark.functions.seasonal import _long_stats, _short_stats
    site = np.sort(rng.integers(0, 9, 200))
    doy, year, v = rng.integers(1, 367, 200), rng.integers(2000, 2006, 200), rng.integers(0, 9, 200).astype(float)
    v[::17], v[5] = np.nan, np.inf
    for a, b in zip(_short_stats(site, doy, year, v, 100), _long_stats(site, doy, year, v, 100), strict=True):
        np.testing.assert_array_equal(a, b)

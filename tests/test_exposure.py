"""Distance joins and exposure against brute force: dense cubes, poles, the date line, far tracks."""

import numpy as np
import pytest

from tidemark.operators import exposure as ex

R = 6_371_000.0
rng = np.random.default_rng(11)


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(a, 1)))


def world(n, centre=(54.0, 24.0), spread=2.0):
    lon, lat = rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lon[: n // 2], lat[: n // 2] = centre[0] + rng.normal(0, spread, n // 2), centre[1] + rng.normal(0, spread, n // 2)
    lon[n // 2: n // 2 + 20], lat[n // 2: n // 2 + 20] = rng.choice([179.99, -179.99], 20), rng.uniform(-1, 1, 20)
    lat[n // 2 + 20: n // 2 + 40] = rng.choice([89.9, -89.95], 20)
    return lon, lat


@pytest.mark.parametrize(("few", "dense"), [(4000, 2000), (0, 2000), (0, 20), (0, 3)])
def test_pairs_with_a_tenth_of_all_assets_in_one_cube(spark, few, dense):
    n, m, radius = 300, 900, 60_000.0
    elon, elat = world(n)
    alon, alat = world(m)
    alon[:90], alat[:90] = 54.0 + rng.normal(0, 0.02, 90), 24.0 + rng.normal(0, 0.02, 90)
    events = spark.createDataFrame([(int(k), float(elon[k]), float(elat[k])) for k in range(n)], "event_id long, lon double, lat double")
    assets = spark.createDataFrame([(int(k), float(alon[k]), float(alat[k])) for k in range(m)], "asset_id long, alon double, alat double")
    d = haversine(elon[:, None], elat[:, None], alon[None], alat[None])
    want = {(i, j): d[i, j] for i, j in np.argwhere(d <= radius)}
    got = {(r.event_id, r.asset_id): r.distance_m for r in ex.asset_pairs(events, assets, radius, few, dense).collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_far_steps_change_nothing(spark):
    events = [(k, 54.0 + 0.01 * k, 24.0) for k in range(6)]
    pairs = [(e, a, lon, lat, 54.0 + 0.03 * a, 24.02, 0.8) for e, lon, lat in events for a in range(4)]
    pairs = [(*p[:6], float(haversine(p[2], p[3], p[4], p[5])), p[6]) for p in pairs]
    track = [(e, h, lon + 0.004 * h * (1 if e % 2 else 40) + 0.002 * q, lat + 0.0004 * h * q) for e, lon, lat in events for h in (0, 6, 12, 24) for q in range(5)]
    df = ex.assess(spark.createDataFrame(pairs, "event_id int, asset_id int, lon double, lat double, alon double, alat double, distance_m double, sensitivity double"),
                   spark.createDataFrame(track, "event_id int, hours int, plon double, plat double"), ex.F.lit(1500.0))
    for r in df.collect():
        steps = {}
        for e, h, x, y in track:
            if e == r.event_id:
                steps.setdefault(h, []).append(float(haversine(x, y, r.alon, r.alat)))
        closest, at = min((min(v), h) for h, v in steps.items())
        eta = min((h for h, v in steps.items() if h > 0 and np.mean(np.array(v) <= 1500) > 0.01), default=None)
        assert r.eta_hours == eta and r.intersects == (eta is not None)
        if closest < r.distance_m:
            assert r.closest_approach_m == pytest.approx(closest) and r.closest_approach_hours == at
        else:
            assert r.closest_approach_m == r.distance_m and r.closest_approach_hours == 0

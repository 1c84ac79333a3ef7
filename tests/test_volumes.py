"""Volumes of long intervals against a loop over every bin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.operators import bins

W = 10


def by_loop(data, begs, n, doubled):
    out = {}
    for stay, s, e, r in data:
        if r is None or stay not in begs:
            continue
        for b in range(n):
            t0, t1 = begs[stay] + b * W, begs[stay] + (b + 1) * W
            if s > t1 or e < t0:
                continue
            if doubled:
                v = (e - s if e <= t1 and s >= t0 else 0) + (e - t0 if s <= t0 and t0 <= e <= t1 else 0)
                v += (t1 - s if t0 <= s <= t1 and e >= t1 else 0) + (t1 - t0 if e >= t1 and s <= t0 else 0)
            else:
                v = max(min(e, t1) - max(s, t0), 0)
            out[stay, b] = out.get((stay, b), 0.0) + r * v / 3600
    return out


@pytest.mark.parametrize("doubled", [False, True])
@pytest.mark.parametrize("n", [1, 4, 6, 40])
def test_volumes_against_a_loop(spark, doubled, n):
    rng = np.random.default_rng(n)
    begs = {s: int(rng.integers(0, 30)) for s in range(5)}
    data = []
    for _ in range(150):
        s = int(rng.integers(-50, 450)) // 5 * 5
        data.append((int(rng.integers(0, 6)), s, s + int(rng.choice([0, 5, 10, 40, 50, 60, 70, 333, 2000])), float(rng.normal()) if rng.random() < 0.9 else None))
    for stay in begs:
        for k in range(0, 9):
            data.append((stay, begs[stay] + 20, begs[stay] + 20 + k * W, 3.0))
    rows = spark.createDataFrame(data, "stay long, s long, e long, rate double")
    starts = spark.createDataFrame(list(begs.items()), "stay long, beg long")
    got = bins.interval_volumes(rows, starts, "stay", "s", "e", "rate", W, n, doubled)
    got = {(r["stay"], r["bin"]): r["volume"] for r in got.collect()}
    want = by_loop(data, begs, n, doubled)
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_a_long_interval_and_null_cells(spark):
    rows = spark.createDataFrame([(1, 3, 100_003, 36.0), (1, None, 5, 1.0), (None, 1, 2, 1.0)], "stay long, s long, e long, rate double")
    starts = spark.createDataFrame([(1, 0)], "stay long, beg long")
    out = bins.interval_volumes(rows, starts, "stay", "s", "e", "rate", W, 20_000)
    total, n = out.agg(F.sum("volume"), F.count("*")).first()
    assert n == 10_001 and abs(total - 1000.0 - 5 / 3600) < 1e-6
    twice = bins.interval_volumes(rows.filter("s IS NULL"), starts, "stay", "s", "e", "rate", W, 20_000, True)
    assert [tuple(r) for r in twice.collect()] == [(1, 0, 0.0)]

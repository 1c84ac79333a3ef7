"""Operators against small plain loops written from their definitions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from careflow.operators import bins, impute, joins, mdp, ope, series, states
from careflow.session import cut_lineage

H = 3600


def test_hold_against_a_loop(spark):
    rng = random.Random(5)
    data, i = [], 0
    for s in range(12):
        t = 0
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([H // 2, H, 2 * H, 2 * H + 1])
            data.append((s, t, rng.choice([None, None, float(rng.randint(1, 9))])))
    df = spark.createDataFrame(data, "s long, t long, v double")
    want, last = {}, {}
    for s, t, v in sorted(data, key=lambda x: x[:2]):
        if v is not None:
            last[s] = (t, v)
        held = last.get(s)
        want[s, t] = v if v is not None else (held[1] if held and t - held[0] <= 2 * H else None)
    for limit in (10**9, 10):
        got = {(r.s, r.t): r.v for r in impute.hold(df, "s", "t", {"v": 2}, hot_rows=limit).collect()}
        assert got == want


def test_hold_edges(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 2 * H, None), (1, 4 * H, None), (2, 0, None), (2, 1, 3.0), (2, 2 * H + 1, None), (2, 2 * H + 2, None)], "s long, t long, v double")
    got = {(r.s, r.t): r.v for r in impute.hold(df, "s", "t", {"v": 2}).collect()}
    assert got == {(1, 0): 5.0, (1, 2 * H): 5.0, (1, 4 * H): None, (2, 0): None, (2, 1): 3.0, (2, 2 * H + 1): 3.0, (2, 2 * H + 2): None}


def test_interpolation_across_and_within_keys(spark):
    vs = [None, 1.0, None, None, 4.0, None, 10.0, None]
    df = spark.createDataFrame([(i // 4, i, v) for i, v in enumerate(vs)], "s long, i long, v double")
    got = [r.v for r in impute.interpolate(df, ["i"], ["v"]).orderBy("i").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 7.0, 10.0, None]
    by = [r.v for r in impute.interpolate(df, ["i"], ["v"], by=["s"]).orderBy("i").collect()]
    assert by == [None, 1.0, None, None, 4.0, 7.0, 10.0, None]
    big = spark.createDataFrame([(i % 3, i, None if i % 4 else float(i * i)) for i in range(500)], "s long, i long, v double")
    a = {r.i: r.v for r in impute.interpolate(big, ["s", "i"], ["v"], hot_rows=10**9).collect()}
    b = {r.i: r.v for r in impute.interpolate(big, ["s", "i"], ["v"], hot_rows=40).collect()}
    assert a == b


def brute_nearest(x, most_null):
    out = x.copy()
    for c in range(x.shape[1]):
        nul = np.isnan(x[:, c])
        if nul.all() or not nul.any() or nul.mean() > most_null:
            continue
        for i in np.flatnonzero(nul):
            best = None
            for j in np.flatnonzero(~nul):
                both = [k for k in range(x.shape[1]) if k != c and not np.isnan(x[i, k]) and not np.isnan(x[j, k])]
                d = sum((x[i, k] - x[j, k]) ** 2 for k in both) / len(both) if both else math.inf
                if best is None or d < best[0]:
                    best = (d, j)
            out[i, c] = x[best[1], c]
    return out


def test_nearest_fill_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (90, 5)).astype(float)
    x[rng.random(x.shape) < 0.35] = np.nan
    x[:, 3] = np.nan
    x[1:29, 4] = np.nan
    cols = list("abcde")
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    out = impute.fill_from_nearest(df, ["i"], cols, block=30, most_null=0.9, keep_source=True).orderBy("i").collect()
    got = np.array([[np.nan if r[c] is None else r[c] for c in cols] for r in out])
    want = np.vstack([brute_nearest(x[i:i + 30], 0.9) for i in range(0, 90, 30)])
    assert np.array_equal(got, want, equal_nan=True)
    for r in out:
        if r["a_row"] is not None:
            assert x[r["a_row"] - 1][0] == r["a"]


def test_onset_against_a_loop(spark):
    rng = random.Random(9)
    abx = [(s, rng.randint(0, 200) * H) for s in range(40) for _ in range(rng.randint(0, 5))]
    cul = [(s, rng.randint(0, 200) * H, s * 10) for s in range(40) for _ in range(rng.randint(0, 5))]
    want = {}
    for s in range(40):
        cs = sorted(c for k, c, _ in cul if k == s)
        for a in sorted(t for k, t in abx if k == s):
            if not cs:
                break
            d = [abs(c - a) / H for c in cs]
            i = d.index(min(d))
            if d[i] <= 24 and a <= cs[i]:
                want[s] = a
                break
            if d[i] <= 72 and a >= cs[i]:
                want[s] = cs[i]
                break
    a = spark.createDataFrame(abx, "icustayid long, startdate long")
    c = spark.createDataFrame(cul, "icustayid long, charttime long, subject_id long")
    for limit in (10**9, 3):
        got = {r.icustayid: r.onset_time for r in states.onset(a, c, hot_rows=limit).collect()}
        assert got == want


def test_first_covering_against_brute_force(spark):
    rng = random.Random(4)
    iv = []
    for i in range(300):
        start = rng.randint(-500, 5000)
        iv.append((rng.choice([0, 0, 1, 2, 3]), start, start + rng.choice([0, 1, 7, 8, 63, 64, 700, 4000]), i * 7 % 300, i))
    pts = [(rng.choice([0, 1, 2, 3, None]), rng.randint(-600, 6000)) for _ in range(600)]
    p = spark.createDataFrame(pts, "k long, t long")
    v = spark.createDataFrame(iv, "k long, a long, b long, r long, id long")
    want = {}
    for k, t in pts:
        hits = [(r, i) for kk, a, b, r, i in iv if kk == k and a <= t <= b]
        want[k, t] = min(hits)[1] if hits else None
    for few in (0, 70, 10**6):
        rows = joins.first_covering(p, v, "k", "t", "a", "b", "r", "id", "f", few).collect()
        assert len(rows) == len(pts) and {(r.k, r.t): r.f for r in rows} == want


def test_stay_lookup_edges(spark):
    day = 86400
    stays = spark.createDataFrame([(1, 10, 100, 10 * day, 12 * day), (1, 10, 101, 11 * day, 14 * day), (2, 20, 200, 0, day)], "subject_id long, hadm_id long, icustayid long, intime long, outtime long")
    ev = spark.createDataFrame([
        (1, 10, 8 * day), (1, 10, 8 * day - 1), (1, 10, 16 * day), (1, 10, 16 * day + 1), (1, None, 12 * day), (2, 20, 90 * day), (3, None, 5)],
        "subject_id long, hadm_id long, charttime long").withColumn("icustayid", F.lit(None).cast("long"))
    got = {(r.subject_id, r.charttime): r.icustayid for r in joins.impute_stay_ids(ev, stays).collect()}
    assert got == {(1, 8 * day): 100, (1, 8 * day - 1): None, (1, 16 * day): 101, (1, 16 * day + 1): None, (1, 12 * day): 100, (2, 90 * day): 200, (3, 5): None}


def test_closed_bins_and_volumes_against_loops(spark):
    rng = random.Random(6)
    w, n = 10, 6
    iv = [(rng.randint(0, 2), a, a + rng.randint(0, 30), rng.choice([None, 1.0, 2.0])) for a in [rng.randint(-15, 65) for _ in range(120)]]
    starts = spark.createDataFrame([(s, 0) for s in range(3)], "s long, beg long")
    df = spark.createDataFrame(iv, "s long, a long, b long, r double")
    for doubled in (False, True):
        want = {}
        for s, a, b, r in iv:
            for j in range(n):
                t0, t1 = j * w, (j + 1) * w
                if r is None or a > t1 or b < t0:
                    continue
                if doubled:
                    x = ((b - a) * (b <= t1 and a >= t0) + (b - t0) * (a <= t0 and t0 <= b <= t1)
                         + (t1 - a) * (t0 <= a <= t1 and b >= t1) + (t1 - t0) * (b >= t1 and a <= t0))
                else:
                    x = max(min(b, t1) - max(a, t0), 0)
                want[s, j] = want.get((s, j), 0.0) + r * x / 3600
        got = {(r.s, r.bin): r.volume for r in bins.interval_volumes(df, starts, "s", "a", "b", "r", w, n, doubled).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    pts = [(0, t) for t in (0, 5, 10, 20, 59, 60, 61)]
    rows = spark.createDataFrame(pts, "s long, t long")
    got = sorted((r.t, r.bin) for r in bins.explode_points(rows, starts, "s", "t", w, n).collect())
    assert got == sorted((t, j) for _, t in pts for j in range(n) if j * w <= t <= (j + 1) * w)
    last = {r.t: r.bin for r in bins.row_bins(rows, starts, "s", "t", w, n, ["t"]).collect()}
    assert last == {0: 0, 5: 0, 10: 1, 20: 2, 59: 5, 60: 5, 61: None}


def test_median_of_large_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", "c"]), float(rng.randint(0, 50))) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    a = sorted(map(tuple, bins.median_max(df, ["k"], "v", "m", "x", 10**9).collect()))
    assert a == sorted(map(tuple, bins.median_max(df, ["k"], "v", "m", "x", 20).select("k", "m", "x").collect()))


def trace_q(traces, draws, gamma, alpha):
    q = {}
    for d in draws:
        tr = traces[d]
        g = tr[-1][2]
        for s, a, r in reversed(tr[:-1]):
            if a >= 0:
                q[s, a] = (1 - alpha) * q.get((s, a), 0.0) + alpha * g
            g = g * gamma + r
    return q


def test_averaged_q_against_the_update_loop(spark):
    rng = random.Random(10)
    traces = {s: [(rng.randint(0, 3), rng.randint(0, 2), rng.uniform(-1, 1)) for _ in range(rng.randint(1, 7))] for s in range(9)}
    for tr in traces.values():
        tr[-1] = (9, -1, rng.choice([100.0, -100.0]))
    rows = [(s, b + 1, st, a, 0, r) for s, tr in traces.items() for b, (st, a, r) in enumerate(tr)]
    rec = spark.createDataFrame(rows, "icustayid long, bloc long, state int, action int, outcome int, reward double")
    draws = ope.sampled_traces(rec, "icustayid", 60, 2)
    order = {}
    for r in draws.orderBy("replicate", "draw").collect():
        order.setdefault(r.replicate, []).append(r.icustayid)
    for limit in (10**9, 15):
        got = {}
        for r in ope.td_q(rec, draws, 0.9, 0.1, hot_rows=limit).collect():
            got.setdefault(r.replicate, {})[r.state, r.action] = r.q
        for rep, ds in order.items():
            want = trace_q(traces, ds, 0.9, 0.1)
            assert want.keys() == got[rep].keys() and all(abs(want[k] - got[rep][k]) < 1e-9 for k in want)
    q, n = ope.td_q_until_stable(rec, rec, chunk=20, max_draws=40)
    assert n in (20, 40) and q.count() > 0


def test_trace_updates_merge_in_blocks_and_chunks(spark):
    rng = random.Random(21)
    stays = {s: [(rng.randint(0, 1), rng.randint(0, 1), rng.uniform(-9, 9)) for _ in range(rng.randint(1, 9))] for s in range(15)}
    rows = [(s, b, st, a if b < len(t) else -1, r) for s, t in stays.items() for b, (st, a, r) in enumerate(t, 1)]
    rec = spark.createDataFrame(rows, "icustayid long, bloc long, state int, action int, reward double")
    updates = ope.trace_updates(rec, 0.9, 0.1)

    def table(df):
        return {(r.replicate, r.state, r.action): (r.n, r.v) for r in df.collect()}

    flat = ope.averaged_q(spark.createDataFrame([(0, i, float(x)) for i, x in enumerate((3, 1, 2))], "k int, i int, g double"), ["k"], ["i"], "g", 0.5)
    assert abs(flat.first().q - (0.5 * 3 + 0.25 * 1 + 0.125 * 2)) < 1e-12
    draws = ope.sampled_traces(rec, "icustayid", 90, 2)
    whole = table(ope.drawn_updates(updates, draws, 0.1))
    assert len({k[0] for k in whole}) == 2 and max(n for n, _ in whole.values()) > 50
    early, late = (ope.sampled_traces(rec, "icustayid", 90, 2, first=a, last=b) for a, b in ((0, 37), (37, 90)))
    assert sorted(map(tuple, early.unionByName(late).collect())) == sorted(map(tuple, draws.collect()))
    parts = ope.extend_updates(ope.drawn_updates(updates, early, 0.1), ope.drawn_updates(updates, late, 0.1), 0.1)
    for other in (table(ope.drawn_updates(updates, draws, 0.1, block=4)), table(parts)):
        assert other.keys() == whole.keys()
        assert all(other[k][0] == n and abs(other[k][1] - v) < 1e-9 for k, (n, v) in whole.items())
    q, n = ope.td_q_until_stable(rec, rec, chunk=25, max_draws=60, gamma=0.9, change=0.0)
    want = table(ope.drawn_updates(updates, ope.sampled_traces(rec, "icustayid", 60), 0.1))
    assert n == 60 and {(r.replicate, r.state, r.action): round(r.q, 9) for r in q.collect()} == {k: round(v, 9) for k, (_, v) in want.items()}


def test_future_returns_over_long_series(spark):
    rng = random.Random(2)
    r = [rng.uniform(-1, 1) for _ in range(400)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(r)] + [(1, 0, 5.0)], "s long, i long, r double")
    for gamma in (1.0, 0.99, 0.3):
        want, g = {}, 0.0
        for i in reversed(range(400)):
            want[0, i] = g
            g = r[i] + gamma * g
        want[1, 0] = 0.0
        for limit in (10**9, 50):
            got = {(x.s, x.i): x.ret for x in ope.future_returns(df, ["s"], "i", "r", gamma, hot_rows=limit).collect()}
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want), gamma


def test_wis_against_a_loop(spark):
    rng = random.Random(12)
    stays = {s: [(rng.uniform(0.1, 1), rng.uniform(0.1, 1)) for _ in range(rng.randint(1, 6))] for s in range(30)}
    stays[3][0] = (0.0, 0.5)
    rows = [(s, b + 1, p, m, s % 2) for s, tr in stays.items() for b, (p, m) in enumerate(tr)]
    df = spark.createDataFrame(rows, "icustayid long, bloc long, b double, t double, outcome int")
    num = den = 0.0
    for s, tr in stays.items():
        if any(p == 0 for p, _ in tr):
            continue
        rho = math.prod(m / p for p, m in tr)
        rewards = [0.0] * (len(tr) - 1) + [-100.0 if s % 2 else 100.0]
        num += rho * sum(0.99 ** (k - 1) * x for k, x in enumerate(rewards))
        den += rho
    ratios = ope.stay_ratios(df, "b", "t", "outcome")
    assert abs(ope.weighted_value(ratios).first().wis - num / den) < 1e-9
    same = ope.stay_ratios(df.withColumn("t", F.col("b")).filter("b > 0"), "b", "t", "outcome")
    mean = same.agg(F.avg("g")).first()[0]
    assert abs(ope.weighted_value(same).first().wis - mean) < 1e-9


def test_bootstrap_sample_size_and_prefilter(spark):
    ratios = spark.range(2000).select(F.col("id").alias("icustayid"), F.lit(1.0).alias("rho"), F.lit(1.0).alias("g"))
    s = ope.bootstrap_samples(ratios, 5, 0.75, most=100)
    counts = s.groupBy("replicate").agg(F.count("*").alias("n"), F.countDistinct("icustayid").alias("d")).collect()
    assert len(counts) == 5 and all(r.n == 100 and r.d == 100 for r in counts)
    all_hashes = {r.icustayid: r.h for r in ratios.select("icustayid", ope.hash_order(F.col("icustayid"), F.lit(0), "boot").alias("h")).collect()}
    lowest = set(sorted(all_hashes, key=all_hashes.get)[:100])
    assert {r.icustayid for r in s.filter("replicate = 0").collect()} == lowest


def dense_bends(t, x):
    """Second derivatives by a dense solve of the conditions at the inner knots."""
    n = len(t)
    a, rhs = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        h, g = t[i] - t[i - 1], t[i + 1] - t[i]
        a[i, i - 1 : i + 2] = h, 2 * (h + g), g
        rhs[i] = 6 * ((x[i + 1] - x[i]) / g - (x[i] - x[i - 1]) / h)
    return np.linalg.solve(a, rhs)


def test_spline_pieces_equal_the_whole(spark):
    rng = np.random.default_rng(7)
    data, want = [], {}
    for s in (None, 1, 2):
        t = np.cumsum(rng.uniform(0.1, 3, 700 if s is None else 5))
        x = rng.normal(size=len(t))
        m = dense_bends(t, x)
        data += [(s, float(a), float(b)) for a, b in zip(t, x)]
        for i in range(len(t) - 1):
            want[s, float(t[i])] = (t[i], t[i + 1], x[i], x[i + 1], m[i], m[i + 1])
    df = spark.createDataFrame(data, "s long, t double, v double")
    for limit in (150, 10**9):
        rows = series.spline_coefficients(df, ["s"], "t", "v", piece=100, halo=70, groups=5, hot_rows=limit).collect()
        got = {(r.s, r.t): tuple(r[c] for c in series.SPAN) for r in rows}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)


def test_spline_gaps_and_values(spark):
    data = [(0, 0.0, None), (0, 1.0, 2.0), (0, 2.0, None), (0, 4.0, 3.0), (0, 5.0, None), (1, 0.0, None), (1, 1.0, None)]
    df = spark.createDataFrame(data, "s long, t double, v double")
    c = series.spline_coefficients(df, ["s"], "t", "v")
    assert c.filter("s = 0").count() == 4 and c.filter("s = 1").first()[4:] == (0.0, 0.0, 0.0, 0.0)
    t, x = np.array([0, 1, 4, 5.0]), np.array([2, 2, 3, 3.0])
    m = dense_bends(t, x)

    def value(q):
        i = min(max(int((q > t).sum()) - 1, 0), 2)
        h = t[i + 1] - t[i]
        u, w = (t[i + 1] - q) / h, (q - t[i]) / h
        return u * x[i] + w * x[i + 1] + h * h / 6 * (m[i] * (u**3 - u) + m[i + 1] * (w**3 - w))

    asked = spark.createDataFrame([(0, q) for q in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.3, 5.0, 6.0)], "s long, q double")
    for r in series.spline_values(c, asked, ["s"], "q").collect():
        assert abs(r.value - value(r.q)) < 1e-9
        if r.q not in (0.0, 1.0):
            assert abs(r.slope - (value(r.q + 1e-6) - value(r.q - 1e-6)) / 2e-6) < 1e-4


def test_policy_iteration_against_dense_linear_algebra(spark):
    rng = np.random.default_rng(1)
    n, a, gamma = 6, 3, 0.95
    s_all = n + 2
    p, rew = np.zeros((s_all, a, s_all)), np.zeros((s_all, a))
    for s in range(n):
        for k in range(a):
            if rng.random() < 0.8:
                w = rng.random(s_all) * (rng.random(s_all) < 0.6)
                if w.sum():
                    p[s, k] = w / w.sum()
    rew[:, :] = 100 * (p[:, :, n + 1] - p[:, :, n])
    rows = [(s, k, t, float(p[s, k, t])) for s in range(s_all) for k in range(a) for t in range(s_all) if p[s, k, t]]
    model = spark.createDataFrame(rows, "state int, action int, next_state int, p double")
    r = mdp.expected_reward(model, n)
    policy = np.ones(s_all, dtype=int)
    while True:
        pp, rr = p[np.arange(s_all), policy], rew[np.arange(s_all), policy]
        v = np.linalg.solve(np.eye(s_all) - gamma * pp, rr)
        q = rew + gamma * p @ v
        better = q.argmax(axis=1)
        if (better == policy).all():
            break
        policy = better
    got_policy, got_q, _ = mdp.policy_iteration(model, r, s_all, a, gamma)
    gq = {(x.state, x.action): x.q for x in got_q.collect()}
    assert all(abs(gq[s, k] - q[s, k]) < 1e-6 for s in range(s_all) for k in range(a))
    assert {x.state: x.action for x in got_policy.collect()} == {s: int(policy[s]) for s in range(s_all)}


def test_policy_values_of_a_full_size_model(spark):
    rng = np.random.default_rng(2)
    n, actions, gamma = 752, 25, 0.99
    s, a = np.repeat(np.arange(n - 2), actions * 4), np.tile(np.repeat(np.arange(actions), 4), n - 2)
    rows = pd.DataFrame({"state": s, "action": a, "next_state": rng.integers(0, n, len(s)), "p": rng.random(len(s))})
    rows = rows.groupby(["state", "action", "next_state"], as_index=False)["p"].sum()
    rows["p"] /= rows.groupby(["state", "action"])["p"].transform("sum")
    model = spark.createDataFrame(rows, "state int, action int, next_state int, p double")
    rewards = cut_lineage(mdp.expected_reward(model, n - 2))
    policy = pd.DataFrame({"state": np.arange(n), "action": rng.integers(0, actions, n)})
    kept = rows.merge(policy, on=["state", "action"])
    step, gain = np.zeros((n, n)), np.zeros(n)
    step[kept.state, kept.next_state] = kept.p
    gain = 100 * (step[:, n - 1] - step[:, n - 2])
    want = np.linalg.solve(np.eye(n) - gamma * step, gain)
    acts = spark.createDataFrame(policy, "state int, action int")
    got = mdp.evaluate_policy(model, rewards, acts, gamma, tolerance=1e-7)
    v = got.toPandas().set_index("state")["v"].sort_index().to_numpy()
    assert len(v) == n and np.abs(v - want).max() <= 1e-7
    warm = mdp.evaluate_policy(model, rewards, acts, gamma, tolerance=1e-6, max_sweeps=1, values=got)
    assert np.abs(warm.toPandas().set_index("state")["v"].sort_index().to_numpy() - want).max() <= 1e-6
    with pytest.raises(RuntimeError):
        mdp.evaluate_policy(model, rewards, acts, gamma, max_sweeps=2)
    with pytest.raises(ValueError):
        mdp.evaluate_policy(model, rewards, acts, 1.0)


def test_policy_and_model_invariants(spark):
    rng = random.Random(3)
    rows = [(s, b, rng.randint(0, 3), rng.randint(0, 4), s % 2) for s in range(60) for b in range(1, 9)]
    df = spark.createDataFrame(rows, "icustayid long, bloc long, state int, action int, outcome int")
    rec = mdp.complete_records(df, 4)
    assert rec.filter("action = -1").count() == 60
    c = mdp.transition_counts(rec, 2)
    sums = mdp.transition_model(c).groupBy("state", "action").agg(F.sum("p").alias("p")).collect()
    assert sums and all(abs(x.p - 1) < 1e-12 for x in sums)
    clin = mdp.clinician_policy(c)
    for soft in (mdp.soft_clinician(clin, 4, 5), mdp.soft_best(mdp.full_q(mdp.backup(mdp.transition_model(c), mdp.expected_reward(mdp.transition_model(c), 4), spark.createDataFrame([(0, 0.0)], "state int, v double"), 0.9), 6, 5), 5)):
        tot = soft.groupBy("state").agg(F.sum("p").alias("p"), F.min((F.col("p") > 0).cast("int")).alias("pos")).collect()
        assert all(x.pos == 1 for x in tot)
    best = soft.groupBy("state").agg(F.sum("p").alias("p")).collect()
    assert all(abs(x.p - 1) < 1e-12 for x in best)

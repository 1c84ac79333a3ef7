"""Scans, quantiles and numbering give the same result when a key is split as when it is not."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.operators import scan as S


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows in one key, bursts of equal leading times, nulls."""
    rng = random.Random(3)
    data, i = [], 0
    for key, n in [("hot", 600), ("warm", 250)] + [(f"k{j}", rng.randint(1, 20)) for j in range(80)]:
        t = 0
        for _ in range(n):
            t += rng.choice([0, 0, 1, 5, 60])
            data.append((key, t, i, rng.choice([None, float(rng.randint(0, 99))])))
            i += 1
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t long, id long, v double").repartition(5)


def steps():
    v = F.col("v")
    return {
        "cum": S.running_sum(v), "rest": S.remaining_sum(v), "rn": S.row_number(), "back": S.row_number_from_end(),
        "last": S.last_known(v), "next": S.next_known(v), "before": S.known_before(v), "after": S.known_after(v),
        "prev": S.previous(v), "foll": S.following(v),
        "pair": S.known_before(F.when(v > 50, F.struct("id", "v"))),
    }


def table(df, key="id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


@pytest.mark.parametrize("keys,order", [(["k"], ["t", "id"]), ([], ["id"])])
def test_split_keys_change_nothing(rows, keys, order):
    plain = table(S.scan(rows, keys, order, steps(), hot_rows=10**9))
    for limit in (40, 200):
        assert table(S.scan(rows, keys, order, steps(), hot_rows=limit)) == plain


def test_many_carries_are_joined_not_broadcast(rows, monkeypatch):
    plain = table(S.scan(rows, ["k"], ["t", "id"], steps(), hot_rows=10**9))
    monkeypatch.setattr(S, "CARRY_CELLS", 10)
    assert table(S.scan(rows, ["k"], ["t", "id"], steps(), hot_rows=40)) == plain
    rows.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.scan(rows, ["k"], ["t", "id"], steps(), hot_rows=40)._jdf.queryExecution().toString()
    finally:
        rows.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_scan_against_a_loop(rows):
    got = table(S.scan(rows, ["k"], ["t", "id"], steps(), hot_rows=50))
    per = {}
    for r in sorted(got.values(), key=lambda r: (r["t"], r["id"])):
        per.setdefault(r["k"], []).append(r)
    for seq in per.values():
        vs = [r["v"] for r in seq]
        for i, r in enumerate(seq):
            past, ahead = vs[:i], vs[i + 1:]
            known = lambda xs: next((x for x in xs if x is not None), None)
            assert r["rn"] == i + 1 and r["back"] == len(vs) - i
            assert r["cum"] == sum(x or 0 for x in vs[:i + 1]) and r["rest"] == sum(x or 0 for x in vs[i:])
            assert r["last"] == known(vs[i::-1]) and r["next"] == known(vs[i:])
            assert r["before"] == known(past[::-1]) and r["after"] == known(ahead)
            assert r["prev"] == (past[-1] if past else None) and r["foll"] == (ahead[0] if ahead else None)


def test_hot_list_is_measured(rows):
    assert S.find_hot(rows, ["k"], "t", 200) == rows.count()
    assert S.find_hot(rows, ["k"], "t", 10**6) == 0
    assert S.find_hot(rows.limit(0), ["k"], "t", 1) == 0


def test_quantiles_by_rank_equal_the_aggregate(rows):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99, "f": 1.0}
    for keys in (["k"], []):
        plain = sorted(map(tuple, S.exact_quantiles(rows, keys, "v", probs, 10**9).collect()), key=str)
        split = sorted(map(tuple, S.exact_quantiles(rows, keys, "v", probs, 30).collect()), key=str)
        assert len(plain) == len(split)
        for x, y in zip(plain, split):
            assert x[:len(keys)] == y[:len(keys)] and np.allclose(x[len(keys):], y[len(keys):])


def test_quantiles_equal_numpy(spark):
    xs = np.random.default_rng(0).normal(size=501)
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    row = S.exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.937}, 20).first()
    assert np.allclose(list(row), np.quantile(xs, [0.1, 0.5, 0.937]))


def test_global_numbers_with_a_heavy_first_column(spark):
    rng = random.Random(1)
    data = [(7 if rng.random() < 0.5 else rng.randint(0, 30), i) for i in range(800)]
    df = spark.createDataFrame(data, "a long, b long").repartition(4)
    want = {x: i + 1 for i, x in enumerate(sorted(data))}
    for limit in (50, 10**9):
        got = {(r.a, r.b): r.row for r in S.number_rows(df, ["a", "b"], hot_rows=limit).collect()}
        assert got == want


def test_number_of_partitions_does_not_matter(spark, rows):
    want = None
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = table(S.scan(rows, ["k"], ["t", "id"], steps(), hot_rows=100))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def heavy(kind):
    """Shapes in which one value takes most rows: a null key, one order value, null order values, very many heavy keys."""
    n = 2000
    if kind == "null key":
        return [(None if i % 10 else "x", i // 3, i) for i in range(n)]
    if kind == "one order value":
        return [("h", 7, i) for i in range(n)]
    if kind == "null order":
        return [("h" if i % 4 else None, None if i % 3 else i, i) for i in range(n)]
    return [(f"k{i % 15}", i % 2, i) for i in range(n)]


@pytest.mark.parametrize("kind", ["null key", "one order value", "null order", "many keys"])
def test_no_range_holds_a_heavy_key(spark, kind):
    df = spark.createDataFrame([(*r, float(r[2] % 7) if r[2] % 3 else None) for r in heavy(kind)], "k string, t long, id long, v double").repartition(6)
    dealt = S.deal_ranges(df, ["k"], ["t", "id"], 2000, 100)
    assert dealt.groupBy(S.PIECE).count().agg(F.max("count")).first()[0] <= 400
    for keys in (["k"], []):
        assert table(S.scan(df, keys, ["t", "id"], steps(), hot_rows=100)) == table(S.scan(df, keys, ["t", "id"], steps(), hot_rows=10**9))
    numbers = [{r["id"]: r["row"] for r in S.number_rows(df, ["t", "id"], hot_rows=limit).collect()} for limit in (100, 10**9)]
    assert numbers[0] == numbers[1] and sorted(numbers[0].values()) == list(range(1, 2001))


def test_sizes_change_no_answer_with_null_keys(spark):
    from careflow.operators import bins, ope, report

    rows = [(None if i % 4 == 0 else i % 3, i, float(i % 50), float(i % 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, t long, v double, o double")

    def sorted_rows(out):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.collect()), key=str)

    for make in (
        lambda n: bins.median_max(df, ["k"], "v", "m", "x", n),
        lambda n: ope.future_returns(df.withColumn("r", F.lit(1.0)), ["k"], "t", "r", 0.5, hot_rows=n).select("k", "t", "ret"),
        lambda n: report.excess_per_stay(df.select("k", F.col("o").alias("outcome"), F.col("v").alias("fluid_excess"), F.col("v").alias("vaso_excess")), "k", n),
    ):
        few, many = sorted_rows(make(100)), sorted_rows(make(10**9))
        assert few == many and any(r[0] is None for r in few)
    ret = {(r.k, r.t): r.ret for r in ope.future_returns(df.withColumn("r", F.lit(1.0)), ["k"], "t", "r", 0.5, hot_rows=100).collect()}
    assert all(abs(x - 2.0) < 1e-9 for (_, t), x in ret.items() if t < 900)

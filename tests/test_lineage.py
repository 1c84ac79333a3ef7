"""Lineage walks against a loop on random logs, and the number of written rounds on deep ones."""

import random

import pytest

from careflow.operators import lineage

SCHEMA = "seq long, value_row long, value_col string, change_type string, metadata string, reference_row long, reference_col string"


def frame(spark, records):
    """Records (seq, row, col, reference row, reference col)."""
    return spark.createDataFrame([(s, r, c, "x", None, a, b) for s, r, c, a, b in records], SCHEMA)


def by_loop(records, cells, backward):
    out = set()
    full = [(s, (r, c), (r if a is None else a, c if b is None else b)) for s, r, c, a, b in records]
    for cell in cells:
        todo, done = [(cell, float("inf") if backward else float("-inf"))], {}
        while todo:
            here, bound = todo.pop()
            for s, own, other in full:
                at, there = (own, other) if backward else (other, own)
                if at == here and (s < bound if backward else s > bound) and s not in done:
                    done[s] = True
                    todo.append((there, s))
        out |= {(*cell, s) for s in done}
    return out


def random_log(seed, n, rows, cols, own):
    rng = random.Random(seed)
    out = []
    for s in rng.sample(range(10 * n), n):
        a, b = (None if rng.random() < own else rng.randrange(rows)), (None if rng.random() < 0.5 else rng.choice(cols))
        out.append((s, rng.randrange(rows), rng.choice(cols), a, b))
    return out


@pytest.mark.parametrize("seed,n,rows,own", [(2, 150, 30, 0.1), (4, 60, 2, 0.6)])
def test_walks_by_loop(spark, seed, n, rows, own):
    records = random_log(seed, n, rows, ["a", "b"], own)
    log = frame(spark, records)
    asked = spark.createDataFrame([(r,) for r in range(0, rows, 2)], "value_row long")
    cells = {(r, c) for _, r, c, _, _ in records if r % 2 == 0 and c == "a"}
    got = lineage.dependencies(log, asked, ["a"])[1].collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_loop(records, cells, True)
    sources = {(r if a is None else a, c if b is None else b) for _, r, c, a, b in records}
    got = lineage.descendants(log, asked, ["a"])[1].collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_loop(records, {x for x in sources if x[0] % 2 == 0 and x[1] == "a"}, False)


def test_walks_by_loop_with_large_cells(spark):
    """Every cell counts as a large key of the scans."""
    records = random_log(7, 120, 3, ["a"], 0.2)
    spark.conf.set("spark.careflow.hotRows", "10")
    try:
        got = lineage.dependencies(frame(spark, records), None, ["a"])[1].collect()
    finally:
        spark.conf.unset("spark.careflow.hotRows")
    assert {tuple(r) for r in got} == by_loop(records, {(r, "a") for _, r, _, _, _ in records}, True)


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    """5000 hops; every cell is changed once more in place, which adds no way on."""
    writes, cut = [], lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df, name="cut": writes.append(name) or cut(df, name))
    n = 5000
    records = [(2 * i, i, "v", i - 1 if i else None, None) for i in range(n)] + [(2 * i + 1, i, "v", None, None) for i in range(n)]
    last = spark.createDataFrame([(n - 1,)], "value_row long")
    assert lineage.dependencies(frame(spark, records), last)[1].count() == 2 * n
    assert writes.count("jumps") < 15 and len(writes) < 20
    first = spark.createDataFrame([(0,)], "value_row long")
    assert lineage.descendants(frame(spark, records), first)[1].count() == 2 * n


def test_empty_log(spark):
    log = frame(spark, [])
    assert lineage.dependencies(log)[1].count() == lineage.descendants(log)[1].count() == 0

"""Clustering with all starts in one pass, against a loop and against the built-in fit."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from careflow.operators import clusters


def test_all_starts_of_a_clustering_match_a_loop(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    x = np.vstack([x, x[:20]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)], "id long, x double, y double")
    first = [(s, c, *x[rng.integers(0, 180)].tolist()) for s in range(5) for c in range(4)] + [(5, c, *x[c].tolist()) for c in range(3)] + [(5, 3, 99.0, 99.0)]
    got = clusters.fit(df, ["x", "y"], share=1, max_iter=6, initial=spark.createDataFrame(first, "start int, centre int, x double, y double"), tolerance=0)
    want = []
    for s in range(6):
        c = np.array([r[2:] for r in first if r[0] == s])
        for _ in range(6):
            near = [int(((c - p) ** 2).sum(axis=1).argmin()) for p in x]
            c = np.array([x[[i for i, n in enumerate(near) if n == k]].mean(axis=0) if k in near else c[k] for k in range(4)])
        want.append((sum(float(((c - p) ** 2).sum(axis=1).min()) for p in x), c))
    assert np.allclose(got.costs, [w[0] for w in want]) and got.cost == min(got.costs)
    assert np.allclose(got.centres, want[int(np.argmin(got.costs))][1])
    out = {r.id: (r.state, r.d) for r in clusters.assign(df, got, ["x", "y"], distance="d").collect()}
    assert len(out) == 203 and out[900] == out[901] == out[902] == (None, None)
    for i, p in enumerate(x):
        d = ((got.centres - p) ** 2).sum(axis=1)
        assert out[i][0] == int(d.argmin()) and abs(out[i][1] - d.min()) < 1e-9


def test_clustering_with_few_different_rows(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(40)], "id long, x double")
    got = clusters.fit(df, ["x"], k=10, share=1, starts=3)
    assert sorted(c[0] for c in got.centres) == [0.0, 1.0, 2.0] and got.cost == 0
    assert clusters.assign(df, got, ["x"]).filter("state is null").count() == 0
    with pytest.raises(ValueError):
        clusters.fit(df.filter("id < 0"), ["x"], k=2, share=1)


def test_clustering_costs_no_more_than_the_built_in_fit(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(rng.integers(0, 12, (3000, 1)) * 3.0, 1.0, (3000, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = clusters.fit(df, ["a", "b", "c", "d"], k=24, share=1, starts=8)
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    assert got.cost <= min(KMeans(k=24, maxIter=30, seed=s).fit(rows).summary.trainingCost for s in range(2)) * 1.001


def test_copies_do_not_crowd_out_first_centres(spark):
    rows = [(1.0, 1.0)] * 900 + [(float(i), float(i % 7)) for i in range(100, 140)]
    got = clusters.fit(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], k=41, share=1, starts=2)
    assert len(got.centres) == 41 and got.cost == 0


def test_blocks_meet_few_centres_and_find_the_nearest():
    rng = np.random.default_rng(2)
    x, centres = rng.uniform(size=(60_000, 4)), rng.uniform(size=(300, 4))
    x[:5000] = x[0]
    order = clusters.in_blocks(x, clusters.BLOCK)
    assert sorted(order) == list(range(len(x)))
    x = x[order]
    blocks = [x[a:a + clusters.BLOCK] for a in range(0, len(x), clusters.BLOCK)]
    boxes = [(b, b.min(axis=0), b.max(axis=0)) for b in blocks]
    got, want = clusters._nearest_in(boxes, centres), clusters.nearest(x, centres)
    assert (got[0] == want[0]).all() and np.allclose(got[1], want[1])
    assert np.mean([len(clusters.in_reach(lo, hi, centres)) for _, lo, hi in boxes]) < 100
    centres[7, 2] = np.nan
    assert (clusters._nearest_in(boxes[:3], centres)[0] == clusters.nearest(np.concatenate(blocks[:3]), centres)[0]).all()


def test_boxes_of_a_tree_settle_most_rows():
    """Many rows for each centre: counts, sums, costs and states are those of a full scan, and most rows are never looked at."""
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(40_000, 2)) * [3, 1] + 1000
    x[:3000] = x[0]
    tree = clusters.Tree(x[clusters.in_blocks(x, clusters.LEAF)])
    live = np.stack([x[rng.choice(len(x), 12, replace=False)] for _ in range(5)])
    live[3, 5] = live[3, 2]
    live[4] -= 5000
    boxes, rows = tree.settle(live)
    assert sum(len(place) for _, place, _ in rows) < live.shape[0] * len(x) / 5
    want = np.concatenate([clusters._add_rows(tree.rows, *clusters.nearest(tree.rows, c), 12) for c in live])
    got = tree.totals(live)
    assert (got[:, 0] == want[:, 0]).all() and np.allclose(got, want, rtol=1e-9, atol=1e-9)
    for c in live:
        for a, b in zip(tree.nearest(c), clusters.nearest(tree.rows, c)):
            assert (a == b).all()
    live[1, 7, 0] = np.nan
    assert (tree.nearest(live[1])[0] == clusters.nearest(tree.rows, live[1])[0]).all()
    assert (tree.totals(live)[12:24, 0] == np.bincount(clusters.nearest(tree.rows, live[1])[0], minlength=12)).all()


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100, 1024, 1500])
def test_trees_of_any_number_of_rows(n):
    rng = np.random.default_rng(n)
    x, centres = rng.normal(size=(n, 3)), rng.normal(size=(2, 70, 3))
    order = clusters.in_blocks(x, clusters.LEAF)
    assert sorted(order.tolist()) == list(range(n))
    tree = clusters.Tree(x[order])
    assert tree.levels[0][2].sum() == n and (np.diff(tree.ends) > 0).all()
    want = np.concatenate([clusters._add_rows(tree.rows, *clusters.nearest(tree.rows, c), 70) for c in centres])
    assert np.allclose(tree.totals(centres), want)
    state, far = clusters._nearest_of(x, centres[0])
    assert (state == clusters.nearest(x, centres[0])[0]).all() and np.allclose(far, clusters.nearest(x, centres[0])[1])


def test_chunks_hold_near_rows(spark, monkeypatch):
    """All rows are in chunks of bounded size, near ones together; rows of which a third are equal are dealt to several partitions."""
    monkeypatch.setattr(clusters, "CHUNK", 512)
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(9000, 2))
    x[:3000] = x[0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double").repartition(3)
    made = clusters._chunks(df, 2, [clusters._draw(2, 0, i) for i in range(2)])
    chunks = [np.frombuffer(r["points"]).reshape(-1, 2) for r in made.collect()]
    assert all(len(r["draws"]) == len(r["points"]) for r in made.collect()) and max(map(len, chunks)) <= 512
    assert sorted(map(tuple, np.concatenate(chunks))) == sorted(map(tuple, x))
    feature, cut, child = clusters._regions(x, 16)
    node = clusters._region(x, feature, cut, child)
    assert (feature[node] == -1).all() and len(set(node.tolist())) > 8
    assert len(set(clusters._region(x[:3000], feature, cut, child).tolist())) == 1
    sizes = [sum(1 for c in [np.frombuffer(r["points"]).reshape(-1, 2)] if (c == x[0]).all(axis=1).sum() > 50) for r in made.collect()]
    assert sum(sizes) > 1


def test_assignment_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        rng = np.random.default_rng(7)
        centres = rng.uniform(size=(90, 2))
        x = rng.uniform(size=(5000, 2))
        rows = [(i, float(a) if i % 50 else None, float(b)) for i, (a, b) in enumerate(x)]
        model = clusters.Clusters(centres, 0.0, [], [])
        got = {r.id: (r.state, r.d) for r in clusters.assign(spark.createDataFrame(rows, "id long, x double, y double").repartition(3), model, ["x", "y"], distance="d").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, far = clusters.nearest(x, centres)
    assert len(got) == 5000
    for i in range(5000):
        assert got[i] == ((None, None) if i % 50 == 0 else (state[i], pytest.approx(far[i])))

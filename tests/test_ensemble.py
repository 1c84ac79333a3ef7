"""Many models in the same jobs against one model at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from careflow import session
from careflow.operators import clusters, dataset, ensemble, mdp, ope
from careflow.sources import io

MODELS, STATES, ACTIONS = 2, 5, 3


@pytest.fixture(scope="module")
def visits(spark):
    rng = np.random.default_rng(5)
    rows = [
        (stay, bloc, [int(s) for s in rng.integers(0, STATES, MODELS)], int(rng.integers(0, ACTIONS)), stay % 2)
        for stay in range(60) for bloc in range(1, int(rng.integers(2, 12)))
    ]
    return spark.createDataFrame(rows, "icustayid long, bloc long, states array<int>, action int, outcome int")


def one(visits, m):
    return dataset.split_by_key(visits.withColumn("state", F.get("states", F.lit(m))), "icustayid", 0.7, f"model-{m}", "part")


def same(a, b, keys, value):
    x, y = (d.select(*keys, value).toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(x) and (x[keys].to_numpy() == y[keys].to_numpy()).all()
    np.testing.assert_allclose(x[value], y[value], rtol=1e-6, atol=1e-6)


def test_each_model_is_as_trained_alone(spark, visits):
    out = ensemble.train(visits, MODELS, STATES, ACTIONS, 0.7, gamma=0.9, threshold=1, replicates=5, tolerance=1e-9)
    for m in range(MODELS):
        rows = one(visits, m)
        counts = mdp.transition_counts(mdp.complete_records(rows.filter("part = 'train'"), STATES), 1)
        same(out["counts"].filter(F.col("model") == m), counts, ["state", "action", "next_state"], "n")
        p = mdp.transition_model(counts)
        q = mdp.policy_iteration(p, mdp.expected_reward(p, STATES), STATES + 2, ACTIONS, 0.9, tolerance=1e-9)[1]
        same(out["q"].filter(F.col("model") == m), q, ["state", "action"], "q")
        both = {"behaviour": mdp.soft_clinician(mdp.clinician_policy(counts), STATES, ACTIONS), "target": mdp.soft_best(q, ACTIONS)}
        scored = mdp.score_rows(rows.filter("part = 'test'"), q, both)
        ratios = ope.stay_ratios(scored, "behaviour", "target", "outcome", 0.9)
        same(out["ratios"].filter(F.col("model") == m), ratios, ["icustayid"], "rho")
        wis = ope.weighted_value(ope.bootstrap_samples(ratios, 5), ["replicate"])
        same(out["wis"].filter(F.col("model") == m), wis, ["replicate"], "wis")
    assert out["train_stats"].count() == MODELS


def test_saved_models_read_back(spark, visits, tmp_path):
    out = ensemble.train(visits, 2, STATES, ACTIONS, 0.7, gamma=0.9, threshold=1, replicates=5)
    assert set(ensemble.save_models(str(tmp_path), out, "all")) == {"model_0", "model_1"}
    saved, params = io.load_model(spark, f"{tmp_path}/model_1", ["q", "policies", "counts"])
    assert params["model"] == "1" and saved["q"].count() == (STATES + 2) * ACTIONS
    assert "worst_model" in ensemble.save_models(str(tmp_path), out)


def test_models_settle_in_their_own_time():
    seen = []

    def step(rows, v):
        seen.append(len(rows))
        return np.where(rows[:, None] == 0, 1.0, 0.5 * v + 1)

    out = ensemble._settle_all(step, np.zeros((3, 2)), 1e-9, 100)
    np.testing.assert_allclose(out, [[1, 1], [2, 2], [2, 2]])
    assert seen[0] == 3 and seen[-1] == 2
    with pytest.raises(RuntimeError):
        ensemble._settle_all(lambda rows, v: v + 1, np.zeros((2, 2)), 1e-9, 3, memory=0)


def test_empty_visits_give_no_counts(spark, visits):
    none = visits.limit(0)
    counts = ensemble.transition_counts(none, ensemble.parts(none, 2), STATES)
    q = ensemble.policy_iteration(ensemble.transition_model(counts), ensemble.expected_reward(ensemble.transition_model(counts), STATES), 2, STATES + 2, ACTIONS, 0.9)[1]
    assert counts.count() == 0 and q.filter("q <> 0").count() == 0 and q.count() == 2 * (STATES + 2) * ACTIONS


def test_states_of_all_models_in_one_pass(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(50), "x": rng.normal(size=50), "y": rng.normal(size=50)})).withColumn("x", F.when(F.col("id") != 7, F.col("x")))
    fits = [clusters.Clusters(rng.normal(size=(4, 2)), 0.0, [], []) for _ in range(3)]
    out = clusters.assign_all(rows, fits, ["x", "y"])
    for m, fit in enumerate(fits):
        same(out.filter("id <> 7").select("id", F.get("states", F.lit(m)).alias("s")), clusters.assign(rows, fit, ["x", "y"], "s").filter("id <> 7"), ["id"], "s")
    assert out.filter("id = 7").first()["states"] is None


@pytest.mark.parametrize("reach", [ope.REACH, 0.0])
def test_bootstrap_values_are_those_of_the_samples_with_few_rows_ranked(spark, monkeypatch, reach):
    monkeypatch.setattr(ope, "REACH", reach)
    made = []
    monkeypatch.setattr(ope, "cut_lineage", lambda df, name: made.append((name, session.cut_lineage(df, name))) or made[-1][1])
    rng = np.random.default_rng(3)
    rows = [(m, s, None if s % 11 == 0 else float(rng.exponential()), float(rng.choice([-90, 80]))) for m in (0, 1, None) for s in range(1500) if (s + (m or 0)) % 3]
    ratios = spark.createDataFrame(rows, "model int, icustayid long, rho double, g double")
    want = ope.weighted_value(ope.bootstrap_samples(ratios, 40, most=600, by=["model"]), ["model", "replicate"])
    got = ope.bootstrap_values(ratios, 40, most=600, by=["model"])
    assert got.columns == want.columns
    a, b = (d.withColumn("model", F.coalesce("model", F.lit(-1))).toPandas().sort_values(["model", "replicate"]) for d in (got, want))
    assert len(a) == 120 and (a[["model", "replicate", "positive"]].to_numpy() == b[["model", "replicate", "positive"]].to_numpy()).all()
    np.testing.assert_allclose(a["wis"], b["wis"], rtol=1e-9)
    assert dict(made)["cuts"].filter("__near").count() < 0.2 * 40 * len(rows)

"""The whole job on small made-up hospital tables."""

import random

import pytest
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.operators import cohort
from careflow.plans import icu
from careflow.sources.io import RAW_TABLES

H, DAY = 3600, 86400


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(21)
    rows = {t: [] for t in RAW_TABLES}
    vital = {i + 1: g[0] for i, g in enumerate(C.VITAL_ITEMS)}
    lab = {i + 1: g[0] for i, g in enumerate(C.LAB_ITEMS)}
    typical = {"HR": 90, "SysBP": 110, "MeanBP": 75, "DiaBP": 60, "RR": 20, "SpO2": 97, "Temp_C": 37, "FiO2_100": 40, "GCS": 14, "Weight_kg": 80,
               "Creatinine": 1.4, "Platelets_count": 180, "Total_bili": 1.1, "paO2": 90, "paCO2": 40, "WBC_count": 11, "Potassium": 4, "Sodium": 138}
    for s in range(1, 25):
        base = 1_000_000_000 + s * 10 * DAY
        died = s % 4 == 0
        rows["demog"].append((s // 2, s, s, base, base + 6 * DAY, 1 + s % 2, 1, base, base + 5 * DAY, 5.0, 16 if s == 3 else 60 + s % 20, 0,
                              base + 20 * DAY if died else None, died, 1 + s % 2, int(died) if s != 5 else None, int(died), 3 if s != 7 else None))
        t_ab = base + 2 * DAY
        rows["abx"].append((s, None if s == 6 else s, t_ab, t_ab + DAY, "002542", "n", "1", "g", "IV"))
        rows["culture"].append((s // 2, s, None if s == 8 else s, t_ab + 2 * H, 6035))
        rows["microbio"].append((s // 2, s, s, None, t_ab + 90 * DAY, 1, 1, 1, "S"))
        for k in range(40):
            t = t_ab + (k - 20) * 2 * H
            for i, name in enumerate(C.VITALS, 1):
                if name in typical and rng.random() < 0.5:
                    rows["ce"].append((s, t, vital[i], typical[name] * rng.uniform(0.8, 1.2)))
            for i, name in enumerate(C.LABS, 1):
                if name in typical and rng.random() < 0.3:
                    rows["labs_ce" if i % 2 else "labs_le"].append((s, t, lab[i], typical[name] * rng.uniform(0.8, 1.2)))
            if k % 6 == 0:
                rows["mechvent"].append((s, t, 1, 0, 0))
            if k % 3 == 0:
                rows["fluid_mv"].append((s, t, t + 3 * H, 225158, 300.0, None if k % 9 == 0 else 100.0, 300.0))
                rows["uo"].append((s, t + 60, 40055, 80.0 + k))
            if k % 5 == 0 and s % 3 == 0:
                rows["vaso_mv"].append((s, 221906, t, t + 2 * H, rng.uniform(0.01, 0.6)))
        rows["preadm_fluid"].append((s, None if s % 2 else 500.0))
        rows["preadm_uo"].append((s, base, 40060, 100.0, 5))
    need = ["demog", "abx", "culture", "microbio", "ce", "labs_ce", "labs_le", "mechvent", "fluid_mv", "vaso_mv", "uo", "preadm_fluid", "preadm_uo"]
    return {t: spark.createDataFrame(rows[t], RAW_TABLES[t]) for t in need}


@pytest.fixture(scope="module")
def built(raw):
    prepared = icu.prepare_raw(raw)
    scored, bounds = icu.build_dataset(prepared, 25, 49, block=100)
    return scored.persist(), bounds


def test_scored_bins(built):
    scored, bounds = built
    stays = {r.icustayid for r in scored.select("icustayid").distinct().collect()}
    assert stays == set(range(1, 25)) - {3}
    assert bounds.count() == len(stays)
    per = scored.groupBy("icustayid").agg(F.count("*").alias("n"), F.min("bloc").alias("a"), F.max("bloc").alias("b")).collect()
    assert all(1 <= r.a and r.b <= 20 for r in per)
    bad = scored.filter(F.abs(F.col("cumulated_balance") - (F.col("input_total") - F.col("output_total"))) > 1e-9)
    assert bad.count() == 0
    assert scored.filter("HR is null or Potassium is null or SOFA is null or SIRS is null or Shock_Index is null").count() == 0
    assert scored.filter("max_dose_vaso > 0").select("icustayid").distinct().count() == 7
    r = scored.filter("icustayid = 2 and bloc = 1").first()
    assert r.input_total >= 500 and r.output_total >= 100 and r.gender == 0
    assert r.died_in_hosp == 0 and scored.filter("icustayid = 4").first().morta_90 == 1


def test_cohort_and_model(built):
    scored, bounds = built
    members, audit = cohort.select_cohort(scored, bounds)
    assert [r.rule for r in audit.orderBy("step").collect()] == ["extreme values", "treatment stopped", "died during record"]
    assert members.count() > 5
    raw_rows, normed, scaler = icu.model_dataset(scored, members)
    assert scaler.count() == len(C.NORMAL_FEATURES) + len(C.LOG_FEATURES)
    assert normed.filter(F.col("HR").isNull()).count() == 0
    out = icu.train_and_evaluate(raw_rows, normed, n_clusters=6, starts=2, share=1.0, threshold=1, replicates=10, td_draws=200, td_replicates=2, validation=0.4)
    assert out["wis"].count() == 10 and out["td"].count() == 2
    assert out["q"].count() == 8 * 25
    many = icu.train_models(raw_rows, normed, models=3, n_clusters=6, starts=2, share=1.0, threshold=1, replicates=10, validation=0.4)
    assert many["q"].count() == 3 * 8 * 25 and many["stats"].count() <= 3
    assert many["visits"].filter("size(states) = 3").count() == normed.count()

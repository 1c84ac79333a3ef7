"""Score bands at their edges, null handling and the options for published oddities."""

from pyspark.sql import functions as F

from careflow.operators import cleaning, mdp, scores

SOFA = "PaO2_FiO2 Platelets_count Total_bili MeanBP max_dose_vaso GCS Creatinine output_step".split()
BEST = dict(PaO2_FiO2=450.0, Platelets_count=200.0, Total_bili=1.0, MeanBP=80.0, max_dose_vaso=0.0, GCS=15.0, Creatinine=1.0, output_step=900.0)


def frame(spark, rows, cols):
    return spark.createDataFrame([(i, *[r.get(c) for c in cols]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in cols))


def test_organ_score_edges(spark):
    cases = [
        ({}, 0, 0), ({"PaO2_FiO2": 400.0}, 0, 0), ({"PaO2_FiO2": 399.9}, 1, 1), ({"PaO2_FiO2": 300.0}, 1, 1), ({"PaO2_FiO2": 99.0}, 4, 4),
        ({"Platelets_count": 150.0}, 0, 0), ({"Platelets_count": 19.0}, 4, 4), ({"Total_bili": 12.0}, 0, 0), ({"Total_bili": 12.1}, 4, 4), ({"Total_bili": 2.0}, 2, 2),
        ({"max_dose_vaso": 0.5}, 0, 4), ({"MeanBP": 66.0, "max_dose_vaso": 0.05}, 1, 3), ({"MeanBP": None, "max_dose_vaso": 0.5}, 4, 4), ({"GCS": 14.0}, 1, 1), ({"GCS": 5.0}, 4, 4),
        ({"Creatinine": 5.0, "output_step": 900.0}, 0, 0), ({"Creatinine": 1.0, "output_step": 80.0}, 0, 3), ({"Creatinine": None, "output_step": 80.0}, 3, 3), ({"Creatinine": None, "output_step": 10.0}, 3, 4),
        ({c: None for c in SOFA}, 0, 0),
    ]
    df = frame(spark, [{**BEST, **c} for c, _, _ in cases], SOFA)
    got = df.select("i", scores.sofa().alias("a"), scores.sofa(highest=True).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in cases]


def test_inflammation_count(spark):
    cols = "Temp_C HR RR paCO2 WBC_count".split()
    df = frame(
        spark, [dict(zip(cols, map(lambda x: None if x is None else float(x), v))) for v in ((37, 80, 15, 40, 8), (38, 91, 20, 40, 12), (36, 90, 19, 32, 3.9), (None,) * 5)], cols)
    assert [r.s for r in df.select("i", scores.sirs().alias("s")).orderBy("i").collect()] == [0, 4, 3, 0]


def test_consciousness_bands_options(spark):
    cols = "age MeanBP GCS HR RR Temp_C output_step mechvent".split()
    base = dict(age=20.0, MeanBP=70.0, HR=50.0, RR=15.0, Temp_C=36.0, output_step=5000.0, mechvent=0.0)
    df = frame(spark, [{**base, "GCS": g} for g in (7.0, 10.0, 14.0, 15.0, None)] + [{**base, "GCS": 15.0, "mechvent": 1.0}], cols)
    got = [r.s - 2 for r in df.select("i", scores.oasis().alias("s")).orderBy("i").collect()]
    assert got == [10, 4, 3, 0, 0, 9]
    odd = [r.s - 2 for r in df.select("i", scores.oasis(as_written=True).alias("s")).orderBy("i").collect()]
    assert odd == [10, 0, 0, 0, 0, 9]


def test_acute_score_counts_oxygen_only_under_ventilation(spark):
    cols = "age HR SysBP Temp_C PaO2_FiO2 output_step BUN WBC_count Potassium Sodium HCO3 Total_bili GCS mechvent".split()
    base = dict(age=30.0, HR=80.0, SysBP=120.0, Temp_C=37.0, PaO2_FiO2=90.0, output_step=1500.0, BUN=10.0, WBC_count=8.0, Potassium=4.0, Sodium=140.0, HCO3=24.0, Total_bili=1.0, GCS=15.0)
    df = frame(spark, [{**base, "mechvent": 0.0}, {**base, "mechvent": 1.0}, {"mechvent": 1.0}, {**base, "age": 80.0, "GCS": 3.0, "mechvent": 0.0}], cols)
    assert [r.s for r in df.select("i", scores.saps2().alias("s")).orderBy("i").collect()] == [0.0, 11.0, 0.0, 44.0]


def test_row_wide_clamp_is_an_option(spark):
    df = spark.createDataFrame([(1.0, 120.0, None, 37.0, 40.0)], "x double, SpO2 double, Temp_F double, Temp_C double, FiO2_100 double")
    bounds = {"SpO2": (None, 150)}
    plain = cleaning.apply_in_turn(df, cleaning.unit_stages(bounds)).first()
    odd = cleaning.apply_in_turn(df, cleaning.unit_stages(bounds, clamp_row=["x"])).first()
    assert (plain.x, plain.SpO2) == (1.0, 100.0) and (odd.x, odd.SpO2) == (100.0, 100.0)


def test_mask_agrees_with_the_rule_log(spark):
    df = spark.createDataFrame([(1, 120.0, None, 60.0), (2, None, 80.0, 60.0), (3, 120.0, 80.0, 60.0), (4, None, None, 60.0)], "id long, SysBP double, MeanBP double, DiaBP double")
    new, log = cleaning.log_in_turn(df, ["id"], cleaning.vital_stages()[:3])
    mask = cleaning.change_mask(df, new, ["id"], ["SysBP", "MeanBP", "DiaBP"])
    changed = {(r.id, c) for r in mask.collect() for c in ("SysBP", "MeanBP", "DiaBP") if r[c]}
    assert changed == {(r.id, r.value_col) for r in log.collect()} == {(1, "MeanBP"), (2, "SysBP")}


def test_states_go_to_the_nearest_centre(spark):
    df = spark.createDataFrame([(i, float(i % 3 * 100 + i % 5), float(i % 3 * 50)) for i in range(90)], "id long, x double, y double")
    model = mdp.fit_state_clusters(df, ["x", "y"], k=3, share=0.9, starts=4, row_key=["id"])
    centres = model.clusterCenters()
    for r in mdp.assign_states(df, model, ["x", "y"]).collect():
        d = [(r.x - c[0]) ** 2 + (r.y - c[1]) ** 2 for c in centres]
        assert r.state == d.index(min(d))
    assert df.count() == 90 and len({round(c[1]) for c in centres}) == 3


def test_softening_sums(spark):
    policy = spark.createDataFrame([(0, 0, 0.25), (0, 2, 0.75)], "state int, action int, p double")
    for subtract in (False, True):
        p = {(r.state, r.action): r.p for r in mdp.soft_clinician(policy, 2, 4, 0.01, subtract).collect()}
        assert abs(sum(v for (s, _), v in p.items() if s == 0) - 1) < 1e-12 and p[1, 0] == 0.0025
    assert abs(p[0, 0] - 0.245) < 1e-12

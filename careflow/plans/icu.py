"""The whole job on hospital tables, stage by stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.operators import bins, cleaning, clusters, cohort, dataset, ensemble, impute, joins, mdp, ope, scan, scores, states
from careflow.session import cut_lineage, hot_rows


def prepare_raw(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Recode items, join the culture sources, resolve stays and drop unusable rows."""
    spark = raw["demog"].sparkSession
    out = dict(raw)
    out["ce"] = states.recode_items(raw["ce"], states.item_groups(spark, C.VITAL_ITEMS), small=True)
    labs = raw["labs_ce"].unionByName(raw["labs_le"])
    out["labs"] = states.recode_items(labs, states.item_groups(spark, C.LAB_ITEMS), small=True)
    out["demog"] = raw["demog"].fillna(0, ["morta_90", "morta_hosp", "elixhauser"])
    out["bacterio"] = states.culture_table(raw["microbio"], raw["culture"], raw["demog"])
    abx = raw["abx"].filter(F.col("startdate").isNotNull())
    abx = joins.impute_stay_ids(abx, raw["demog"], subject=None, time="startdate")
    out["abx"] = abx.filter(F.col("icustayid").isNotNull())
    rate = F.try_divide(F.col("tev") * F.col("rate"), F.col("amount")).cast("double")
    out["fluid_mv"] = raw["fluid_mv"].withColumn("norm_infusion_rate", rate)
    for t in ("mechvent", "vaso_mv", "vaso_cv", "fluid_cv"):
        if raw.get(t) is not None:
            out[t] = raw[t].filter(F.col("icustayid").isNotNull())
    return out


def impute_states(df: DataFrame, outliers: bool = True, gcs: bool = True, fio2: bool = True, vitals: bool = True, carry: bool = True) -> DataFrame:
    """Clean and hold state rows. The large-key measurement is taken once for all holds."""
    hot = scan.find_hot(df, ["icustayid"], "timestep", hot_rows(df.sparkSession))
    if outliers:
        df = cleaning.apply_in_turn(df, cleaning.unit_stages())
    if gcs:
        df = cleaning.apply_rules(df, cleaning.gcs_rules())
    if fio2:
        df = cleaning.estimate_fio2(df, hot=hot)
    if vitals:
        df = cleaning.apply_in_turn(df, cleaning.vital_stages())
    if carry:
        df = impute.hold(df, "icustayid", "timestep", C.HOLD_HOURS, hot=hot)
    return df


def impute_bins(df: DataFrame, hours: float = 4.0, block: int = 10_000, correct: bool = True, interpolate: bool = True, nearest: bool = True, score: bool = True) -> DataFrame:
    """Correct, interpolate, fill from neighbours and score binned rows."""
    order = ["icustayid", "bloc"]
    if correct:
        median = scan.exact_quantiles(df, [], "elixhauser", {"m": 0.5}).first()["m"]
        df = cleaning.apply_in_turn(df, cleaning.correction_stages(median))
    if interpolate:
        numeric = [c for c in C.DEMOGRAPHICS + C.STATE_COLUMNS + C.IN_OUT if c in df.columns]
        df = impute.interpolate_sparse_gaps(df, order, numeric)
    if nearest:
        df = cut_lineage(impute.fill_from_nearest(df, order, C.VITALS + C.LABS, block).drop("row"), "filled")
    return scores.with_scores(df, hours) if score else df


def build_dataset(
    prepared: Mapping[str, DataFrame], hours_before: int, hours_after: int, hours: float = 4.0,
    members: DataFrame | None = None, block: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """Scored bins and stay bounds for one window around onset. States and bins are written once each."""
    t = prepared
    onsets = states.onset(t["abx"], t["bacterio"])
    raw, bounds = states.patient_states(
        t["ce"], t["labs"], t["mechvent"], onsets, t["demog"], t.get("mechvent_pe"), hours_before, hours_after,
        members=members,
    )
    rows = cut_lineage(impute_states(cut_lineage(raw, "states")), "held")
    bounds = cut_lineage(bounds, "bounds")
    binned, _ = bins.states_and_actions(
        rows, bounds, t["demog"], t["fluid_mv"], t["preadm_fluid"], t["vaso_mv"], t["uo"], t["preadm_uo"],
        t.get("fluid_cv"), t.get("vaso_cv"), hours, hours_before, hours_after,
    )
    return cut_lineage(impute_bins(cut_lineage(binned, "bins"), hours, block), "scored"), bounds


def model_dataset(scored: DataFrame, members: DataFrame, share: float = 0.6, outcome: str = "died_in_hosp") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cohort rows with their split: raw, normalised by the training part, and the scaler."""
    rows = joins.keep_members(scored, members, "icustayid")
    rows = cut_lineage(dataset.split_by_key(rows, "icustayid", share).withColumn("outcome", F.col(outcome)), "raw")
    scaler = cut_lineage(dataset.fit_scaler(rows.filter(F.col("split") == "train")))
    return rows, cut_lineage(dataset.apply_scaler(rows, scaler), "normed"), scaler


def train_and_evaluate(
    raw: DataFrame, normed: DataFrame, n_clusters: int = 750, starts: int = 32, share: float = 0.25, n_bins: int = 5,
    gamma: float = 0.99, reward: float = 100.0, threshold: int = 5, epsilon: float = 0.01, replicates: int = 750,
    td_draws: int = 300_000, td_replicates: int = 6, validation: float = 0.2, seed: int = 0,
) -> dict[str, DataFrame]:
    """One model: states, transition model, policy, and both off-policy estimates on its validation part."""
    key = ["icustayid", "bloc"]
    cut = dataset.action_cutoffs(raw, ["input_step", "max_dose_vaso"], n_bins)
    action = dataset.action_of(F.col("input_step"), F.col("max_dose_vaso"), cut["input_step"], cut["max_dose_vaso"])
    rows = normed.join(raw.select(*key, action.cast("int").alias("action")), key)
    rows = dataset.split_by_key(rows, "icustayid", 1 - validation, f"model-{seed}", "part")
    model = mdp.fit_state_clusters(rows.filter("part = 'train'"), C.FEATURES, n_clusters, share, starts, seed=seed, row_key=key)
    rows = cut_lineage(mdp.assign_states(rows, model, C.FEATURES).select(*key, "part", "state", "action", "outcome"), "visited")
    train, val = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    n_states, n_actions = n_clusters + 2, n_bins * n_bins
    counts = cut_lineage(mdp.transition_counts(mdp.complete_records(train, n_clusters, reward), threshold))
    p = mdp.transition_model(counts)
    r = mdp.expected_reward(p, n_clusters, reward)
    _, q, _ = mdp.policy_iteration(p, r, n_states, n_actions, gamma)
    clinician = mdp.clinician_policy(counts)
    behaviour, target = mdp.soft_clinician(clinician, n_clusters, n_actions, epsilon), mdp.soft_best(q, n_actions, epsilon)
    scored = mdp.score_rows(val, q, {"behaviour": behaviour, "target": target})
    ratios = cut_lineage(ope.stay_ratios(scored, "behaviour", "target", "outcome", gamma, reward), "ratios")
    wis = cut_lineage(ope.weighted_value(ope.bootstrap_samples(ratios, replicates), ["replicate"]), "wis")
    records = cut_lineage(mdp.complete_records(val, n_clusters, reward), "records")
    draws = ope.sampled_traces(val, "icustayid", td_draws, td_replicates)
    td = cut_lineage(ope.policy_value(records, clinician, ope.td_q(records, draws, gamma), n_clusters), "td")
    return {
        "counts": counts, "p": p, "r": r, "q": q, "clinician": clinician, "scored": scored, "wis": wis, "td": td,
        "wis_stats": ope.replicate_stats(wis, "wis"), "td_stats": ope.replicate_stats(td, "value"),
    }


def train_models(
    raw: DataFrame, normed: DataFrame, models: int = 100, n_clusters: int = 750, starts: int = 32, share: float = 0.25, n_bins: int = 5,
    validation: float = 0.2, path: str | None = None, save: str = "best", **options,
) -> dict[str, DataFrame]:
    """Many models, each with its own training stays and states; all but the clustering goes through shared jobs.

    Clustering is one fit a model (all starts in a pass); states of all models are found in one pass. `options` go to
    `ensemble.train`; with `path` the best and worst model, or all, are saved there.
    """
    key = ["icustayid", "bloc"]
    cut = dataset.action_cutoffs(raw, ["input_step", "max_dose_vaso"], n_bins)
    action = dataset.action_of(F.col("input_step"), F.col("max_dose_vaso"), cut["input_step"], cut["max_dose_vaso"])
    rows = cut_lineage(normed.join(raw.select(*key, action.cast("int").alias("action")), key), "rows")
    fits = []
    for m in range(models):
        mine = dataset.split_by_key(rows, "icustayid", 1 - validation, f"model-{m}", "part").filter("part = 'train'")
        fits.append(mdp.fit_state_clusters(mine, C.FEATURES, n_clusters, share, starts, seed=m, row_key=key))
    visits = cut_lineage(clusters.assign_all(rows, fits, C.FEATURES).select(*key, "states", "action", "outcome"), "visited")
    out = {"visits": visits, **ensemble.train(visits, models, n_clusters, n_bins * n_bins, 1 - validation, **options)}
    if path:
        ensemble.save_models(path, out, save, {f"edges_{c}": list(e) for c, e in cut.items()})
    return out

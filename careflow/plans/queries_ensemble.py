"""Queries of many models trained, judged and compared in the same jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.operators import ensemble, ope, scan
from careflow.plans.queries_clean import rounded
from careflow.plans.queries_model import sig, sig_sql
from careflow.plans.registry import query
from careflow.plans.standins import TRAJECTORIES, large_stays, measurements, trajectories, unit_hash
from careflow.session import cut_lineage, scratch_path
from careflow.sources import io

_MODELS, _STATES, _ACTIONS, _GAMMA, _REPLICATES = 100, 10, 5, 0.9, 750


def _visits(spark, sf):
    """States of 100 models: model m cuts the value at edges moved down by m / 4."""
    hot = large_stays(spark, sf)
    events = measurements(spark, sf)
    rows = trajectories(spark, sf, hot, events if hot else ensemble.by_stay(events, _MODELS, "stay")).withColumnRenamed("stay", "icustayid")
    cut = F.transform(F.sequence(F.lit(0), F.lit(_MODELS - 1)), lambda m: F.least(F.lit(_STATES - 1), F.floor((F.col("v") + m / 4) / 50).cast("int")))
    return rows.select("icustayid", "bloc", cut.alias("states"), "action", "outcome"), scan.same_rows(hot)


_PART = unit_hash("CAST(icustayid AS VARCHAR)", "concat('model-', CAST(model AS VARCHAR))")
_COUNTS = TRAJECTORIES + f""", mv AS MATERIALIZED (SELECT *, {_PART} < 0.8 AS learns FROM (SELECT CAST(m.i AS INT) AS model, stay AS icustayid, bloc, CAST(least(9, floor((v + m.i / 4) / 50)) AS INT) AS state, action, outcome,
    lead(action) OVER w AS nxt, lead(CAST(least(9, floor((v + m.i / 4) / 50)) AS INT)) OVER w AS ahead, lead(action, 2) OVER w AS nxt2 FROM tr, range(0, {_MODELS}) m(i) WINDOW w AS (PARTITION BY m.i, stay ORDER BY bloc))),
cnt AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY model, state, action) AS BIGINT) AS pair FROM (SELECT model, state, action, next_state, count(*) AS n FROM (
    SELECT DISTINCT model, icustayid, state, nxt AS action, CASE WHEN nxt2 IS NOT NULL THEN ahead WHEN outcome = 1 THEN 10 ELSE 11 END AS next_state FROM mv WHERE nxt IS NOT NULL AND learns) GROUP BY 1, 2, 3, 4)) WHERE pair > 5)"""
_Q = _COUNTS + f""", mod AS MATERIALIZED (SELECT model, state, action, next_state, n / pair AS p FROM cnt),
grid AS MATERIALIZED (SELECT CAST(m.i AS INT) AS model, CAST(s.i AS INT) AS state, CAST(a.i AS INT) AS action FROM range(0, {_MODELS}) m(i), range(0, 12) s(i), range(0, 5) a(i)),
rew AS (SELECT model, state, action, sum(p * CASE next_state WHEN 11 THEN 100.0 WHEN 10 THEN -100.0 ELSE 0.0 END) AS r FROM mod GROUP BY 1, 2, 3),
step AS MATERIALIZED (SELECT g.model, g.state, g.action, coalesce(r, 0) AS r, coalesce(next_state, g.state) AS next_state, coalesce(p, 0) AS p FROM grid g
  LEFT JOIN rew ON rew.model = g.model AND rew.state = g.state AND rew.action = g.action LEFT JOIN mod ON mod.model = g.model AND mod.state = g.state AND mod.action = g.action),
val(k, model, state, v) AS (SELECT 0, model, state, 0.0::DOUBLE FROM (SELECT DISTINCT model, state FROM grid) UNION ALL
  SELECT k + 1, model, state, max(q) FROM (SELECT val.k, step.model, step.state, step.action, any_value(r) + {_GAMMA}::DOUBLE * sum(p * val.v) AS q FROM step JOIN val ON val.model = step.model AND val.state = step.next_state WHERE val.k < 350 GROUP BY 1, 2, 3, 4) GROUP BY k, model, state),
opt AS MATERIALIZED (SELECT step.model, step.state, step.action, any_value(r) + {_GAMMA}::DOUBLE * sum(p * val.v) AS q FROM step JOIN val ON val.model = step.model AND val.state = step.next_state AND val.k = 350 GROUP BY 1, 2, 3),
best AS MATERIALIZED (SELECT model, state, arg_max(action, struct_pack(q := round(q, 6), a := -action)) AS best FROM opt GROUP BY 1, 2)"""
_STATS = _Q + f""", clin AS (SELECT model, state, action, n / sum(n) OVER (PARTITION BY model, state) AS p FROM (SELECT model, state, action, sum(n) AS n FROM cnt GROUP BY 1, 2, 3)),
fz AS (SELECT *, sum((p = 0)::INT) OVER (PARTITION BY model, state) AS z, sum(p) OVER (PARTITION BY model, state) AS mass FROM (SELECT g.model, g.state, g.action, coalesce(clin.p, 0) AS p FROM grid g
  LEFT JOIN clin ON clin.model = g.model AND clin.state = g.state AND clin.action = g.action WHERE g.state < 10)),
pol AS MATERIALIZED (SELECT fz.model, fz.state, fz.action, CASE WHEN p = 0 THEN 0.01::DOUBLE / z ELSE p * (1 - 0.01::DOUBLE / mass) END AS b, CASE WHEN fz.action = best THEN 0.99::DOUBLE ELSE 0.01::DOUBLE / 4 END AS t FROM fz JOIN best ON best.model = fz.model AND best.state = fz.state),
rt AS MATERIALIZED (SELECT mv.model, icustayid, CASE WHEN max((b <= 0)::INT) = 1 THEN NULL ELSE exp(sum(ln(t) - ln(b))) END AS rho, pow(0.99::DOUBLE, count(*) - 2) * CASE WHEN max(outcome) = 1 THEN -100.0 ELSE 100.0 END AS g
  FROM mv JOIN pol ON pol.model = mv.model AND pol.state = mv.state AND pol.action = mv.action WHERE NOT learns GROUP BY 1, 2),
hs AS MATERIALIZED (SELECT icustayid, CAST(j.i AS INT) AS replicate, md5(concat_ws('|', CAST(icustayid AS VARCHAR), CAST(j.i AS VARCHAR), 'boot')) AS h FROM (SELECT DISTINCT icustayid FROM rt), range(0, {_REPLICATES}) j(i)),
bw AS (SELECT model, replicate, sum(rho * g) / sum(rho) AS wis FROM (SELECT rt.*, replicate, row_number() OVER (PARTITION BY model, replicate ORDER BY h, icustayid) AS k, count(*) OVER (PARTITION BY model, replicate) AS n FROM rt JOIN hs USING (icustayid))
  WHERE k <= least(25000, floor(n * 0.75)) AND rho IS NOT NULL GROUP BY 1, 2),
ms AS (SELECT model, avg(wis) AS mean, quantile_cont(wis, 0.01) AS q01, quantile_cont(wis, 0.05) AS q05, quantile_cont(wis, 0.95) AS q95, quantile_cont(wis, 0.99) AS q99 FROM bw GROUP BY 1)"""


@query("ensemble_counts", "MD4 MD5 AG15", f"WITH {_COUNTS} SELECT model, state, CAST(action AS INT) AS action, CAST(next_state AS INT) AS next_state, n, pair, round(n / pair, 6) AS p FROM cnt")
def ensemble_counts(spark, sf):
    visits, hot = _visits(spark, sf)
    members = cut_lineage(ensemble.parts(visits, _MODELS), "parts")
    counts = ensemble.transition_counts(visits, members, _STATES, hot=hot)
    return counts.select(*ensemble.MSA, "next_state", "n", "pair", F.round(F.col("n") / F.col("pair"), 6).alias("p"))


def _q(spark, sf):
    visits, hot = _visits(spark, sf)
    members = cut_lineage(ensemble.parts(visits, _MODELS), "parts")
    counts = cut_lineage(ensemble.transition_counts(visits, members, _STATES, hot=hot), "counts")
    p = ensemble.transition_model(counts)
    q = ensemble.policy_iteration(p, ensemble.expected_reward(p, _STATES), _MODELS, _STATES + 2, _ACTIONS, _GAMMA, tolerance=1e-11)[1]
    return visits, members, counts, q


@query("ensemble_policies", "MD6 MD7 MD8 OP9", f"WITH RECURSIVE {_Q} SELECT opt.model, opt.state, opt.action, round(q, 4) AS q, best AS best_action FROM opt JOIN best ON best.model = opt.model AND best.state = opt.state")
def ensemble_policies(spark, sf):
    """Optimal Q of 100 models, found in the same sweeps."""
    q = _q(spark, sf)[3]
    best = ensemble.best_actions(rounded(q, ["q"])).select(*ensemble.MS, F.col("action").alias("best_action"))
    return rounded(q.join(best, ensemble.MS), ["q"], 4)


def _judged(spark, sf):
    visits, members, counts, q = _q(spark, sf)
    policies = cut_lineage(ensemble.soft_policies(rounded(q, ["q"]), ensemble.clinician_policy(counts), _STATES, _ACTIONS), "policies")
    ratios = cut_lineage(ensemble.judged_ratios(visits, members, policies), "ratios")
    wis = ope.bootstrap_values(ratios, _REPLICATES, by=["model"])
    stats = ope.replicate_stats(cut_lineage(wis, "wis"), "wis", ["model"])
    return policies, cut_lineage(stats, "stats")


_BOUNDS = ["mean", "q01", "q05", "q95", "q99"]


@query("ensemble_bounds", "OP5 OP8 OP9 MD9 MD10", f"WITH RECURSIVE {_STATS} SELECT model, {', '.join(f'{sig_sql(c)} AS {c}' for c in _BOUNDS)} FROM ms")
def ensemble_bounds(spark, sf):
    """Bootstrapped values of 100 models, each on the stays it has not learned from."""
    return _judged(spark, sf)[1].select("model", *[sig(c) for c in _BOUNDS])


@query("ensemble_choice", "OP9 SNK3 SR3", f"""WITH RECURSIVE {_STATS}, pick AS (SELECT (SELECT model FROM ms ORDER BY round(q05, 6) DESC, model LIMIT 1) AS best, (SELECT model FROM ms ORDER BY round(q05, 6), model LIMIT 1) AS worst)
SELECT which, pol.state, pol.action, round(b, 6) AS behaviour, round(t, 6) AS target FROM (SELECT 'best' AS which, best AS model FROM pick UNION ALL SELECT 'worst', worst FROM pick) c JOIN pol USING (model)""")
def ensemble_choice(spark, sf):
    """Policies of the models with the highest and the lowest lower bound, saved and read back; bounds are moved above 0 first."""
    policies, stats = _judged(spark, sf)
    (chosen,) = ope.pick_models(stats.withColumn("q05", F.round("q05", 6) + 1000)).collect()
    path, out = scratch_path(spark, "models"), []
    for which in ("best", "worst"):
        model = chosen[f"{which}_model"]
        io.save_model(f"{path}/{which}", {"policies": policies.filter(F.col("model") == model)}, {"model": model})
        saved, params = io.load_model(spark, f"{path}/{which}", ["policies"])
        out.append(saved["policies"].filter(F.col("model") == int(params["model"])).withColumn("which", F.lit(which)))
    return rounded(out[0].unionByName(out[1]).drop("model"), ["behaviour", "target"])

"""Queries of dataset preparation, the state model, policies and off-policy evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions import scalar
from careflow.functions.scalar import hash_order
from careflow.operators import bins, clusters, dataset, mdp, ope, report, scan
from careflow.plans.queries_clean import rounded
from careflow.plans.registry import query
from careflow.plans.standins import (
    COUNTS, INTERVALS, MEASUREMENTS, RECORDS, STAYS, TRAJECTORIES, intervals, large_stays, measurements, trajectories, unit_hash,
)
from careflow.session import cut_lineage, load

N_STATES, N_ACTIONS, GAMMA = 10, 5, 0.9


def records(spark, sf):
    hot = large_stays(spark, sf)
    rows = trajectories(spark, sf, hot).withColumnRenamed("stay", "icustayid")
    return mdp.complete_records(rows, N_STATES, hot=scan.same_rows(hot))


def counts(spark, sf):
    return mdp.transition_counts(records(spark, sf), 5, hot=scan.same_rows(large_stays(spark, sf)))


def model_counts(spark, sf):
    """The counts as a table of their own, for queries that use them several times."""
    return cut_lineage(counts(spark, sf))


# ---- dataset preparation ------------------------------------------------------------------------


@query("hash_split", "DS1", f"SELECT o_orderkey AS k, CASE WHEN {unit_hash('CAST(o_custkey AS VARCHAR)', chr(39) + 'split' + chr(39))} < 0.6 THEN 'train' ELSE 'test' END AS split FROM orders")
def hash_split(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return dataset.split_by_key(o, "o_custkey", 0.6).select("k", "split")


_Z_SQL = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey % 2 AS g, l_discount AS vaso, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q,
   CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS e, l_tax - 0.02 AS x, l_suppkey % 5 < 3 AS train FROM lineitem),
m AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(CASE WHEN e IS NOT NULL THEN ln(0.1 + greatest(e, 0)) END) AS me, stddev_pop(CASE WHEN e IS NOT NULL THEN ln(0.1 + greatest(e, 0)) END) AS se,
   avg(ln(0.1 + greatest(x, 0))) AS mx, stddev_pop(ln(0.1 + greatest(x, 0))) AS sx FROM l WHERE train)"""


def _scale(spark, sf):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    df = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").alias("p"), (s % 2).alias("g"), F.col("l_discount").alias("vaso"),
        F.when(n != 3, F.col("l_quantity")).alias("q"), F.when(n != 4, F.col("l_extendedprice")).alias("e"), (F.col("l_tax") - 0.02).alias("x"), (s % 5 < 3).alias("train"),
    )
    return df, dataset.fit_scaler(df.filter("train"), ["q"], ["e", "x"])


@query("scaler_fit", "DS2 DS3", _Z_SQL + " SELECT 'q' AS feature, round(mq, 6) AS mean, round(sq, 6) AS std FROM m UNION ALL SELECT 'e', round(me, 6), round(se, 6) FROM m UNION ALL SELECT 'x', round(mx, 6), round(sx, 6) FROM m")
def scaler_fit(spark, sf):
    return rounded(_scale(spark, sf)[1], ["mean", "std"])


@query("zscore", "DS2 DS3 DS4 PRJ2", _Z_SQL + """ SELECT k, n, p, round(g - 0.5, 6)::DOUBLE AS g, round(ln(vaso - 0.5 + 6), 5) AS vaso, round(coalesce((q - mq) / sq, 0), 5) AS q,
  round(2 * coalesce((ln(0.1 + greatest(e, 0)) - me) / se, 0), 5) AS e, round((ln(0.1 + greatest(x, 0)) - mx) / sx, 5) AS x FROM (SELECT * FROM l WHERE e IS NOT NULL) , m
UNION ALL SELECT k, n, p, round(g - 0.5, 6)::DOUBLE, round(ln(vaso - 0.5 + 6), 5), round(coalesce((q - mq) / sq, 0), 5), 0, round((ln(0.1 + greatest(x, 0)) - mx) / sx, 5) FROM l, m WHERE e IS NULL""")
def zscore(spark, sf):
    df, scaler = _scale(spark, sf)
    out = dataset.apply_scaler(df, scaler, ["g", "vaso"], ["q"], ["e", "x"], log_shifted="vaso", doubled="e")
    return rounded(out.select("k", "n", "p", "g", "vaso", "q", "e", "x"), ["g", "vaso", "q", "e", "x"], 5)


_ACTION_SQL = """WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_extendedprice END AS fluid, l_discount AS vaso FROM lineitem),
f AS (SELECT quantile_cont(fluid, 0) AS a, quantile_cont(fluid, 0.25) AS b, quantile_cont(fluid, 0.5) AS c, quantile_cont(fluid, 0.75) AS e FROM d WHERE fluid > 0),
v AS (SELECT quantile_cont(vaso, 0) AS a, quantile_cont(vaso, 0.25) AS b, quantile_cont(vaso, 0.5) AS c, quantile_cont(vaso, 0.75) AS e FROM d WHERE vaso > 0),
w AS (SELECT d.*, (fluid >= 0)::INT + (fluid >= f.a)::INT + (fluid >= f.b)::INT + (fluid >= f.c)::INT + (fluid >= f.e)::INT AS fb,
        (vaso >= 0)::INT + (vaso >= v.a)::INT + (vaso >= v.b)::INT + (vaso >= v.c)::INT + (vaso >= v.e)::INT AS vb FROM d, f, v)"""


def _doses(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                     F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_extendedprice")).alias("fluid"), F.col("l_discount").alias("vaso"))


@query("action_bins", "DS5 DS6 AG10", _ACTION_SQL + " SELECT k, n, p, CAST((fb - 1) * 5 + vb - 1 AS INT) AS action FROM w")
def action_bins(spark, sf):
    d = _doses(spark, sf)
    cut = dataset.action_cutoffs(d, ["fluid", "vaso"])
    return d.select("k", "n", "p", dataset.action_of(F.col("fluid"), F.col("vaso"), cut["fluid"], cut["vaso"]).alias("action"))


@query("action_medians", "DS5 AG4", _ACTION_SQL + """ SELECT 'fluid' AS dose, CAST(fb - 1 AS INT) AS bin, round(quantile_cont(fluid, 0.5), 4) AS median FROM w GROUP BY 2
UNION ALL SELECT 'vaso', CAST(vb - 1 AS INT), round(quantile_cont(vaso, 0.5), 4) FROM w GROUP BY 2""")
def action_medians(spark, sf):
    d = _doses(spark, sf)
    cut = dataset.action_cutoffs(d, ["fluid", "vaso"])
    parts = [dataset.action_medians(d, c, cut[c]).select(F.lit(c).alias("dose"), "bin", F.round("median", 4).alias("median")) for c in ("fluid", "vaso")]
    return parts[0].unionByName(parts[1])


@query("traj_pad", "DS7 WN9", f"""WITH {MEASUREMENTS}, t AS (SELECT conv_id AS stay, turn, CAST(length(text) AS DOUBLE) AS x, turn % 3 AS a, CASE role WHEN 'user' THEN 1.0 ELSE -1.0 END AS r,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), text) - 1 AS step, count(*) OVER (PARTITION BY conv_id) AS length FROM conversations),
h AS (SELECT max(length) AS h FROM t)
SELECT stay, step, length, x, list_transform(range(0, 3), lambda i: CASE WHEN i = a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS action, r::DOUBLE AS reward FROM t
UNION ALL SELECT stay, j.i, length, 0.0, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE], 0.0 FROM (SELECT DISTINCT stay, length FROM t), h, range(0, 1000) j(i) WHERE j.i >= length AND j.i <= h""")
def traj_pad(spark, sf):
    return _padded(spark, sf)


def _padded(spark, sf):
    c = load(spark, sf, "conversations").withColumn("len", F.length("text"))
    c = scan.scan(c, ["conv_id"], ["turn", "len", "text"], {"i": scan.row_number()})
    rows = c.select(F.col("conv_id").alias("stay"), "i", F.col("len").cast("double").alias("x"), (F.col("turn") % 3).alias("a"),
                    F.when(F.col("role") == "user", 1.0).otherwise(-1.0).alias("r"))
    return dataset.padded_trajectories(rows, "stay", "i", ["x"], "a", 3, "r")


@query("traj_unroll", "DS8", """SELECT conv_id AS stay, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), text) - 1 AS step, CAST(length(text) AS DOUBLE) AS x FROM conversations""")
def traj_unroll(spark, sf):
    return dataset.unroll(_padded(spark, sf)).select("stay", "step", "x")


@query("transition_tuples", "DS9 WN5 WN6", f"""WITH {TRAJECTORIES}, nx AS (SELECT *, lead(v) OVER w AS nv, lead(bloc) OVER w IS NULL AS done FROM tr WINDOW w AS (PARTITION BY stay ORDER BY bloc))
SELECT stay, bloc, v, action, CASE WHEN NOT done THEN 0.0 WHEN outcome = 1 THEN -100.0 ELSE 100.0 END::DOUBLE AS reward, CASE WHEN done THEN 0.0 ELSE nv END AS next_v,
  CASE WHEN done AND outcome = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS next_alive, CASE WHEN done AND outcome = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS next_dead, done::INT AS done FROM nx""")
def transition_tuples(spark, sf):
    return dataset.transitions(trajectories(spark, sf), "stay", "bloc", ["v"], "action", "outcome")


@query("previous_action", "WN9", f"WITH {TRAJECTORIES} SELECT stay, bloc, CASE WHEN lag(action) OVER w IS NULL THEN [0.0::DOUBLE,0,0,0,0] ELSE list_transform(range(0, 5), lambda i: CASE WHEN i = lag_a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS prev FROM (SELECT *, lag(action) OVER (PARTITION BY stay ORDER BY bloc) AS lag_a FROM tr) WINDOW w AS (PARTITION BY stay ORDER BY bloc)")
def previous_action(spark, sf):
    seen = scan.scan(trajectories(spark, sf), ["stay"], ["bloc"], {"p": scan.previous(F.col("action"))})
    return seen.select("stay", "bloc", scalar.one_hot(F.col("p"), 5).alias("prev"))


@query("weighted_sample", "DS10", f"""WITH {MEASUREMENTS}, p AS (SELECT id, v, pow(v, 0.6) AS p, sum(pow(v, 0.6)) OVER (ORDER BY id) AS hi, sum(pow(v, 0.6)) OVER () AS total FROM ev),
d AS (SELECT j.i AS draw, (j.i + {unit_hash('CAST(j.i AS VARCHAR)', chr(39) + 'draw' + chr(39))}) * (SELECT max(total) FROM p) / 500 AS pt FROM range(0, 500) j(i))
SELECT draw, id, round(pow(p, -0.4), 6) AS importance FROM d JOIN p ON hi - p < pt AND pt <= hi""")
def weighted_sample(spark, sf):
    ev = measurements(spark, sf).select("id", "v")
    return dataset.weighted_draws(ev, "v", ["id"], 500).select("draw", "id", F.round("importance", 6).alias("importance"))


# ---- state model and policies -------------------------------------------------------------------


@query("next_action_records", "MD3 WN5 WN6", f"WITH {RECORDS} SELECT bloc, icustayid, CAST(state AS INT) AS state, CAST(action AS INT) AS action, outcome, reward::DOUBLE AS reward FROM rec")
def next_action_records(spark, sf):
    return records(spark, sf)


@query("transition_counts", "MD4 AG15", f"WITH {COUNTS} SELECT CAST(state AS INT) AS state, CAST(action AS INT) AS action, CAST(next_state AS INT) AS next_state, n, CAST(pair AS BIGINT) AS pair FROM cnt")
def transition_counts(spark, sf):
    return counts(spark, sf)


@query("transition_visits", "MD4", f"""WITH {RECORDS}, v AS (SELECT state, action, nxt AS next_state, count(*) AS n FROM (SELECT *, lead(state) OVER (PARTITION BY icustayid ORDER BY bloc) AS nxt FROM rec) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3)
SELECT CAST(state AS INT) AS state, CAST(action AS INT) AS action, CAST(next_state AS INT) AS next_state, n, CAST(sum(n) OVER (PARTITION BY state, action) AS BIGINT) AS pair FROM v""")
def transition_visits(spark, sf):
    return mdp.transition_counts(records(spark, sf), None, per_visit=True)


@query("transition_model", "MD5", f"WITH {COUNTS} SELECT CAST(state AS INT) AS state, CAST(action AS INT) AS action, CAST(next_state AS INT) AS next_state, round(p, 6) AS p FROM mod")
def transition_model(spark, sf):
    return rounded(mdp.transition_model(counts(spark, sf)), ["p"])


@query("clinician_policy", "MD5", f"WITH {COUNTS} SELECT CAST(state AS INT) AS state, CAST(action AS INT) AS action, round(p, 6) AS p FROM clin")
def clinician_policy(spark, sf):
    return rounded(mdp.clinician_policy(counts(spark, sf)), ["p"])


@query("expected_reward", "MD5", f"WITH {COUNTS} SELECT CAST(state AS INT) AS state, CAST(action AS INT) AS action, round(r, 5) AS r FROM rew")
def expected_reward(spark, sf):
    return rounded(mdp.expected_reward(mdp.transition_model(counts(spark, sf)), N_STATES), ["r"], 5)


def _sweep(i: int) -> str:
    return f"""v{i} AS (SELECT pr.state, pr.r + {GAMMA}::DOUBLE * coalesce(sum(m.p * v{i - 1}.v), 0) AS v FROM pr LEFT JOIN mod m ON m.state = pr.state AND m.action = 1
  LEFT JOIN v{i - 1} ON v{i - 1}.state = m.next_state GROUP BY pr.state, pr.r)"""


_VALUE_SQL = COUNTS + f""", pr AS (SELECT s.state, coalesce(r, 0) AS r FROM (SELECT DISTINCT state FROM grid) s LEFT JOIN rew ON rew.state = s.state AND rew.action = 1),
v0 AS (SELECT state, 0.0::DOUBLE AS v FROM pr), {', '.join(_sweep(i) for i in range(1, 5))}"""
_Q_SQL = _VALUE_SQL + f""", q AS (SELECT g.state, g.action, coalesce(r, 0) + {GAMMA}::DOUBLE * coalesce(f, 0) AS q FROM grid g LEFT JOIN rew ON rew.state = g.state AND rew.action = g.action
  LEFT JOIN (SELECT mod.state, action, sum(p * v) AS f FROM mod JOIN v4 ON v4.state = next_state GROUP BY 1, 2) x ON x.state = g.state AND x.action = g.action),
best AS (SELECT state, arg_max(action, struct_pack(q := round(q, 9), a := -action)) AS best, max(q) AS v FROM q GROUP BY 1)"""


def _values(spark, c):
    p = mdp.transition_model(c)
    r = mdp.expected_reward(p, N_STATES)
    policy = spark.range(N_STATES + 2).select(F.col("id").cast("int").alias("state"), F.lit(1).alias("action"))
    return p, r, mdp.evaluate_policy(p, r, policy, GAMMA, sweeps=4)


def q_table(spark, c):
    """Q of four sweeps, rounded so that equal values tie on every engine; a table of states x actions."""
    p, r, v = _values(spark, c)
    return cut_lineage(mdp.full_q(mdp.backup(p, r, v, GAMMA), N_STATES + 2, N_ACTIONS).withColumn("q", F.round("q", 9)))


@query("policy_sweeps", "MD6", f"WITH {_VALUE_SQL} SELECT state, round(v, 5) AS v FROM v4")
def policy_sweeps(spark, sf):
    return rounded(_values(spark, model_counts(spark, sf))[2], ["v"], 5)


@query("bellman_backup", "MD7 SR3", f"WITH {_Q_SQL} SELECT q.state, q.action, round(q, 5) AS q, CAST(best AS INT) AS best_action FROM q JOIN best USING (state)")
def bellman_backup(spark, sf):
    q = q_table(spark, model_counts(spark, sf))
    best = mdp.best_actions(q).select("state", F.col("action").alias("best_action"))
    return q.join(best, "state").select("state", "action", F.round("q", 5).alias("q"), "best_action")


@query("policy_iteration", "MD6 MD7 MD8")
def policy_iteration(spark, sf):
    p = mdp.transition_model(model_counts(spark, sf))
    policy, q, _ = mdp.policy_iteration(p, mdp.expected_reward(p, N_STATES), N_STATES + 2, N_ACTIONS, GAMMA)
    return q.join(policy.withColumnRenamed("action", "policy_action"), "state")


_BEST_SQL = COUNTS + f""", step AS (SELECT g.state, g.action, coalesce(r, 0) AS r, coalesce(next_state, g.state) AS next_state, coalesce(p, 0) AS p FROM grid g
  LEFT JOIN rew ON rew.state = g.state AND rew.action = g.action LEFT JOIN mod ON mod.state = g.state AND mod.action = g.action),
val(k, state, v) AS (SELECT 0, state, 0.0::DOUBLE FROM (SELECT DISTINCT state FROM grid) UNION ALL
  SELECT k + 1, state, max(q) FROM (SELECT val.k, step.state, step.action, any_value(r) + {GAMMA}::DOUBLE * sum(p * val.v) AS q FROM step JOIN val ON val.state = step.next_state WHERE val.k < 300 GROUP BY 1, 2, 3) GROUP BY k, state),
opt AS (SELECT step.state, step.action, round(any_value(r) + {GAMMA}::DOUBLE * sum(p * val.v), 6) AS q FROM step JOIN val ON val.state = step.next_state AND val.k = 300 GROUP BY 1, 2)"""


@query("optimal_policy", "MD6 MD7 MD8", f"""WITH RECURSIVE {_BEST_SQL} SELECT CAST(opt.state AS INT) AS state, CAST(opt.action AS INT) AS action, round(q, 4) AS q, CAST(best AS INT) AS best_action
FROM opt JOIN (SELECT state, arg_max(action, struct_pack(q := q, a := -action)) AS best FROM opt GROUP BY 1) USING (state)""")
def optimal_policy(spark, sf):
    """Policy iteration to its end; the check repeats the best backup 300 times instead."""
    p = mdp.transition_model(model_counts(spark, sf))
    _, q, _ = mdp.policy_iteration(p, mdp.expected_reward(p, N_STATES), N_STATES + 2, N_ACTIONS, GAMMA, tolerance=1e-9)
    q = rounded(q, ["q"])
    best = mdp.best_actions(q).select("state", F.col("action").alias("best_action"))
    return rounded(q.join(best, "state"), ["q"], 4)


_SOFT_SQL = _Q_SQL + """, fc AS (SELECT g.state, g.action, coalesce(clin.p, 0) AS p FROM grid g LEFT JOIN clin ON clin.state = g.state AND clin.action = g.action WHERE g.state < 10),
fz AS (SELECT *, sum((p = 0)::INT) OVER (PARTITION BY state) AS z, sum(p) OVER (PARTITION BY state) AS mass FROM fc),
sc AS (SELECT state, action, CASE WHEN p = 0 THEN 0.01::DOUBLE / z ELSE p * (1 - 0.01::DOUBLE / mass) END AS p FROM fz),
sb AS (SELECT q.state, q.action, CASE WHEN q.action = best THEN 0.99::DOUBLE ELSE 0.01::DOUBLE / 4 END AS p FROM q JOIN best USING (state))"""


@query("soft_policy", "MD9 JN9", f"WITH {_SOFT_SQL} SELECT sb.state, sb.action, round(sb.p, 6) AS target, round(sc.p, 6) AS behaviour, round(CASE WHEN fz.p = 0 THEN 0.01::DOUBLE / z ELSE fz.p - 0.01::DOUBLE / (5 - z) END, 6) AS subtractive FROM sb JOIN sc USING (state, action) JOIN fz USING (state, action)")
def soft_policy(spark, sf):
    c = model_counts(spark, sf)
    clin = mdp.clinician_policy(c)
    target = mdp.soft_best(q_table(spark, c), N_ACTIONS).withColumnRenamed("p", "target")
    b = mdp.soft_clinician(clin, N_STATES, N_ACTIONS).withColumnRenamed("p", "behaviour")
    s = mdp.soft_clinician(clin, N_STATES, N_ACTIONS, subtract=True).withColumnRenamed("p", "subtractive")
    return rounded(target.join(b, ["state", "action"]).join(s, ["state", "action"]), ["target", "behaviour", "subtractive"])


_SCORED_SQL = _SOFT_SQL + """, scored AS (SELECT r.icustayid, r.bloc, r.state, r.action, r.outcome, r.reward, coalesce(q.q, 0) AS q, best.best, va.v,
    coalesce(sc.p, 0) AS behaviour, coalesce(sb.p, 0) AS target FROM rec r LEFT JOIN q ON q.state = r.state AND q.action = r.action LEFT JOIN best ON best.state = r.state
    LEFT JOIN (SELECT state, avg(q) AS v FROM q GROUP BY 1) va ON va.state = r.state LEFT JOIN sc ON sc.state = r.state AND sc.action = r.action LEFT JOIN sb ON sb.state = r.state AND sb.action = r.action)"""


def _scored(spark, sf, rows=None):
    c = model_counts(spark, sf)
    q = q_table(spark, c)
    b = mdp.soft_clinician(mdp.clinician_policy(c), N_STATES, N_ACTIONS)
    return mdp.score_rows(records(spark, sf) if rows is None else rows, q, {"behaviour": b, "target": mdp.soft_best(q, N_ACTIONS)})


@query("row_scores", "MD10 JN10", f"WITH {_SCORED_SQL} SELECT icustayid, bloc, CAST(state AS INT) AS state, CAST(action AS INT) AS action, round(q, 5) AS q, CAST(best AS INT) AS best_action, round(v, 5) AS v, round(behaviour, 6) AS behaviour, round(target, 6) AS target FROM scored")
def row_scores(spark, sf):
    out = _scored(spark, sf).select("icustayid", "bloc", "state", "action", "q", "best_action", "v", "behaviour", "target")
    return rounded(rounded(out, ["q", "v"], 5), ["behaviour", "target"])


@query("softmax_policy", "MD10", f"WITH {_Q_SQL} SELECT state, action, round(exp(greatest(least(q, 100), -100)) / sum(exp(greatest(least(q, 100), -100))) OVER (PARTITION BY state), 6) AS p FROM q")
def softmax_policy(spark, sf):
    return rounded(mdp.softmax_policy(mdp.clip_q(q_table(spark, model_counts(spark, sf)))), ["p"])


@query("policy_agreement", "OP10", f"WITH {_SCORED_SQL} SELECT round(avg((action = best)::INT), 6) AS agreement FROM scored WHERE action >= 0")
def policy_agreement(spark, sf):
    return rounded(ope.agreement(_scored(spark, sf).filter("action >= 0"), "action", "best_action"), ["agreement"])


@query("kmeans_states", "MD1 MD2")
def kmeans_states(spark, sf):
    cols = [f"x{i}" for i in range(64)]
    e = load(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    model = mdp.fit_state_clusters(e, cols, k=10, row_key=["vec_id"])
    return mdp.assign_states(e, model, cols).select("vec_id", "state")


_LINE_FEATURES = ["quantity", "price", "discount", "tax"]


def _lines(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 50).alias("quantity"),
        (F.col("l_extendedprice").cast("double") / 100000).alias("price"), (F.col("l_discount").cast("double") * 10).alias("discount"),
        (F.col("l_tax").cast("double") * 10).alias("tax"),
    )


@query("state_clusters", "MD1 MD2")
def state_clusters(spark, sf):
    """750 centres, 32 starts, 30 rounds on a quarter of the rows; every row gets its state."""
    rows = _lines(spark, sf)
    model = mdp.fit_state_clusters(rows, _LINE_FEATURES, row_key=["l_orderkey", "l_linenumber"])
    return clusters.assign(rows, model, _LINE_FEATURES, distance="distance").select("l_orderkey", "l_linenumber", "state", "distance")


_ROUNDS, _STARTS, _CENTRES = 3, 4, 25


def _lloyd(i: int) -> str:
    """Nearest centre of every row and start, then the centres of the next round."""
    far = " + ".join(f"(l.{c} - c.{c}) * (l.{c} - c.{c})" for c in _LINE_FEATURES)
    means = ", ".join(f"coalesce(n.{c}, c.{c}) AS {c}" for c in _LINE_FEATURES)
    return f"""a{i} AS MATERIALIZED (SELECT start, id, any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, any_value(l.quantity) AS quantity, any_value(l.price) AS price, any_value(l.discount) AS discount, any_value(l.tax) AS tax,
  arg_min(centre, {far}) AS centre, min({far}) AS far FROM ln l, c{i} c GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.start, c.centre, {means} FROM c{i} c LEFT JOIN (SELECT start, centre, {', '.join(f'avg({c}) AS {c}' for c in _LINE_FEATURES)} FROM a{i} GROUP BY 1, 2) n ON n.start = c.start AND n.centre = c.centre)"""


_CLUSTER_SQL = f"""WITH ln AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS quantity, CAST(l_extendedprice AS DOUBLE) / 100000 AS price, CAST(l_discount AS DOUBLE) * 10 AS discount, CAST(l_tax AS DOUBLE) * 10 AS tax FROM lineitem),
c0 AS MATERIALIZED (SELECT start, CAST(centre AS INT) AS centre, quantity, price, discount, tax FROM (SELECT ln.*, CAST(j.i AS INT) AS start, row_number() OVER (PARTITION BY j.i ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(j.i AS VARCHAR))), l_orderkey, l_linenumber, {', '.join(_LINE_FEATURES)}) - 1 AS centre
  FROM ln, range(0, {_STARTS}) j(i)) WHERE centre < {_CENTRES}), {', '.join(_lloyd(i) for i in range(_ROUNDS + 1))},
cost AS (SELECT start, sum(far) AS cost FROM a{_ROUNDS} GROUP BY 1)"""


def _line_clusters(spark, sf):
    """Three rounds of four starts over all rows, from the rows with the smallest hashes."""
    rows = _lines(spark, sf)
    order = ["l_orderkey", "l_linenumber", *_LINE_FEATURES]
    first = []
    for s in range(_STARTS):
        by = [hash_order(F.col("l_orderkey"), F.col("l_linenumber"), F.lit(s)), *order]
        chosen = rows.orderBy(*by).limit(_CENTRES)
        first.append(chosen.withColumns({"start": F.lit(s), "centre": F.row_number().over(Window.orderBy(*by))}))
    return rows, clusters.fit(rows, _LINE_FEATURES, share=1, max_iter=_ROUNDS, initial=reduce(DataFrame.unionByName, first), tolerance=0)


@query("cluster_costs", "MD1", f"{_CLUSTER_SQL} SELECT start, round(cost, 4) AS cost FROM cost")
def cluster_costs(spark, sf):
    _, model = _line_clusters(spark, sf)
    return spark.createDataFrame([(s, round(c, 4)) for s, c in enumerate(model.costs)], "start int, cost double")


@query("nearest_states", "MD1 MD2", f"{_CLUSTER_SQL} SELECT l_orderkey, l_linenumber, centre AS state, round(far, 6) AS distance FROM a{_ROUNDS} WHERE start = (SELECT start FROM cost ORDER BY cost, start LIMIT 1)")
def nearest_states(spark, sf):
    rows, model = _line_clusters(spark, sf)
    out = clusters.assign(rows, model, _LINE_FEATURES, distance="distance")
    return rounded(out.select("l_orderkey", "l_linenumber", "state", "distance"), ["distance"])


# ---- off-policy evaluation ----------------------------------------------------------------------


@query("discounted_return", "OP1 WN8", f"""WITH {TRAJECTORIES} SELECT stay, bloc, round(coalesce(sum(nv * pow(0.99::DOUBLE, bloc - 1)) OVER (PARTITION BY stay ORDER BY bloc DESC) / pow(0.99::DOUBLE, bloc - 1), 0), 4) AS ret
FROM (SELECT *, coalesce(lead(v) OVER (PARTITION BY stay ORDER BY bloc), 0) AS nv FROM tr)""")
def discounted_return(spark, sf):
    out = ope.future_returns(trajectories(spark, sf), ["stay"], "bloc", "v", 0.99)
    return out.select("stay", "bloc", F.round("ret", 4).alias("ret"))


def _td_sql(draws: int, replicates: int) -> str:
    return _SCORED_SQL + f""", g AS (SELECT icustayid, bloc, state, action, coalesce(sum(nr * pow(0.99::DOUBLE, bloc - 1)) OVER (PARTITION BY icustayid ORDER BY bloc DESC) / pow(0.99::DOUBLE, bloc - 1), 0) AS g, last
    FROM (SELECT *, coalesce(lead(reward) OVER w, 0) AS nr, lead(bloc) OVER w IS NULL AS last FROM rec WINDOW w AS (PARTITION BY icustayid ORDER BY bloc))),
st0 AS (SELECT icustayid, row_number() OVER (ORDER BY icustayid) AS rn FROM (SELECT DISTINCT icustayid FROM rec)),
dr AS (SELECT CAST(j.i // {draws} AS INT) AS replicate, j.i % {draws} AS draw, CAST(floor({unit_hash('CAST(j.i AS VARCHAR)', chr(39) + 'trace' + chr(39))} * (SELECT count(*) FROM st0)) + 1 AS BIGINT) AS rn FROM range(0, {replicates * draws}) j(i)),
up AS (SELECT replicate, state, action, g, row_number() OVER (PARTITION BY replicate, state, action ORDER BY draw DESC, bloc) - 1 AS k FROM dr JOIN st0 USING (rn) JOIN g USING (icustayid) WHERE NOT last AND action >= 0),
tq AS (SELECT replicate, state, action, sum(0.1::DOUBLE * pow(0.9::DOUBLE, k) * g) AS q FROM up GROUP BY 1, 2, 3)"""


def _td(spark, sf, draws: int, replicates: int):
    rec = records(spark, sf)
    return rec, ope.td_q(rec, ope.sampled_traces(rec, "icustayid", draws, replicates))


def _value_sql(draws: int, replicates: int) -> str:
    return f"""WITH {_td_sql(draws, replicates)}, s AS (SELECT state, count(*) AS n FROM rec WHERE bloc = 1 AND state < 10 GROUP BY 1), vs AS (SELECT replicate, tq.state, sum(p * tq.q) AS v FROM tq JOIN clin ON clin.state = tq.state AND clin.action = tq.action GROUP BY 1, 2)
SELECT replicate, round(sum(v * n) / (SELECT sum(n) FROM s), 4) AS value FROM vs JOIN s USING (state) GROUP BY 1"""


_EMA_COLUMNS = "SELECT replicate, CAST(state AS INT) AS state, CAST(action AS INT) AS action, round(q, 4) AS q FROM tq"


@query("ema_q", "OP2 AG16", f"WITH {_td_sql(400, 2)} {_EMA_COLUMNS}")
def ema_q(spark, sf):
    return rounded(_td(spark, sf, 400, 2)[1], ["q"], 4)


@query("trace_q", "OP2 AG16", f"WITH {_td_sql(300_000, 6)} {_EMA_COLUMNS}")
def trace_q(spark, sf):
    """All draws of the published evaluation: 300,000 traces, six times."""
    return rounded(_td(spark, sf, 300_000, 6)[1], ["q"], 4)


@query("policy_value", "OP3", _value_sql(400, 2))
def policy_value(spark, sf):
    rec, q = _td(spark, sf, 400, 2)
    return rounded(ope.policy_value(rec, mdp.clinician_policy(counts(spark, sf)), q, N_STATES), ["value"], 4)


@query("trace_policy_value", "OP3", _value_sql(300_000, 6))
def trace_policy_value(spark, sf):
    rec, q = _td(spark, sf, 300_000, 6)
    return rounded(ope.policy_value(rec, mdp.clinician_policy(counts(spark, sf)), q, N_STATES), ["value"], 4)


# Off-policy ratios use the row's own action and probabilities away from 0, so that they stay in range.
_PROBS = TRAJECTORIES + """, pb AS (SELECT stay AS icustayid, bloc, outcome, v / 500 AS reward, CASE WHEN stay % 50 = 49 AND bloc = 2 THEN 0 ELSE 0.2 + (bloc * 7 + stay) % 5 * 0.1 END::DOUBLE AS b,
  CASE WHEN stay % 50 = 48 AND bloc = 1 THEN 0 ELSE 0.2 + (bloc * 3 + stay) % 5 * 0.1 END::DOUBLE AS t FROM tr)"""
_RATIO = _PROBS + """, rt AS (SELECT icustayid, CASE WHEN max((b <= 0)::INT) = 1 THEN NULL WHEN max((t <= 0)::INT) = 1 THEN 0 ELSE exp(sum(CASE WHEN b > 0 AND t > 0 THEN ln(t) - ln(b) END)) END AS rho,
  pow(0.99::DOUBLE, count(*) - 2) * CASE WHEN max(outcome) = 1 THEN -100.0 ELSE 100.0 END AS g FROM pb GROUP BY 1)"""


def _probs(spark, sf):
    s, b = F.col("icustayid"), F.col("bloc")
    tr = trajectories(spark, sf).withColumnRenamed("stay", "icustayid")
    return tr.select(
        "icustayid", "bloc", "outcome", (F.col("v") / 500).alias("reward"),
        F.when((s % 50 == 49) & (b == 2), 0.0).otherwise(0.2 + (b * 7 + s) % 5 * 0.1).alias("b"),
        F.when((s % 50 == 48) & (b == 1), 0.0).otherwise(0.2 + (b * 3 + s) % 5 * 0.1).alias("t"),
    )


def _ratios(spark, sf):
    return ope.stay_ratios(_probs(spark, sf), "b", "t", "outcome")


def sig(c: str, digits: int = 6):
    """Round to significant digits, for values of any size."""
    x = F.col(c)
    text = F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x))
    return F.when(x == 0, 0.0).otherwise(text.cast("double")).alias(c)


def sig_sql(x: str, digits: int = 6) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE CAST(printf('%.{digits - 1}e', {x}) AS DOUBLE) END"


@query("stay_ratios", "OP4 AG16 WN8", f"WITH {_RATIO} SELECT icustayid, {sig_sql('rho')} AS rho, {sig_sql('g')} AS g FROM rt")
def stay_ratios(spark, sf):
    return _ratios(spark, sf).select("icustayid", sig("rho"), sig("g"))


@query("wis", "OP4", f"WITH {_RATIO} SELECT round(sum(rho * g) / sum(rho), 4) AS wis, CAST(sum((rho > 0)::INT) AS BIGINT) AS positive FROM rt WHERE rho IS NOT NULL")
def wis(spark, sf):
    return rounded(ope.weighted_value(_ratios(spark, sf)), ["wis"], 4)


_REPS = 750
_BOOT = _RATIO + f""", bs AS (SELECT * FROM (SELECT rt.*, CAST(j.i AS INT) AS replicate, row_number() OVER (PARTITION BY j.i ORDER BY md5(concat_ws('|', CAST(icustayid AS VARCHAR), CAST(j.i AS VARCHAR), 'boot')), icustayid) AS k
  FROM rt, range(0, {_REPS}) j(i)) WHERE k <= least(25000, floor((SELECT count(*) FROM rt) * 0.75))),
bw AS (SELECT replicate, sum(rho * g) / sum(rho) AS wis, CAST(sum((rho > 0)::INT) AS BIGINT) AS positive FROM bs WHERE rho IS NOT NULL GROUP BY 1)"""


def _boot(spark, sf):
    return ope.weighted_value(ope.bootstrap_samples(_ratios(spark, sf), _REPS), ["replicate"])


@query("wis_boot", "OP5", f"WITH {_BOOT} SELECT replicate, round(wis, 4) AS wis, positive FROM bw")
def wis_boot(spark, sf):
    return rounded(_boot(spark, sf), ["wis"], 4)


@query("replicate_stats", "OP8 AG10", f"WITH {_BOOT} SELECT round(avg(wis), 4) AS mean, round(quantile_cont(wis, 0.01), 4) AS q01, round(quantile_cont(wis, 0.05), 4) AS q05, round(quantile_cont(wis, 0.95), 4) AS q95, round(quantile_cont(wis, 0.99), 4) AS q99 FROM bw")
def replicate_stats(spark, sf):
    return rounded(ope.replicate_stats(_boot(spark, sf), "wis"), ["mean", "q01", "q05", "q95", "q99"], 4)


@query("model_choice", "OP9 SR3", f"""WITH {_BOOT}, ms AS (SELECT replicate % 8 AS model, quantile_cont(wis, 0.05) AS q05 FROM bw GROUP BY 1), up AS (SELECT model, q05 + 120 AS q05 FROM ms)
SELECT CAST((SELECT model FROM up WHERE q05 > 0 ORDER BY q05 DESC, model LIMIT 1) AS INT) AS best_model, round((SELECT max(q05) FROM up WHERE q05 > 0), 4) AS best_bound,
  CAST((SELECT model FROM up ORDER BY q05, model LIMIT 1) AS INT) AS worst_model, round((SELECT min(q05) FROM up), 4) AS worst_bound""")
def model_choice(spark, sf):
    per = ope.replicate_stats(_boot(spark, sf).withColumn("model", F.col("replicate") % 8), "wis", ["model"], {"q05": 0.05})
    out = ope.pick_models(per.withColumn("q05", F.col("q05") + 120))
    return rounded(out, ["best_bound", "worst_bound"], 4)


@query("wis_clamped", "OP6", f"""WITH {_PROBS}, c AS (SELECT icustayid, greatest(least(CASE WHEN max((t <= 0)::INT) = 1 THEN 0 ELSE exp(sum(CASE WHEN t > 0 THEN ln(t) - ln(CASE WHEN b <= 0 THEN 0.1 ELSE b END) END)) END, 1e4), 1e-30) AS rho,
  sum(pow(0.99::DOUBLE, bloc - 1) * reward) AS g FROM pb GROUP BY 1) SELECT icustayid, {sig_sql('rho')} AS rho, {sig_sql('g')} AS g FROM c""")
def wis_clamped(spark, sf):
    return ope.clamped_ratios(_probs(spark, sf), "b", "t", "reward", "bloc").select("icustayid", sig("rho"), sig("g"))


_LEGACY = _PROBS + """, nx AS (SELECT *, lead(reward) OVER w AS nr, lead(bloc) OVER w IS NOT NULL AS ins FROM pb WINDOW w AS (PARTITION BY icustayid ORDER BY bloc)),
lg AS (SELECT icustayid, CASE WHEN max((ins AND b <= 0)::INT) = 1 THEN NULL WHEN max((ins AND t <= 0)::INT) = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN ins AND b > 0 AND t > 0 THEN ln(t) - ln(b) END), 0)) END AS rho,
  coalesce(sum(pow(0.99::DOUBLE, bloc - 1) * nr), 0) AS g FROM nx GROUP BY 1)"""


@query("wis_legacy", "OP7", f"""WITH {_LEGACY}, n AS (SELECT count(*) AS n FROM lg), bb AS (SELECT lg.*, CAST(j.i AS INT) AS replicate FROM lg, range(0, {_REPS}) j(i), n
  WHERE {unit_hash('CAST(icustayid AS VARCHAR)', 'CAST(j.i AS VARCHAR)', chr(39) + 'boot' + chr(39))} < least(25000.0 / n.n, 0.75))
SELECT replicate, round(sum(rho * g) / sum(rho), 5) AS wis, CAST(sum((rho > 0)::INT) AS BIGINT) AS positive FROM bb WHERE rho IS NOT NULL GROUP BY 1""")
def wis_legacy(spark, sf):
    ratios = ope.legacy_ratios(_probs(spark, sf), "b", "t", "reward", "bloc")
    return rounded(ope.weighted_value(ope.bernoulli_samples(ratios, _REPS), ["replicate"]), ["wis"], 5)

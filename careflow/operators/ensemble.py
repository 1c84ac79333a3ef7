"""Many state models trained and compared together.

Every table carries a `model` column (0, 1, ...), and a job serves all models that are not settled yet. Visits are
`(icustayid, bloc, states, action, outcome)`: one row a step, `states` holding the state under each model, so rows are
scanned once whatever the number of models. What is on the driver is one value and one action per model and state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.functions.scalar import hash_below
from careflow.operators import mdp, ope
from careflow.operators.scan import find_hot, following, scan
from careflow.session import cut_lineage, hot_rows
from careflow.sources import io

MS = ["model", "state"]
MSA = ["model", "state", "action"]
#: Models x states up to which values and policies are broadcast to the transitions; beyond it they are joined.
BROADCAST_CELLS = 1_000_000
#: Rows times models that a task holds while it finds a stay's different steps.
TASK_CELLS = 4_000_000


def by_stay(rows: DataFrame, models: int, stay: str = "icustayid") -> DataFrame:
    """Rows dealt by stay into so many parts that a task meets about `TASK_CELLS` rows times models, whatever the size of the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() * models // TASK_CELLS)), stay)


def parts(stays: DataFrame, models: int, share: float = 0.8, stay: str = "icustayid") -> DataFrame:
    """The models that learn from each stay (`train`) and those that are judged on it (`test`), by a hash of stay and model.

    Model m takes the same stays as `split_by_key` with the seed `model-<m>`.
    """
    every = F.sequence(F.lit(0), F.lit(models - 1))
    learns = F.filter(every, lambda m: hash_below(share, F.col(stay), F.concat(F.lit("model-"), m.cast("string"))))
    rows = stays.select(stay).distinct().select(stay, learns.alias("train"))
    return rows.withColumn("test", F.array_except(every, F.col("train")))


def transition_counts(visits: DataFrame, members: DataFrame, n_states: int, at_most: int | None = 5, hot: int | None = None) -> DataFrame:
    """Stays per (model, state, action, next state) over each model's own training stays, as `mdp.transition_counts`."""
    rows = scan(visits, ["icustayid"], ["bloc"], {"__next": following(F.col("action"))}, hot=hot)
    ahead = following(F.struct(F.col("states"), F.col("__next").isNull().alias("last")))
    rows = scan(rows, ["icustayid"], ["bloc"], {"__ahead": ahead}, hot=hot).filter(F.col("__ahead").isNotNull())
    end = F.when(F.col("outcome") == 1, n_states).otherwise(n_states + 1)
    steps = rows.join(members.select("icustayid", "train"), "icustayid").select(
        "icustayid", "states", F.col("__next").cast("int").alias("action"), "__ahead", end.alias("__end"), F.explode("train").alias("model"),
    ).select(
        "icustayid", "model", F.get("states", F.col("model")).cast("int").alias("state"), "action",
        F.when(F.col("__ahead.last"), F.col("__end")).otherwise(F.get(F.col("__ahead.states"), F.col("model"))).cast("int").alias("next_state"),
    ).distinct()
    counts = steps.groupBy(*MSA, "next_state").agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("pair", F.sum("n").over(Window.partitionBy(*MSA)))
    return out if at_most is None else out.filter(F.col("pair") > at_most)


def transition_model(counts: DataFrame) -> DataFrame:
    return counts.select(*MSA, "next_state", (F.col("n") / F.col("pair")).alias("p"))


def expected_reward(model: DataFrame, n_states: int, reward: float = 100.0) -> DataFrame:
    gain = F.when(F.col("next_state") == n_states + 1, reward).when(F.col("next_state") == n_states, -reward).otherwise(0.0)
    return model.groupBy(*MSA).agg(F.sum(F.col("p") * gain).alias("r"))


def clinician_policy(counts: DataFrame) -> DataFrame:
    """Share of each action among the kept transitions of a model's state."""
    pairs = counts.groupBy(*MSA).agg(F.sum("n").alias("n"))
    return pairs.select(*MSA, (F.col("n") / F.sum("n").over(Window.partitionBy(*MS))).alias("p"))


def grid(spark: SparkSession, models: Sequence[int], n_states: int, n_actions: int) -> DataFrame:
    """Every (model, state, action) of the given models."""
    size, i = n_states * n_actions, F.col("id")
    named = F.array(*[F.lit(int(m)) for m in models])
    return spark.range(len(models) * size).select(
        F.get(named, F.floor(i / size).cast("int")).alias("model"), F.floor(i % size / n_actions).cast("int").alias("state"),
        (i % n_actions).cast("int").alias("action"),
    )


def _small(df: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def _values(spark: SparkSession, v: np.ndarray, models: np.ndarray, state: str = "state") -> DataFrame:
    """Rows of `v` (one a model) as a table."""
    n = v.shape[1]
    cells = pd.DataFrame({"model": np.repeat(models, n).astype("int32"), state: np.tile(np.arange(n, dtype="int32"), len(models)), "v": v.ravel()})
    return spark.createDataFrame(cells, f"model int, {state} int, v double")


def backup(model: DataFrame, rewards: DataFrame, v: np.ndarray, models: np.ndarray, n_actions: int, gamma: float) -> DataFrame:
    """Q on the whole grid of `models` for the values `v`; 0 for pairs never kept."""
    spark = model.sparkSession
    values = _small(_values(spark, v, models, "next_state"), v.size)
    future = model.join(values, ["model", "next_state"]).groupBy(*MSA).agg(F.sum(F.col("p") * F.col("v")).alias("f"))
    q = F.coalesce(F.col("r"), F.lit(0.0)) + gamma * F.coalesce(F.col("f"), F.lit(0.0))
    every = grid(spark, models, v.shape[1], n_actions)
    return every.join(rewards, MSA, "left").join(future, MSA, "left").select(*MSA, q.alias("q"))


def best_actions(q: DataFrame) -> DataFrame:
    """Highest-valued action per model and state, the lowest action on ties."""
    best = q.groupBy(*MS).agg(F.max(F.struct(F.col("q"), (-F.col("action")).alias("a"))).alias("b"))
    return best.select(*MS, (-F.col("b.a")).alias("action"), F.col("b.q").alias("v"))


def _settle_all(step: Callable[[np.ndarray, np.ndarray], np.ndarray], v: np.ndarray, least: float, most: int, memory: int = 20) -> np.ndarray:
    """Repeat `step(rows, v[rows])` over the rows of `v` that still move by more than `least`; each row has its own memory of moves."""
    v = v.copy()
    going = np.arange(len(v))
    after: list[list[np.ndarray]] = [[] for _ in v]
    moves: list[list[np.ndarray]] = [[] for _ in v]
    for _ in range(most):
        if not len(going):
            return v
        t = step(going, v[going])
        move = t - v[going]
        moving = np.abs(move).max(axis=1) > least
        for i, m in enumerate(going):
            after[m], moves[m] = [*after[m][-memory:], t[i]], [*moves[m][-memory:], move[i]]
            v[m] = mdp.mixed(after[m], moves[m]) if moving[i] else t[i]
        going = going[moving]
    if not len(going):
        return v
    raise RuntimeError(f"{len(going)} of {len(v)} models still move by more than {least:.3g} after {most} sweeps")


def policy_iteration(
    model: DataFrame, rewards: DataFrame, models: int, n_states: int, n_actions: int, gamma: float = 0.99, start_action: int = 1,
    few: int = 5, patient_rounds: int = 20, max_rounds: int = 50, tolerance: float = 1e-7, max_sweeps: int = 1000,
) -> tuple[DataFrame, DataFrame, list[int]]:
    """Policy iteration of all models at once: policies, Q on the whole grid, and each model's rounds.

    Stops for each model as `mdp.policy_iteration` does. One job is a sweep of every policy that is not settled, warm-started
    from the values of the round before, and one job improves all of them; a settled model leaves both. Values reach the
    fixed points within `tolerance`, else an error is raised.
    """
    if not 0 <= gamma < 1:
        raise ValueError(f"gamma {gamma} has no bounded fixed point")
    spark = model.sparkSession
    model = cut_lineage(model.withColumn("next_state", F.col("next_state").cast("int")), "transitions")
    rewards = cut_lineage(rewards, "rewards")
    v = np.zeros((models, n_states))
    policy = np.full((models, n_states), start_action, dtype="int32")
    rounds = np.zeros(models, dtype=int)
    least = tolerance * (1 - gamma) / gamma if gamma else float("inf")
    going = np.arange(models)

    def chosen(which: np.ndarray) -> DataFrame:
        n = n_states
        cells = pd.DataFrame({
            "model": np.repeat(which, n).astype("int32"), "state": np.tile(np.arange(n, dtype="int32"), len(which)), "action": policy[which].ravel(),
        })
        return _small(spark.createDataFrame(cells, "model int, state int, action int"), len(cells))

    def placed(rows: pd.DataFrame, value: str, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), n_states))
        place = np.full(models, -1)
        place[which] = np.arange(len(which))
        out[place[rows["model"].to_numpy()], rows["state"].to_numpy()] = rows[value].to_numpy()
        return out

    while len(going):
        rounds[going] += 1
        taken = cut_lineage(model.join(chosen(going), MSA).select(*MS, "next_state", "p"), "taken")
        gain = placed(rewards.join(chosen(going), MSA).select(*MS, "r").toPandas(), "r", going)

        def sweep(rows: np.ndarray, now: np.ndarray) -> np.ndarray:
            which = going[rows]
            ahead = taken.join(_small(_values(spark, now, which, "next_state"), now.size), ["model", "next_state"])
            f = ahead.groupBy(*MS).agg(F.sum(F.col("p") * F.col("v")).alias("f")).toPandas()
            return gain[rows] + gamma * placed(f, "f", which)

        v[going] = _settle_all(sweep, v[going], least, max_sweeps)
        better = best_actions(backup(model, rewards, v[going], going, n_actions, gamma)).select(*MSA).toPandas()
        better = placed(better, "action", going).astype("int32")
        changed = (better != policy[going]).sum(axis=1)
        done = (changed == 0) | ((rounds[going] > patient_rounds) & (changed <= few)) | (rounds[going] > max_rounds)
        policy[going[~done]] = better[~done]
        going = going[~done]
    every = np.arange(models)
    q = cut_lineage(backup(model, rewards, v, every, n_actions, gamma), "q")
    return chosen(every), q, rounds.tolist()


def soft_policies(q: DataFrame, clinician: DataFrame, n_states: int, n_actions: int, epsilon: float = 0.01) -> DataFrame:
    """`behaviour` (clinicians, unseen actions share epsilon) and `target` (1 - epsilon for the best action) per model, state and action."""
    row = Window.partitionBy(*MS)
    p = F.coalesce(F.col("p"), F.lit(0.0))
    both = q.filter(F.col("state") < n_states).join(clinician, MSA, "left").select(
        *MSA, p.alias("p"), F.sum((p == 0).cast("int")).over(row).alias("zeros"), F.sum(p).over(row).alias("mass"),
        F.max(F.struct(F.col("q"), (-F.col("action")).alias("a"))).over(row).alias("best"),
    )
    return both.select(
        *MSA, F.when(F.col("p") == 0, epsilon / F.col("zeros")).otherwise(F.col("p") * (1 - epsilon / F.col("mass"))).alias("behaviour"),
        F.when(F.col("action") == -F.col("best.a"), 1 - epsilon).otherwise(epsilon / (n_actions - 1)).alias("target"),
    )


def judged_ratios(visits: DataFrame, members: DataFrame, policies: DataFrame, gamma: float = 0.99, reward: float = 100.0, on: str = "test") -> DataFrame:
    """Importance ratio and discounted final reward per model and stay it is judged on (its own `test` or `train` stays), as `ope.stay_ratios`."""
    rows = visits.join(members.select("icustayid", on), "icustayid").withColumn("model", F.explode(on)).select(
        "model", "icustayid", F.get("states", F.col("model")).cast("int").alias("state"), F.col("action").cast("int").alias("action"), "outcome",
    )
    met = rows.join(policies, MSA, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("behaviour", "target")})
    return ope.stay_ratios(met, "behaviour", "target", "outcome", gamma, reward, by=["model"])


def train(
    visits: DataFrame, models: int, n_states: int, n_actions: int, share: float = 0.8, gamma: float = 0.99, reward: float = 100.0,
    threshold: int = 5, epsilon: float = 0.01, replicates: int = 750, bootstrap_share: float = 0.75, most: int = 25_000,
    tolerance: float = 1e-7, hot: int | None = None,
) -> dict[str, DataFrame]:
    """All models: counts, transitions, Q, policies, bootstrapped values on each model's own held-out stays, and the choice among them."""
    members = cut_lineage(parts(visits, models, share), "parts")
    hot = find_hot(visits, ["icustayid"], "bloc", hot_rows(visits.sparkSession)) if hot is None else hot
    rows = visits if hot else by_stay(visits, models)
    counts = cut_lineage(transition_counts(rows, members, n_states, threshold, hot), "counts")
    p = transition_model(counts)
    _, q, _ = policy_iteration(p, expected_reward(p, n_states, reward), models, n_states + 2, n_actions, gamma, tolerance=tolerance)
    policies = cut_lineage(soft_policies(q, clinician_policy(counts), n_states, n_actions, epsilon), "policies")
    out = {"counts": counts, "q": q, "policies": policies}
    for side, on in (("", "test"), ("train_", "train")):
        ratios = cut_lineage(judged_ratios(visits, members, policies, gamma, reward, on), f"{side}ratios")
        wis = cut_lineage(ope.bootstrap_values(ratios, replicates, bootstrap_share, most, by=["model"]), f"{side}wis")
        stats = cut_lineage(ope.replicate_stats(wis, "wis", ["model"]), f"{side}stats")
        out |= {f"{side}ratios": ratios, f"{side}wis": wis, f"{side}stats": stats}
    return {**out, "choice": ope.pick_models(out["stats"])}


def save_models(path: str, out: Mapping[str, DataFrame], which: str = "best", params: Mapping[str, object] | None = None) -> dict[str, int]:
    """Save counts, Q and policies of the best and the worst model (`which="best"`) or of all models, one folder each, with the bounds; returns folder names and models.

    Without a model whose bound is above 0 there is no best one.
    """
    if which == "best":
        (chosen,) = out["choice"].collect()
        named = {f"{x}_model": chosen[f"{x}_model"] for x in ("best", "worst") if chosen[f"{x}_model"] is not None}
    else:
        named = {f"model_{r['model']}": r["model"] for r in out["stats"].select("model").collect()}
    bounds = {r["model"]: r["q05"] for r in out["stats"].collect()}
    for name, m in named.items():
        tables = {t: out[t].filter(F.col("model") == m) for t in ("counts", "q", "policies")}
        io.save_model(f"{path}/{name}", tables, {**(params or {}), "model": m, "q05": bounds[m]})
    return named

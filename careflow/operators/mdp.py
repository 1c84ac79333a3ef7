"""State model and tabular policies as sparse long tables.

`P(state, action, next_state, p)`, `R(state, action, r)`, `Q(state, action, q)`.
Their sizes are set by the numbers of states and actions, never by the data, which
is what bounds the broadcasts below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.scalar import hash_below, softmax_of
from careflow.operators import clusters
from careflow.operators.scan import following, scan
from careflow.session import cut_lineage

SA = ["state", "action"]


def fit_state_clusters(
    df: DataFrame, features: Sequence[str], k: int = 750, share: float = 0.25, starts: int = 32, max_iter: int = 30,
    seed: int = 0, row_key: Sequence[str] | None = None,
) -> clusters.Clusters:
    """Best of several k-means runs on a share of the rows."""
    return clusters.fit(df, features, k, share, starts, max_iter, seed, row_key)


def assign_states(df: DataFrame, model: clusters.Clusters, features: Sequence[str]) -> DataFrame:
    return clusters.assign(df, model, features)


def complete_records(
    df: DataFrame, n_states: int, reward: float = 100.0, stay: str = "icustayid", bloc: str = "bloc",
    state: str = "state", action: str = "action", outcome: str = "outcome", hot: int | None = None,
) -> DataFrame:
    """Each row with the *next* action; the last row of a stay becomes its absorbing state.

    Survivors end in state n+1 with +reward, the others in state n with -reward.
    """
    seen = scan(df, [stay], [bloc], {"__next": following(F.col(action))}, hot=hot)
    last, died = F.col("__next").isNull(), F.col(outcome) == 1
    return seen.select(
        F.col(bloc).alias("bloc"), F.col(stay).alias("icustayid"),
        F.when(~last, F.col(state)).when(died, n_states).otherwise(n_states + 1).cast("int").alias("state"),
        F.coalesce(F.col("__next"), F.lit(-1)).cast("int").alias("action"),
        F.col(outcome).cast("int").alias("outcome"),
        F.when(~last, 0.0).when(died, -reward).otherwise(reward).alias("reward"),
    )


def transition_counts(records: DataFrame, at_most: int | None = 5, per_visit: bool = False, hot: int | None = None) -> DataFrame:
    """Stays per (state, action, next state); pairs seen `at_most` times or fewer are dropped.

    A repeated transition counts once per stay; `per_visit` counts every occurrence.
    """
    steps = scan(records, ["icustayid"], ["bloc"], {"next_state": following(F.col("state"))}, hot=hot)
    steps = steps.filter(F.col("next_state").isNotNull()).select("icustayid", *SA, "next_state")
    if not per_visit:
        steps = steps.distinct()
    counts = steps.groupBy(*SA, "next_state").agg(F.count(F.lit(1)).alias("n"))
    pair = F.sum("n").over(Window.partitionBy(*SA))
    out = counts.withColumn("pair", pair)
    return out if at_most is None else out.filter(F.col("pair") > at_most)


def transition_model(counts: DataFrame) -> DataFrame:
    return counts.select(*SA, "next_state", (F.col("n") / F.col("pair")).alias("p"))


def clinician_policy(counts: DataFrame) -> DataFrame:
    """Share of each action among the kept transitions of a state."""
    pairs = counts.groupBy(*SA).agg(F.sum("n").alias("n"))
    return pairs.select(*SA, (F.col("n") / F.sum("n").over(Window.partitionBy("state"))).alias("p"))


def expected_reward(model: DataFrame, n_states: int, reward: float = 100.0) -> DataFrame:
    """Reward of an action: chance of the surviving state minus chance of the other, times the reward."""
    gain = F.when(F.col("next_state") == n_states + 1, reward).when(F.col("next_state") == n_states, -reward).otherwise(0.0)
    return model.groupBy(*SA).agg(F.sum(F.col("p") * gain).alias("r"))


def grid(spark, n_states: int, n_actions: int) -> DataFrame:
    """Every (state, action)."""
    i = F.col("id")
    return spark.range(n_states * n_actions).select(
        F.floor(i / n_actions).cast("int").alias("state"), (i % n_actions).cast("int").alias("action"),
    )


def backup(model: DataFrame, rewards: DataFrame, values: DataFrame, gamma: float) -> DataFrame:
    """Q(state, action) = R + gamma * sum p V(next). States without a value count 0."""
    v = F.broadcast(values.select(F.col("state").alias("next_state"), "v"))
    future = model.join(v, "next_state", "left").groupBy(*SA).agg(F.sum(F.col("p") * F.coalesce("v", F.lit(0.0))).alias("f"))
    return rewards.join(future, SA, "left").select(*SA, (F.col("r") + gamma * F.coalesce("f", F.lit(0.0))).alias("q"))


def full_q(q: DataFrame, n_states: int, n_actions: int) -> DataFrame:
    """Q on the whole grid, 0 for pairs never kept."""
    g = grid(q.sparkSession, n_states, n_actions)
    return g.join(q, SA, "left").select(*SA, F.coalesce("q", F.lit(0.0)).alias("q"))


def best_actions(q: DataFrame) -> DataFrame:
    """Highest-valued action per state, the lowest action on ties."""
    best = F.max(F.struct(F.col("q"), (-F.col("action")).alias("a")))
    return q.groupBy("state").agg(best.alias("b")).select("state", (-F.col("b.a")).alias("action"), F.col("b.q").alias("v"))


def mixed(after: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """Next point from the last results of a step and their moves (Anderson acceleration)."""
    if len(moves) < 2:
        return after[-1]
    d = np.diff(np.array(moves), axis=0).T
    return after[-1] - np.diff(np.array(after), axis=0).T @ np.linalg.lstsq(d, moves[-1], rcond=None)[0]


def _settle(step: Callable[[np.ndarray], np.ndarray], v: np.ndarray, least: float, most: int, memory: int = 20) -> np.ndarray:
    """Repeat `step` until it moves no value by more than `least`, mixing the last steps."""
    after, moves = [], []
    for _ in range(most):
        t = step(v)
        move = t - v
        if not len(v) or np.abs(move).max() <= least:
            return t
        after, moves = [*after[-memory:], t], [*moves[-memory:], move]
        v = mixed(after, moves)
    raise RuntimeError(f"a value still moves by {np.abs(move).max():.3g} after {most} sweeps, {least:.3g} is wanted")


def evaluate_policy(
    model: DataFrame, rewards: DataFrame, policy: DataFrame, gamma: float, sweeps: int | None = None,
    tolerance: float = 1e-9, max_sweeps: int = 1000, values: DataFrame | None = None,
) -> DataFrame:
    """V of a deterministic policy, the fixed point of `V = R + gamma P V` over sparse tables.

    With `sweeps` that many sweeps from 0 are run in one plan. Else sweeps go on from `values`
    (state, v; 0 where missing), each one join of the policy's transitions with the values;
    between them one value per state is on the driver. A sweep that moves no value by more than d
    ends within `gamma / (1 - gamma) * d` of the fixed point; it stops when that is at most
    `tolerance`, and not reaching it in `max_sweeps` is an error. `gamma` must be below 1 here.
    """
    rows = policy.select(*SA)
    r = rows.join(rewards, SA, "left").select("state", F.coalesce("r", F.lit(0.0)).alias("r"))
    p = model.join(rows, SA).select("state", "next_state", "p")
    if sweeps is not None:
        v = r.select("state", F.lit(0.0).alias("v"))
        for _ in range(sweeps):
            ahead = p.join(F.broadcast(v.select(F.col("state").alias("next_state"), "v")), "next_state")
            f = ahead.groupBy("state").agg(F.sum(F.col("p") * F.col("v")).alias("f"))
            v = r.join(f, "state", "left").select("state", (F.col("r") + gamma * F.coalesce("f", F.lit(0.0))).alias("v"))
        return v
    if not 0 <= gamma < 1:
        raise ValueError(f"gamma {gamma} has no bounded fixed point; ask for a number of sweeps")
    spark = model.sparkSession
    p = cut_lineage(p.withColumn("next_state", F.col("next_state").cast("int")))
    gain = r.toPandas().set_index("state")["r"].sort_index()
    states = gain.index.to_numpy(dtype=np.int32)

    def frame(v: np.ndarray, state: str) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame({state: states, "v": v}), f"{state} int, v double")

    def sweep(v: np.ndarray) -> np.ndarray:
        ahead = p.join(F.broadcast(frame(v, "next_state")), "next_state").groupBy("state")
        f = ahead.agg(F.sum(F.col("p") * F.col("v")).alias("f")).toPandas().set_index("state")["f"]
        return gain.to_numpy() + gamma * f.reindex(states, fill_value=0.0).to_numpy()

    first = np.zeros(len(states))
    if values is not None:
        first = values.toPandas().set_index("state")["v"].reindex(states, fill_value=0.0).to_numpy()
    least = tolerance * (1 - gamma) / gamma if gamma else float("inf")
    return frame(_settle(sweep, first, least, max_sweeps), "state")


def policy_iteration(
    model: DataFrame, rewards: DataFrame, n_states: int, n_actions: int, gamma: float = 0.99, start_action: int = 1,
    few: int = 5, patient_rounds: int = 20, max_rounds: int = 50, tolerance: float = 1e-7,
) -> tuple[DataFrame, DataFrame, int]:
    """Policy iteration. Returns the policy, Q on the whole grid and the rounds taken.

    Each policy is evaluated from the values of the one before. Stops when the policy no longer changes, changes little after `patient_rounds`, or
    after `max_rounds`.
    """
    spark = model.sparkSession
    model, rewards = cut_lineage(model), cut_lineage(rewards)
    states = spark.range(n_states).select(F.col("id").cast("int").alias("state"))
    policy = states.withColumn("action", F.lit(start_action))
    rounds, v = 0, None
    while True:
        rounds += 1
        v = evaluate_policy(model, rewards, policy, gamma, tolerance=tolerance, values=v)
        q = cut_lineage(full_q(backup(model, rewards, v, gamma), n_states, n_actions))
        better = best_actions(q).select(*SA)
        changed = better.join(policy.withColumnRenamed("action", "old"), "state").filter("action <> old").count()
        if changed == 0 or (rounds > patient_rounds and changed <= few) or rounds > max_rounds:
            return policy, q, rounds
        policy = cut_lineage(better)


def soft_best(q: DataFrame, n_actions: int, epsilon: float = 0.01) -> DataFrame:
    """1 - epsilon for the best action of a state, the rest shared by the others."""
    best = best_actions(q).select("state", F.col("action").alias("best"))
    p = F.when(F.col("action") == F.col("best"), 1 - epsilon).otherwise(epsilon / (n_actions - 1))
    return q.join(best, "state").select(*SA, p.alias("p"))


def soft_clinician(policy: DataFrame, n_states: int, n_actions: int, epsilon: float = 0.01, subtract: bool = False) -> DataFrame:
    """Clinician policy on the grid where unseen actions share epsilon.

    Seen ones are scaled by 1 - epsilon / their sum, or with `subtract` lowered by an
    equal part of epsilon each.
    """
    g = grid(policy.sparkSession, n_states, n_actions)
    row = Window.partitionBy("state")
    p = F.coalesce(F.col("p"), F.lit(0.0))
    full = g.join(policy, SA, "left").select(
        *SA, p.alias("p"), F.sum((p == 0).cast("int")).over(row).alias("zeros"), F.sum(p).over(row).alias("mass"),
    )
    seen = F.col("p") - epsilon / (n_actions - F.col("zeros")) if subtract else F.col("p") * (1 - epsilon / F.col("mass"))
    return full.select(*SA, F.when(F.col("p") == 0, epsilon / F.col("zeros")).otherwise(seen).alias("p"))


def softmax_policy(q: DataFrame) -> DataFrame:
    """Softmax over the actions of a state."""
    return q.select(*SA, softmax_of(F.col("q"), Window.partitionBy("state")).alias("p"))


def clip_q(q: DataFrame, reward: float = 100.0) -> DataFrame:
    return q.withColumn("q", F.greatest(F.least(F.col("q"), F.lit(reward)), F.lit(-reward)))


def score_rows(rows: DataFrame, q: DataFrame, policies: dict[str, DataFrame]) -> DataFrame:
    """Per row: Q of its action, best action, mean Q of the state, and its action's probability per policy.

    A row without an action (-1) gets Q 0 and probability 0.
    """
    out = rows.join(F.broadcast(q), SA, "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    per_state = q.groupBy("state").agg(F.avg("q").alias("v"))
    best = best_actions(q).select("state", F.col("action").alias("best_action"))
    out = out.join(F.broadcast(best), "state", "left").join(F.broadcast(per_state), "state", "left")
    for name, p in policies.items():
        out = out.join(F.broadcast(p.select(*SA, F.col("p").alias(name))), SA, "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out

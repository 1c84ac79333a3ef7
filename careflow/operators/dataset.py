"""Model datasets: split, normalisation, action bins, trajectories, transitions, weighted draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.functions.scalar import digitize, hash_below, hash_unit, one_hot
from careflow.operators.scan import (
    exact_quantiles, following, row_number, row_number_from_end, running_sum, scan,
)

MAX_PACKED_STEPS = 10_000


def split_by_key(df: DataFrame, key: str, share: float, seed: str = "split", name: str = "split") -> DataFrame:
    """Mark whole entities as train or test by a hash of their key; needs no shuffle and never leaks an entity."""
    return df.withColumn(name, F.when(hash_below(share, F.col(key), seed), "train").otherwise("test"))


def log_clip(c: Column, shift: float = 0.1) -> Column:
    return F.log(F.lit(shift) + F.greatest(c, F.lit(0.0)))


def _scaled_inputs(normal: Sequence[str], logged: Sequence[str]) -> dict[str, Column]:
    out = {c: F.col(c).cast("double") for c in normal}
    out.update({c: F.when(F.col(c).isNotNull(), log_clip(F.col(c).cast("double"))) for c in logged})
    return out


def fit_scaler(df: DataFrame, normal: Sequence[str] = tuple(C.NORMAL_FEATURES), logged: Sequence[str] = tuple(C.LOG_FEATURES)) -> DataFrame:
    """Mean and population deviation per feature, one row each; a constant feature gets deviation 1."""
    inputs = _scaled_inputs(normal, logged)
    row = df.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(inputs.values())],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(inputs.values())],
    )
    stats = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
                 F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("std"))
        for i, c in enumerate(inputs)
    ])
    return row.select(F.explode(stats).alias("s")).select("s.*")


def apply_scaler(
    df: DataFrame, scaler: DataFrame, as_is: Sequence[str] = tuple(C.AS_IS_FEATURES),
    normal: Sequence[str] = tuple(C.NORMAL_FEATURES), logged: Sequence[str] = tuple(C.LOG_FEATURES),
    log_shifted: str | None = "max_dose_vaso", doubled: str | None = "input_step",
) -> DataFrame:
    """Normalised features: as-is ones shifted by 0.5, z-scores, nulls 0, then the two extra weights."""
    stats = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    cols = {c: F.col(c).cast("double") - 0.5 for c in as_is}
    for c, x in _scaled_inputs(normal, logged).items():
        mean, std = stats[c]
        cols[c] = (x - F.lit(mean).cast("double")) / F.lit(std).cast("double")
    cols = {c: F.coalesce(x, F.lit(0.0)) for c, x in cols.items()}
    if log_shifted in cols:
        cols[log_shifted] = F.log(cols[log_shifted] + 6)
    if doubled in cols:
        cols[doubled] = cols[doubled] * 2
    return df.withColumns(cols)


def action_cutoffs(df: DataFrame, amounts: Sequence[str], n: int = 5) -> dict[str, list[float]]:
    """Bin edges per amount: 0, then equally spaced quantiles of its positive values."""
    probs = {f"p{i}": i / (n - 1) for i in range(n - 1)}
    out = {}
    for a in amounts:
        row = exact_quantiles(df.filter(F.col(a) > 0), [], a, probs).first()
        out[a] = [0.0, *[row[p] for p in probs]]
    return out


def action_of(fluid: Column, vaso: Column, fluid_edges: Sequence[float], vaso_edges: Sequence[float]) -> Column:
    n = len(fluid_edges)
    return (digitize(fluid, fluid_edges) - 1) * n + (digitize(vaso, vaso_edges) - 1)


def action_medians(df: DataFrame, amount: str, edges: Sequence[float]) -> DataFrame:
    """Median amount per action bin, as `(bin, median)` with bins from 0."""
    binned = df.select((digitize(F.col(amount), edges) - 1).alias("bin"), amount)
    return exact_quantiles(binned, ["bin"], amount, {"median": 0.5})


def padded_trajectories(
    df: DataFrame, stay: str, order: str, features: Sequence[str], action: str, n_actions: int, reward: str,
    horizon: int | None = None,
) -> DataFrame:
    """Trajectories padded with zero steps up to a common horizon, one row per step.

    Steps carry the features, a one-hot action, the reward and the true length. The
    form is long on purpose: no task ever holds a whole trajectory.
    """
    steps = scan(df, [stay], [order], {"__i": row_number(), "__j": row_number_from_end()})
    real = steps.select(
        stay, (F.col("__i") - 1).alias("step"), (F.col("__i") + F.col("__j") - 1).alias("length"),
        *[F.col(f).cast("double").alias(f) for f in features],
        one_hot(F.col(action), n_actions).alias("action"), F.col(reward).cast("double").alias("reward"),
    )
    if horizon is None:
        horizon = (real.agg(F.max("length")).first()[0] or 0) + 1
    last = F.lit(horizon - 1).cast("long")
    ends = real.filter(F.col("step") == F.col("length") - 1).filter(F.col("length") <= last)
    pad = ends.select(
        stay, F.explode(F.sequence(F.col("length"), last)).alias("step"), "length",
        *[F.lit(0.0).alias(f) for f in features],
        F.array_repeat(F.lit(0.0), n_actions).alias("action"), F.lit(0.0).alias("reward"),
    )
    return real.unionByName(pad)


def unroll(padded: DataFrame) -> DataFrame:
    """Only the real steps of padded trajectories."""
    return padded.filter(F.col("step") < F.col("length"))


def pack(padded: DataFrame, stay: str, columns: Sequence[str], horizon: int) -> DataFrame:
    """One array of step vectors per stay; every group holds exactly `horizon` rows."""
    if horizon > MAX_PACKED_STEPS:
        raise ValueError(f"{horizon} steps are too many for one row; keep the long form")
    step = F.struct("step", F.array(*[F.col(c) for c in columns]).alias("x"))
    arr = F.transform(F.array_sort(F.collect_list(step)), lambda s: s["x"])
    return padded.groupBy(stay).agg(arr.alias("steps"), F.max("length").alias("length"))


def transitions(
    df: DataFrame, stay: str, order: str, state: Sequence[str], action: str, outcome: str, reward: float = 100.0,
) -> DataFrame:
    """(s, a, r, s', done) per row; the last row of a stay leads to the terminal state of its outcome."""
    nxt = F.struct(*[F.col(c).alias(c) for c in state])
    seen = scan(df, [stay], [order], {"__n": following(nxt)})
    n, done = F.col("__n"), F.col("__n").isNull()
    died = F.col(outcome) == 1
    return seen.select(
        stay, order, *state, action,
        F.when(~done, 0.0).when(died, -reward).otherwise(reward).alias("reward"),
        *[F.when(done, 0.0).otherwise(n[c].cast("double")).alias(f"next_{c}") for c in state],
        F.when(done & ~died, 1.0).otherwise(0.0).alias("next_alive"),
        F.when(done & died, 1.0).otherwise(0.0).alias("next_dead"),
        done.cast("int").alias("done"),
    )


def weighted_draws(
    df: DataFrame, weight: str, order: Sequence[str], n: int, seed: str = "draw", alpha: float = 0.6, beta: float = 0.4,
    hot_rows: int | None = None,
) -> DataFrame:
    """`n` stratified draws with probability proportional to weight^alpha, and their importance weights.

    The total is cut into `n` equal segments with one hashed point each; the row whose
    cumulative range holds the point is drawn. Points meet rows by segment number.
    """
    p = F.pow(F.col(weight), F.lit(alpha))
    rows = df.withColumn("__p", p).filter(F.col("__p") > 0)
    total = rows.agg(F.sum("__p")).first()[0]
    width = total / n
    summed = scan(rows, [], order, {"__to": running_sum(F.col("__p"))}, hot_rows)
    low = F.col("__to") - F.col("__p")
    first = F.greatest(F.floor(low / width), F.lit(0).cast("long"))
    last = F.least(F.floor(F.col("__to") / width), F.lit(n - 1).cast("long"))
    spread = summed.withColumns({"__low": low}).withColumn("draw", F.explode(F.sequence(first, F.greatest(first, last))))
    spark = df.sparkSession
    points = spark.range(n).select(
        F.col("id").alias("draw"), ((F.col("id") + hash_unit(F.col("id"), seed)) * width).alias("__at"),
    )
    hit = spread.join(points, "draw").filter((F.col("__low") < F.col("__at")) & (F.col("__at") <= F.col("__to")))
    return hit.select("draw", *df.columns, F.pow(F.col("__p"), F.lit(-beta)).alias("importance"))

"""Report tables: missingness, dose excess, resampled bins, action frequencies, 2-D histograms, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.scalar import hash_below
from careflow.operators.scan import exact_quantiles, find_hot, join_null_safe
from careflow.session import hot_rows as default_hot_rows
from careflow.session import spread


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls and null share per column, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col("__n") - F.col(f"__c{i}")).alias("nulls")) for i, c in enumerate(columns)
    ])
    return row.select("__n", F.explode(cells).alias("x")).select(
        "x.column_name", F.col("__n").alias("rows"), "x.nulls",
        F.coalesce(F.try_divide(F.col("x.nulls").cast("double"), F.col("__n").cast("double")), F.lit(0.0)).alias("share"),
    )


def dose_excess(
    records: DataFrame, best: DataFrame, doses: DataFrame, fluid_medians: DataFrame, vaso_medians: DataFrame,
    n_bins: int = 5, keys: Sequence[str] = ("icustayid", "bloc"),
) -> DataFrame:
    """Given dose minus the median of the recommended bin, for every row with a next action.

    `records` and `doses` meet on their key, so rows without an action drop out of both.
    """
    rows = records.filter(F.col("action") != -1).select(*keys, "state", "outcome").join(doses, list(keys))
    rows = rows.join(F.broadcast(best.select("state", F.col("action").alias("best_action"))), "state")
    f = fluid_medians.select(F.col("bin").alias("__fb"), F.col("median").alias("__fm"))
    v = vaso_medians.select(F.col("bin").alias("__vb"), F.col("median").alias("__vm"))
    a = F.col("best_action")
    rows = rows.withColumns({"__fb": F.floor(a / n_bins).cast("int"), "__vb": (a % n_bins).cast("int")})
    rows = rows.join(F.broadcast(f), "__fb", "left").join(F.broadcast(v), "__vb", "left")
    return rows.select(
        *keys, "outcome", (F.col("input_step") - F.col("__fm")).alias("fluid_excess"),
        (F.col("max_dose_vaso") - F.col("__vm")).alias("vaso_excess"),
    )


def excess_per_stay(excess: DataFrame, stay: str = "icustayid", hot_rows: int | None = None) -> DataFrame:
    """Mean, median and sum of the excess and the outcome per stay."""
    cols = ("fluid_excess", "vaso_excess")
    means = [F.avg("outcome").alias("outcome"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in cols],
             F.sum("fluid_excess").alias("fluid_excess_sum")]
    if not find_hot(excess, [stay], "vaso_excess", hot_rows or default_hot_rows(excess.sparkSession)):
        return excess.groupBy(stay).agg(*means, *[F.median(c).alias(f"{c}_median") for c in cols])
    base = excess.groupBy(stay).agg(*means)
    for c in cols:
        base = join_null_safe(base, exact_quantiles(excess, [stay], c, {f"{c}_median": 0.5}, hot_rows), [stay], "left")
    return base


def closed_bins(x: Column, low: float, width: float, n: int) -> Column:
    """Bins whose closed range holds x; a value on an inner edge is in two."""
    k = F.floor((x - low) / width)
    near = F.sequence(k - 1, k + 1)
    return F.filter(near, lambda b: (b >= 0) & (b < n) & (x >= low + b * width) & (x <= low + (b + 1) * width))


def resampled_bins(
    stays: DataFrame, value: str, outcome: str, low: float, width: float, n: int, replicates: int = 200,
    most: int = 10_000, share: float = 0.75, seed: str = "excess", stay: str = "icustayid",
) -> DataFrame:
    """Count, mean and deviation of the outcome per replicate and bin of `value`.

    Each stay joins a replicate by its own hash, so every replicate is a fresh sample.
    """
    total = stays.count()
    p = min(most / max(total, 1), share)
    every = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    drawn = spread(stays.select(stay, value, outcome)).withColumn("replicate", every).filter(hash_below(p, F.col(stay), F.col("replicate"), seed))
    rows = drawn.withColumn("bin", F.explode(closed_bins(F.col(value), low, width, n)))
    return rows.groupBy("replicate", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.stddev_pop(outcome).alias("std"),
    )


def pooled_bins(samples: DataFrame, low: float, width: float, n: int, replicates: int) -> DataFrame:
    """Mean over replicates (an empty bin counts as 0) and pooled standard error per bin."""
    died = F.floor(F.sum(F.col("mean") * F.col("n")) + 1e-9)
    lived = F.floor(F.sum((1 - F.col("mean")) * F.col("n")) + 1e-9)
    g = samples.groupBy("bin").agg(
        F.sum("mean").alias("m"), F.sum("n").alias("n"), died.alias("died"), lived.alias("lived"),
    )
    p = F.col("died") / (F.col("died") + F.col("lived"))
    every = samples.sparkSession.range(n).select(F.col("id").alias("bin"))
    return every.join(g, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("m", F.lit(0.0)) / replicates).alias("mean"),
        (F.sqrt(p * (1 - p)) / F.sqrt(F.col("n"))).alias("error"),
    )


def action_frequencies(df: DataFrame, action: str = "action", n_bins: int = 5) -> DataFrame:
    """Share of rows per fluid and vasopressor bin, both counted from 1."""
    a = F.col(action)
    g = df.filter(a >= 0).groupBy(
        (F.floor(a / n_bins) + 1).cast("int").alias("fluid_bin"), (a % n_bins + 1).cast("int").alias("vaso_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def histogram_2d(df: DataFrame, x: str, y: str, low: float = -105.0, width: float = 2.5, n: int = 83) -> DataFrame:
    """Counts on a square grid and log10(count + 1); the last bin holds its upper edge."""
    def bin_of(c: str) -> Column:
        k = F.floor((F.col(c) - low) / width)
        return F.when(F.col(c) == low + n * width, n - 1).otherwise(k)

    g = df.select(bin_of(x).alias("x_bin"), bin_of(y).alias("y_bin"))
    g = g.filter(F.col("x_bin").between(0, n - 1) & F.col("y_bin").between(0, n - 1))
    return g.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10(F.col("n") + 1))


def vector_correlations(df: DataFrame, vector: str, scores: Sequence[str], shift: float = 1e-6) -> DataFrame:
    """Correlation of every vector component with every score.

    The shift added to the centred score only enters its norm, since the centred
    component sums to zero.
    """
    parts = df.select(F.posexplode(vector).alias("dim", "x"), *[F.col(s).cast("double").alias(s) for s in scores])
    parts = parts.withColumn("x", F.col("x").cast("double"))

    def corr(s: str) -> Column:
        norm = F.sqrt(F.var_pop("x")) * F.sqrt(F.var_pop(s) + shift * shift)
        return F.try_divide(F.covar_pop("x", s), norm).alias(s)

    return parts.groupBy("dim").agg(*[corr(s) for s in scores])

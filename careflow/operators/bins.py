"""Fixed-width time bins per stay, with doses, volumes and running balances.

Bins count from the first record of a stay and are closed on both sides, so an
event on an inner edge belongs to two bins. Events find their bins by arithmetic
and meet them by equality, never through a range join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.operators.scan import exact_quantiles, find_hot
from careflow.session import hot_rows as default_hot_rows

HOUR = 3600


def bin_starts(rows: DataFrame, stay: str = "icustayid", time: str = "timestep") -> DataFrame:
    """First record time per stay."""
    return rows.groupBy(stay).agg(F.min(time).alias("beg"))


def bins_of_point(time: Column, beg: Column, width: int, n: int) -> Column:
    """Bin numbers 0..n-1 whose closed range holds a time: one, or two on an inner edge."""
    k = F.floor((time - beg) / width)
    on_edge = F.pmod(time - beg, F.lit(width)) == 0
    both = F.when(on_edge, F.array(k - 1, k)).otherwise(F.array(k))
    return F.filter(both, lambda b: (b >= 0) & (b < n))


def bins_of_interval(start: Column, end: Column, beg: Column, width: int, n: int) -> Column:
    """Bin numbers whose closed range touches a closed interval."""
    low = F.greatest(F.ceil((start - beg) / width) - 1, F.lit(0).cast("long"))
    high = F.least(F.floor((end - beg) / width), F.lit(n - 1).cast("long"))
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def explode_points(rows: DataFrame, starts: DataFrame, stay: str, time: str, width: int, n: int) -> DataFrame:
    j = rows.join(starts, stay)
    return j.withColumn("bin", F.explode(bins_of_point(F.col(time), F.col("beg"), width, n)))


def explode_intervals(rows: DataFrame, starts: DataFrame, stay: str, start: str, end: str, width: int, n: int) -> DataFrame:
    j = rows.join(starts, stay)
    return j.withColumn("bin", F.explode(bins_of_interval(F.col(start), F.col(end), F.col("beg"), width, n)))


def bin_means(rows: DataFrame, starts: DataFrame, columns: Sequence[str], stay: str, time: str, width: int, n: int) -> DataFrame:
    """Mean of each column per stay and bin, nulls skipped; bins without rows do not appear."""
    e = explode_points(rows, starts, stay, time, width, n)
    return e.groupBy(stay, "bin").agg(F.first("beg").alias("beg"), *[F.avg(c).alias(c) for c in columns])


def row_bins(rows: DataFrame, starts: DataFrame, stay: str, time: str, width: int, n: int, keep: Sequence[str]) -> DataFrame:
    """The last bin each row went to, null for a row outside all bins."""
    j = rows.join(starts, stay)
    return j.select(*keep, F.array_max(bins_of_point(F.col(time), F.col("beg"), width, n)).alias("bin"))


def infused(rate: Column, start: Column, end: Column, t0: Column, t1: Column, doubled_edges: bool = False) -> Column:
    """Volume of an hourly rate inside [t0, t1].

    `doubled_edges` adds up the four overlap cases as published, where an interval
    that shares an edge with the bin is counted once per case that holds.
    """
    if not doubled_edges:
        seconds = F.greatest(F.least(end, t1) - F.greatest(start, t0), F.lit(0))
        return rate * seconds / HOUR
    parts = [
        F.when((end <= t1) & (start >= t0), end - start),
        F.when((start <= t0) & (end <= t1) & (end >= t0), end - t0),
        F.when((start >= t0) & (end >= t1) & (start <= t1), t1 - start),
        F.when((end >= t1) & (start <= t0), t1 - t0),
    ]
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return rate * total / HOUR


def total(c: Column) -> Column:
    """Sum with nulls as 0, and 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def interval_volumes(
    rows: DataFrame, starts: DataFrame, stay: str, start: str, end: str, rate: str, width: int, n: int,
    doubled_edges: bool = False, name: str = "volume",
) -> DataFrame:
    """Infused volume per stay and bin, for the bins that an interval touches.

    The two bins at each end of an interval get their own rows. Over the bins between, the volume is steady: it
    enters as one change of level and leaves as another, and the levels are added up along the bins of a stay. So an
    interval makes at most five rows, whatever the number of its bins, and a stay has at most `n` rows in the running sum.
    A null start lies before all bins and a null end behind them; with `doubled_edges` such an interval adds 0.
    """
    s, e, beg = F.col(start), F.col(end), F.col("beg")
    low = F.greatest(F.ceil((s - beg) / width) - 1, F.lit(0).cast("long"))
    high = F.least(F.floor((e - beg) / width), F.lit(n - 1).cast("long"))
    found = rows.filter(F.col(rate).isNotNull()).join(starts, stay).select(
        stay, beg, s.alias("__s"), e.alias("__e"), F.col(rate).alias("__r"), low.alias("__low"), high.alias("__high"),
    ).filter("__high >= __low")
    low, high = F.col("__low"), F.col("__high")
    long_ = high - low >= 4
    places = F.when(long_, F.array(low, low + 1, low + 2, high - 1, high)).otherwise(F.sequence(low, high))
    at = found.withColumn("__long", long_).withColumn("bin", F.explode(places))
    t0 = beg + F.col("bin") * width
    opens, closes = F.col("__long") & (F.col("bin") == low + 2) & (high - low > 4), F.col("__long") & (F.col("bin") == high - 1) & (high - low > 4)
    inner = beg + (low + 2) * width
    steady = infused(F.col("__r"), F.col("__s"), F.col("__e"), inner, inner + width, doubled_edges).cast("double")
    turn = F.when(opens, 1).when(closes, -1).otherwise(0)
    own = infused(F.col("__r"), F.col("__s"), F.col("__e"), t0, t0 + width, doubled_edges)
    sums = at.groupBy(stay, "bin").agg(
        total(F.when(~opens, own).cast("double")).alias("v"), total(steady * turn).alias("step"), F.sum(turn).alias("turn"),
        F.sum((~opens).cast("int")).alias("own"),
    )
    w = Window.partitionBy(stay).orderBy("bin")
    along = sums.select(
        stay, "bin", "v", "own", F.sum("step").over(w).alias("level"), F.sum("turn").over(w).alias("open"), F.lead("bin").over(w).alias("until"),
    )
    last = F.when(F.col("open") > 0, F.col("until") - 1).otherwise(F.col("bin"))
    level = F.when(F.col("open") > 0, F.col("level")).otherwise(0.0)
    every = along.filter("own > 0 OR open > 0").withColumn("__b", F.explode(F.sequence(F.col("bin"), last)))
    here = F.when(F.col("__b") == F.col("bin"), F.col("v")).otherwise(0.0)
    return every.select(stay, F.col("__b").alias("bin"), (here + level).alias(name))


def point_volumes(rows: DataFrame, starts: DataFrame, stay: str, time: str, amount: str, width: int, n: int, name: str = "volume") -> DataFrame:
    e = explode_points(rows, starts, stay, time, width, n)
    return e.groupBy(stay, "bin").agg(total(F.col(amount)).alias(name))


def median_max(rows: DataFrame, keys: Sequence[str], value: str, median: str, maximum: str, hot_rows: int | None = None) -> DataFrame:
    """Median and maximum per key in one aggregate; large groups take the counted-rank median instead."""
    rows = rows.filter(F.col(value).isNotNull())
    limit = hot_rows or default_hot_rows(rows.sparkSession)
    if not find_hot(rows, keys, value, limit):
        return rows.groupBy(*keys).agg(F.median(value).alias(median), F.max(value).alias(maximum))
    return exact_quantiles(rows, keys, value, {median: 0.5, maximum: 1.0}, limit)


def interval_doses(
    rows: DataFrame, points: DataFrame | None, starts: DataFrame, stay: str, start: str, end: str, time: str,
    dose: str, width: int, n: int, hot_rows: int | None = None,
) -> DataFrame:
    """Median and maximum dose per stay and bin over the intervals that touch it and the point doses in it."""
    keys = [stay, "bin"]
    e = explode_intervals(rows, starts, stay, start, end, width, n).select(*keys, F.col(dose).cast("double").alias(dose))
    if points is not None:
        p = explode_points(points, starts, stay, time, width, n)
        e = e.unionByName(p.select(*keys, F.col(dose).cast("double").alias(dose)))
    return median_max(e, keys, dose, "median_dose_vaso", "max_dose_vaso", hot_rows)


def before_start(
    starts: DataFrame, stay: str, intervals: Sequence[tuple] = (), points: Sequence[tuple] = (), lumps: Sequence[tuple] = (),
    doubled_edges: bool = False, name: str = "before",
) -> DataFrame:
    """Everything received in [0, first record], plus lump sums recorded without a time.

    `intervals` are (rows, start, end, rate), `points` (rows, time, amount), `lumps` (rows, amount).
    """
    beg = F.col("beg")
    parts = []
    for rows, start, end, rate in intervals:
        j = rows.join(starts, stay).filter(F.col(start) <= beg)
        v = infused(F.col(rate), F.col(start), F.col(end), F.lit(0).cast("long"), beg, doubled_edges)
        parts.append(j.select(stay, v.cast("double").alias("v")))
    for rows, time, amount in points:
        j = rows.join(starts, stay).filter(F.col(time).between(0, beg))
        parts.append(j.select(stay, F.col(amount).cast("double").alias("v")))
    for rows, amount in lumps:
        parts.append(rows.select(stay, F.col(amount).cast("double").alias("v")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(stay).agg(total(F.col("v")).alias(name))


def running_balance(bins: DataFrame, stay: str, order: str, step_in: str, step_out: str, before_in: str, before_out: str) -> DataFrame:
    """Running totals over the emitted bins. A stay has at most as many rows as there are bins."""
    w = Window.partitionBy(stay).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = F.col(before_in) + F.sum(step_in).over(w)
    lost = F.col(before_out) + F.sum(step_out).over(w)
    return bins.withColumns({"input_total": got, "output_total": lost, "cumulated_balance": got - lost})


def demographics_of(stays: DataFrame, bounds: DataFrame) -> DataFrame:
    """Outcome and demographic columns of a stay."""
    close = F.abs(F.col("dod") - F.col("outtime")) < 48 * HOUR
    delay = (F.col("dischtime") - F.col("last_timestep")) / HOUR
    return stays.drop("dischtime").join(bounds.select("icustayid", "last_timestep", "dischtime"), "icustayid").select(
        "icustayid", "gender", "age", "elixhauser", (F.col("adm_order") > 1).cast("int").alias("re_admission"),
        F.col("morta_hosp").alias("died_in_hosp"),
        F.coalesce(close, F.lit(False)).cast("int").alias("died_within_48h_of_out_time"),
        "morta_90", delay.alias("delay_end_of_record_and_discharge_or_death"),
    )


def states_and_actions(
    states: DataFrame, bounds: DataFrame, stays: DataFrame, fluid_intervals: DataFrame, preadmission_fluid: DataFrame,
    vaso_intervals: DataFrame, urine: DataFrame, preadmission_urine: DataFrame, fluid_points: DataFrame | None = None,
    vaso_points: DataFrame | None = None, hours: float = 4.0, hours_before: int = 49, hours_after: int = 25,
    doubled_edges: bool = False, members: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Binned states with treatment and balance columns, and the bin of every state row."""
    if members is not None:
        states = states.join(members.select("icustayid"), "icustayid", "left_semi")
    width = int(hours * HOUR)
    n = -int(-(hours_before + 3 + hours_after + 3) * HOUR // width)
    k = "icustayid"
    starts = bin_starts(states)
    means = bin_means(states, starts, C.STATE_COLUMNS, k, "timestep", width, n)
    doses = interval_doses(vaso_intervals, vaso_points, starts, k, "starttime", "endtime", "charttime", "ratestd", width, n)
    boluses = fluid_intervals.filter(F.col("rate").isNull())
    parts = [
        interval_volumes(fluid_intervals, starts, k, "starttime", "endtime", "norm_infusion_rate", width, n, doubled_edges, "v"),
        point_volumes(boluses, starts, k, "starttime", "tev", width, n, "v"),
    ]
    before_points = [(boluses, "starttime", "tev")]
    if fluid_points is not None:
        parts.append(point_volumes(fluid_points, starts, k, "charttime", "tev", width, n, "v"))
        before_points.append((fluid_points, "charttime", "tev"))
    given = parts[0].select(k, "bin", F.col("v").cast("double"))
    for p in parts[1:]:
        given = given.unionByName(p.select(k, "bin", F.col("v").cast("double")))
    given = given.groupBy(k, "bin").agg(total(F.col("v")).alias("input_step"))
    passed = point_volumes(urine, starts, k, "charttime", "value", width, n, "output_step")
    before_in = before_start(
        starts, k, [(fluid_intervals, "starttime", "endtime", "norm_infusion_rate")], before_points,
        [(preadmission_fluid, "input_preadm")], doubled_edges, "before_in",
    )
    before_out = before_start(starts, k, [], [(urine, "charttime", "value")], [(preadmission_urine, "value")], name="before_out")
    out = (
        means.join(doses, [k, "bin"], "left").join(given, [k, "bin"], "left").join(passed, [k, "bin"], "left")
        .join(before_in, k, "left").join(before_out, k, "left")
        .fillna(0.0, ["input_step", "output_step", "before_in", "before_out"])
    )
    out = running_balance(out, k, "bin", "input_step", "output_step", "before_in", "before_out")
    out = out.join(demographics_of(stays, bounds), k)
    result = out.select(
        (F.col("bin") + 1).alias("bloc"), k, (F.col("beg") + F.col("bin") * width).alias("timestep"),
        *C.DEMOGRAPHICS, *C.STATE_COLUMNS, *C.IN_OUT,
    )
    mapping = row_bins(states, starts, k, "timestep", width, n, ["bloc", k, "timestep"])
    return result, mapping.withColumnRenamed("bin", "bin_index")

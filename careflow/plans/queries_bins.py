"""Queries of binning, volumes, doses, balances and the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.functions import scalar
from careflow.operators import bins, cleaning, cohort, impute, joins, scan
from careflow.plans.queries_clean import COLS, rounded
from careflow.plans.registry import query
from careflow.plans.standins import DAY, INTERVALS, MEASUREMENTS, WIDE, intervals, large_stays, measurements, wide_states
from careflow.session import load

WIDTH, N = 4 * 3600, 180
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in COLS)
_BEGIN = "beg AS (SELECT stay, min(t) AS b FROM wide GROUP BY 1)"
_HELD_HOURS = {"c1": 24, "c2": 24, "c3": 24, "c4": 24, "c5": 24}
_CLEAN = ", ".join(f"CASE WHEN NOT ({c} < 5 OR {c} > 400) THEN {c} END AS {c}" for c in COLS)
_HOLD = ", ".join(
    f"coalesce({c}, CASE WHEN t - last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER w <= 86400 THEN last_value({c} IGNORE NULLS) OVER w END) AS {c}" for c in COLS)


@query("binned_states", "SRC1 PRJ1 AG8 IMP1 IMP6 BLD5 AG3", f"""
WITH {WIDE}, cl AS (SELECT stay, t, {_CLEAN} FROM wide),
hd AS (SELECT stay, t, {_HOLD} FROM cl WINDOW w AS (PARTITION BY stay ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), {_BEGIN}
SELECT hd.stay, CAST(j.i AS BIGINT) AS bin, {_MEANS}, count(*) AS n FROM hd JOIN beg USING (stay), range(0, {N}) j(i)
WHERE t >= b + j.i * {WIDTH} AND t <= b + (j.i + 1) * {WIDTH} GROUP BY 1, 2""")
def binned_states(spark, sf):
    hot = large_stays(spark, sf, "t")
    events = scan.colocate(measurements(spark, sf), ["stay"], hot)
    wide = cleaning.null_outliers(wide_states(spark, sf, events=events), {c: (5, 400) for c in COLS})
    held = impute.hold(wide, "stay", "t", _HELD_HOURS, hot=hot)
    starts = bins.bin_starts(measurements(spark, sf), "stay", "t")
    e = bins.explode_points(held, starts, "stay", "t", WIDTH, N)
    out = e.groupBy("stay", "bin").agg(*[F.avg(c).alias(c) for c in COLS], F.count(F.lit(1)).alias("n"))
    return rounded(out, COLS)


@query("time_bins_closed", "BLD5 AG3", f"""
WITH {INTERVALS}, beg AS (SELECT stay, min("start") AS b FROM iv GROUP BY 1)
SELECT stay, CAST(j.i AS BIGINT) AS bin, round(avg(rate), 6) AS rate, round(avg(amount), 3) AS amount FROM iv JOIN beg USING (stay), range(0, 100) j(i)
WHERE "start" >= b + j.i * {30 * DAY} AND "start" <= b + (j.i + 1) * {30 * DAY} GROUP BY 1, 2""")
def time_bins_closed(spark, sf):
    iv = intervals(spark, sf)
    starts = bins.bin_starts(iv, "stay", "start")
    out = bins.bin_means(iv, starts, ["rate", "amount"], "stay", "start", 30 * DAY, 100)
    return out.select("stay", "bin", F.round("rate", 6).alias("rate"), F.round("amount", 3).alias("amount"))


@query("row_bin_map", "BLD12", f"""
WITH {MEASUREMENTS}, beg AS (SELECT stay, min(t) AS b FROM ev GROUP BY 1)
SELECT id, (SELECT max(j.i) FROM range(0, {N}) j(i) WHERE t >= b + j.i * {WIDTH} AND t <= b + (j.i + 1) * {WIDTH}) AS bin FROM ev JOIN beg USING (stay)""")
def row_bin_map(spark, sf):
    ev = measurements(spark, sf)
    return bins.row_bins(ev, bins.bin_starts(ev, "stay", "t"), "stay", "t", WIDTH, N, ["id"])


_BINS_SQL = f"""WITH {INTERVALS}, beg AS (SELECT stay, min("start") AS b FROM iv GROUP BY 1),
x AS (SELECT iv.*, b, CAST(j.i AS BIGINT) AS bin, b + j.i * {10 * DAY} AS t0, b + (j.i + 1) * {10 * DAY} AS t1 FROM iv JOIN beg USING (stay), range(0, 300) j(i)
      WHERE "start" <= b + (j.i + 1) * {10 * DAY} AND "end" >= b + j.i * {10 * DAY})"""


@query("interval_volume", "JN8 BLD6 AG5", _BINS_SQL + """
SELECT stay, bin, round(coalesce(sum(rate * greatest(least("end", t1) - greatest("start", t0), 0) / 3600), 0), 4) AS volume FROM x WHERE rate IS NOT NULL GROUP BY 1, 2""")
def interval_volume(spark, sf):
    iv = intervals(spark, sf)
    out = bins.interval_volumes(iv, bins.bin_starts(iv, "stay", "start"), "stay", "start", "end", "rate", 10 * DAY, 300)
    return rounded(out, ["volume"], 4)


@query("interval_volume_published", "BLD6", _BINS_SQL + """
SELECT stay, bin, round(coalesce(sum(rate * (CASE WHEN "end" <= t1 AND "start" >= t0 THEN "end" - "start" ELSE 0 END + CASE WHEN "start" <= t0 AND "end" <= t1 AND "end" >= t0 THEN "end" - t0 ELSE 0 END
  + CASE WHEN "start" >= t0 AND "end" >= t1 AND "start" <= t1 THEN t1 - "start" ELSE 0 END + CASE WHEN "end" >= t1 AND "start" <= t0 THEN t1 - t0 ELSE 0 END) / 3600), 0), 4) AS volume
FROM x WHERE rate IS NOT NULL GROUP BY 1, 2""")
def interval_volume_published(spark, sf):
    iv = intervals(spark, sf)
    out = bins.interval_volumes(iv, bins.bin_starts(iv, "stay", "start"), "stay", "start", "end", "rate", 10 * DAY, 300, doubled_edges=True)
    return rounded(out, ["volume"], 4)


@query("bolus_volume", "BLD7 AG5", f"""WITH {INTERVALS}, beg AS MATERIALIZED (SELECT stay, min("start") AS b FROM iv GROUP BY 1),
bo AS MATERIALIZED (SELECT stay, "start", amount, b FROM iv JOIN beg USING (stay) WHERE rate IS NULL)
SELECT stay, CAST(j.i AS BIGINT) AS bin, round(coalesce(sum(amount), 0), 3) AS volume FROM bo, range(0, 300) j(i)
WHERE "start" >= b + j.i * {10 * DAY} AND "start" <= b + (j.i + 1) * {10 * DAY} GROUP BY 1, 2""")
def bolus_volume(spark, sf):
    iv = intervals(spark, sf)
    out = bins.point_volumes(iv.filter("rate is null"), bins.bin_starts(iv, "stay", "start"), "stay", "start", "amount", 10 * DAY, 300)
    return rounded(out, ["volume"], 3)


@query("interval_median_max", "BLD8 AG4 JN8", _BINS_SQL + """, y AS (SELECT stay, bin, rate AS d FROM x WHERE rate IS NOT NULL UNION ALL
  SELECT stay, bin, 0.5 AS d FROM x WHERE rate IS NULL AND "start" >= t0 AND "start" <= t1)
SELECT stay, bin, quantile_cont(d, 0.5) AS median_dose_vaso, max(d) AS max_dose_vaso FROM y GROUP BY 1, 2""")
def interval_median_max(spark, sf):
    iv = intervals(spark, sf).withColumnRenamed("rate", "dose")
    points = iv.filter("dose is null").withColumn("dose", F.lit(0.5)).withColumnRenamed("start", "time")
    starts = bins.bin_starts(iv, "stay", "start")
    return bins.interval_doses(iv.filter("dose is not null"), points, starts, "stay", "start", "end", "time", "dose", 10 * DAY, 300)


@query("before_record", "BLD9", f"""WITH {INTERVALS}, beg AS (SELECT stay, min("start") + 1000 * 86400 AS b FROM iv GROUP BY 1),
p AS (SELECT stay, rate * greatest(least("end", b) - "start", 0) / 3600 AS v FROM iv JOIN beg USING (stay) WHERE "start" <= b AND rate IS NOT NULL
      UNION ALL SELECT stay, amount FROM iv JOIN beg USING (stay) WHERE rate IS NULL AND "start" BETWEEN 0 AND b
      UNION ALL SELECT s_suppkey, s_acctbal FROM supplier)
SELECT stay, round(coalesce(sum(v), 0), 2) AS before FROM p GROUP BY 1""")
def before_record(spark, sf):
    iv = intervals(spark, sf)
    starts = bins.bin_starts(iv, "stay", "start").withColumn("beg", F.col("beg") + 1000 * DAY)
    lumps = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("stay"), F.col("s_acctbal").alias("amount"))
    out = bins.before_start(starts, "stay", [(iv, "start", "end", "rate")], [(iv.filter("rate is null"), "start", "amount")], [(lumps, "amount")])
    return rounded(out, ["before"], 2)


@query("running_balance", "WN4 BLD10", f"""WITH {WIDE}, {_BEGIN}, wb AS MATERIALIZED (SELECT stay, t, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, b FROM wide JOIN beg USING (stay)),
g AS (SELECT stay, CAST(j.i AS BIGINT) AS bin, sum(c1) AS input_step, sum(c2) AS output_step FROM wb, range(0, {N}) j(i)
      WHERE t >= b + j.i * {WIDTH} AND t <= b + (j.i + 1) * {WIDTH} GROUP BY 1, 2)
SELECT stay, bin, round(100 + sum(input_step) OVER w, 4) AS input_total, round(50 + sum(output_step) OVER w, 4) AS output_total,
  round(50 + sum(input_step) OVER w - sum(output_step) OVER w, 4) AS cumulated_balance
FROM g WINDOW w AS (PARTITION BY stay ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_balance(spark, sf):
    wide = wide_states(spark, sf)
    e = bins.explode_points(wide, bins.bin_starts(wide, "stay", "t"), "stay", "t", WIDTH, N)
    g = e.groupBy("stay", "bin").agg(bins.total(F.col("c1")).alias("input_step"), bins.total(F.col("c2")).alias("output_step"))
    out = bins.running_balance(g.withColumns({"b1": F.lit(100.0), "b2": F.lit(50.0)}), "stay", "bin", "input_step", "output_step", "b1", "b2")
    cols = ["input_total", "output_total", "cumulated_balance"]
    return rounded(out.select("stay", "bin", *cols), cols, 4)


@query("stay_demographics", "BLD11", """
WITH s AS (SELECT o_orderkey AS icustayid, o_custkey AS subject, CAST(epoch(o_orderdate) AS BIGINT) + 432000 AS outtime, CASE WHEN o_orderkey % 3 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 9) * 86400 END AS dod,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord, o_orderkey % 2 + 1 AS gender, o_orderkey % 90 AS age, o_orderkey % 11 AS elix, o_orderkey % 2 AS mh, o_orderkey % 5 = 0 AS m90 FROM orders)
SELECT icustayid, CAST(gender AS INT) AS gender, CAST(age AS INT) AS age, CAST(elix AS INT) AS elixhauser, CAST(ord > 1 AS INT) AS re_admission, CAST(mh AS INT) AS died_in_hosp,
  CAST(coalesce(abs(dod - outtime) < 172800, false) AS INT) AS died_within_48h_of_out_time, CAST(m90 AS INT) AS morta_90, 36000 / 3600.0::DOUBLE AS delay_end_of_record_and_discharge_or_death FROM s""")
def stay_demographics(spark, sf):
    from careflow.sources.extract import admission_order

    k, t = F.col("o_orderkey"), scalar.epoch(F.col("o_orderdate"))
    s = load(spark, sf, "orders").select(
        k.alias("icustayid"), F.col("o_custkey").alias("subject"), t.alias("intime"), (t + 5 * DAY).alias("outtime"), F.when(k % 3 == 0, t + (k % 9) * DAY).alias("dod"),
        (k % 2 + 1).cast("int").alias("gender"), (k % 90).cast("int").alias("age"), (k % 11).cast("int").alias("elixhauser"), (k % 2).cast("int").alias("morta_hosp"),
        (k % 5 == 0).cast("int").alias("morta_90"),
    )
    bounds = s.select("icustayid", F.col("intime").alias("last_timestep"), (F.col("intime") + 36000).alias("dischtime"))
    return bins.demographics_of(admission_order(s, "subject", "intime", ["icustayid"]), bounds)


_COHORT_SQL = f"""WITH {MEASUREMENTS}, co AS (SELECT stay, id AS bloc, CAST(stay % 2 AS INT) AS morta_90, CASE WHEN item <> 5 THEN CASE WHEN item = 3 THEN 0.001 ELSE v / 1000 END END AS max_dose_vaso,
  floor(v / 40) AS "SOFA", floor(v / 130) AS "SIRS", v * 25 AS output_step, v * 20 AS "Total_bili", v * 20.2 AS input_step, CAST(stay % 7 = 0 AS INT) AS died, v / 10 AS delay FROM ev),
ext AS (SELECT DISTINCT stay FROM co WHERE output_step > 12200 OR "Total_bili" > 9790 OR input_step > 9890),
c1 AS (SELECT * FROM co WHERE stay NOT IN (SELECT stay FROM ext)),
ag AS (SELECT stay, max(morta_90) AS d, max(max_dose_vaso) AS mv, max("SOFA") AS ms, arg_max(struct_pack(v := max_dose_vaso, s := "SOFA"), bloc) AS l, count(*) AS n FROM c1 GROUP BY 1),
stp AS (SELECT stay FROM ag WHERE d = 1 AND (l.v IS NULL OR l.v < 0.01) AND mv > 0.3 AND l.s >= ms / 2 AND n < 5000),
c2 AS (SELECT * FROM c1 WHERE stay NOT IN (SELECT stay FROM stp)),
die AS (SELECT DISTINCT stay FROM c2 WHERE died = 1 AND delay < 1), c3 AS (SELECT * FROM c2 WHERE stay NOT IN (SELECT stay FROM die))"""
_LIMITS = {"output_step": 12200, "Total_bili": 9790, "input_step": 9890}


def cohort_rows(spark, sf):
    item, v, s = F.col("item"), F.col("v"), F.col("stay")
    return measurements(spark, sf).select(
        "stay", F.col("id").alias("bloc"), (s % 2).cast("int").alias("morta_90"), F.when(item == 3, 0.001).when(item != 5, v / 1000).alias("max_dose_vaso"),
        F.floor(v / 40).cast("double").alias("SOFA"), F.floor(v / 130).cast("double").alias("SIRS"), (v * 25).alias("output_step"), (v * 20).alias("Total_bili"),
        (v * 20.2).alias("input_step"), (s % 7 == 0).cast("int").alias("died"), (v / 10).alias("delay"),
    )


def _kept(spark, sf):
    rules = [
        ("extreme", lambda d: cohort.extreme_stays(d, _LIMITS, "stay")),
        ("stopped", lambda d: cohort.stopped_treatment(d, "stay", blocs=5000)),
        ("died", lambda d: cohort.died_during_record(d, "stay", "died", "delay", 1)),
    ]
    return cohort.exclude_in_turn(cohort_rows(spark, sf), rules, "stay")


@query("cohort_extreme", "CO1 ST2", _COHORT_SQL + " SELECT * FROM ext")
def cohort_extreme(spark, sf):
    return cohort.extreme_stays(cohort_rows(spark, sf), _LIMITS, "stay")


@query("cohort_last_vs_max", "CO2 WN7 AG7", _COHORT_SQL + " SELECT stay FROM stp")
def cohort_last_vs_max(spark, sf):
    rows = cohort_rows(spark, sf)
    kept = joins.drop_members(rows, cohort.extreme_stays(rows, _LIMITS, "stay"), "stay")
    return cohort.stopped_treatment(kept, "stay", blocs=5000)


@query("cohort_stopped", "CO2 WN7 AG7", _COHORT_SQL.replace("FROM c1 GROUP BY 1)", "FROM (SELECT * REPLACE (\"SOFA\" % 4 AS \"SOFA\") FROM co) GROUP BY 1)") + " SELECT stay FROM stp")
def cohort_stopped(spark, sf):
    """Stays that stopped treatment, over all stays and a score in which high values are frequent."""
    return cohort.stopped_treatment(cohort_rows(spark, sf).withColumn("SOFA", F.col("SOFA") % 4), "stay", blocs=5000)


@query("cohort_exclude", "CO3 CO4 JN4 ST3", _COHORT_SQL + """
SELECT 0 AS step, 'extreme' AS rule, (SELECT count(DISTINCT stay) FROM co) AS before, (SELECT count(*) FROM ext) AS removed, (SELECT count(DISTINCT stay) FROM c1) AS after
UNION ALL SELECT 1, 'stopped', (SELECT count(DISTINCT stay) FROM c1), (SELECT count(*) FROM stp), (SELECT count(DISTINCT stay) FROM c2)
UNION ALL SELECT 2, 'died', (SELECT count(DISTINCT stay) FROM c2), (SELECT count(*) FROM die), (SELECT count(DISTINCT stay) FROM c3)""")
def cohort_exclude(spark, sf):
    return _kept(spark, sf)[1]


@query("cohort_table", "CO5 AG1 JN2", _COHORT_SQL + """
SELECT stay, arg_min(morta_90, bloc) AS morta_90, max("SOFA") AS "max_SOFA", max("SIRS") AS "max_SIRS", CASE WHEN stay % 3 <> 0 THEN stay * 100 END AS onset_time
FROM c3 GROUP BY stay HAVING max("SOFA") >= 2""")
def cohort_table(spark, sf):
    kept, _ = _kept(spark, sf)
    onsets = measurements(spark, sf).filter("stay % 3 <> 0").select("stay").distinct().withColumn("onset_time", F.col("stay") * 100)
    return cohort.cohort_table(kept, onsets, "stay")


@query("cohort_members", "CO6 FLT6 JN4", _COHORT_SQL + " SELECT stay, bloc, morta_90 FROM co WHERE stay IN (SELECT stay FROM c3 GROUP BY stay HAVING max(\"SOFA\") >= 2)")
def cohort_members(spark, sf):
    members = cohort.cohort_table(_kept(spark, sf)[0], measurements(spark, sf).select("stay").distinct().withColumn("onset_time", F.lit(0)), "stay")
    return joins.keep_members(cohort_rows(spark, sf).select("stay", "bloc", "morta_90"), members, "stay")

"""Queries of the cleaning, imputation and score operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.functions import scalar
from careflow.operators import cleaning, impute, joins, lineage, report, scan, scores, states
from careflow.plans.registry import query
from careflow.plans.standins import (
    GAPPY, INTERVALS, MEASUREMENTS, STAYS, WIDE, gappy, intervals, large_stays, measurements, stays, wide_states,
)
from careflow.session import load

COLS = ["c1", "c2", "c3", "c4", "c5"]


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


@query("wide_states", "AG8 PRJ4 BLD3", f"WITH {WIDE} SELECT * FROM wide")
def wide(spark, sf):
    return wide_states(spark, sf)


@query("interval_bounds", "AG1 FLT7 IMP1 ST1", f"""
WITH {INTERVALS} SELECT stay, count(*) AS n,
  sum(CASE WHEN rate < 5 OR rate > 45 THEN 1 ELSE 0 END)::BIGINT AS out_rate,
  count(CASE WHEN NOT (rate < 5 OR rate > 45) THEN 1 END) AS kept_rate,
  count(CASE WHEN NOT (amount > 60000) THEN 1 END) AS kept_amount FROM iv GROUP BY stay""")
def interval_bounds(spark, sf):
    iv = intervals(spark, sf)
    bounds = {"rate": (5, 45), "amount": (None, 60000)}
    out = iv.withColumn("o", scalar.outside(F.col("rate"), 5, 45).cast("int"))
    out = cleaning.null_outliers(out, bounds)
    return out.groupBy("stay").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("out_rate"), F.count("rate").alias("kept_rate"), F.count("amount").alias("kept_amount"))


@query("outlier_null", "IMP1 FLT7 FLT8", f"""
WITH {WIDE} SELECT stay, t, CASE WHEN NOT (c1 > 250) THEN c1 END AS c1, CASE WHEN NOT (c2 < 20 OR c2 > 300) THEN c2 END AS c2,
  CASE WHEN NOT (c3 < 100) THEN c3 END AS c3, c4, c5 FROM wide""")
def outlier_null(spark, sf):
    return cleaning.null_outliers(wide_states(spark, sf), {"c1": (None, 250), "c2": (20, 300), "c3": (100, None)})


_VITAL_SQL = """vt AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
  CASE WHEN l_linenumber <> 1 THEN l_quantity * 4 END AS "SysBP", CASE WHEN l_linenumber <> 2 THEN l_quantity * 3 END AS "MeanBP",
  CASE WHEN l_linenumber <> 3 THEN l_quantity * 2 END AS "DiaBP", CASE WHEN l_linenumber NOT IN (1, 4) THEN l_quantity * 2 END AS "Temp_C",
  CASE WHEN l_linenumber NOT IN (1, 2) THEN l_quantity + 20 END AS "Temp_F", CASE WHEN l_linenumber <> 5 THEN l_discount * 100 END AS "Hb",
  CASE WHEN l_linenumber <> 6 THEN l_quantity END AS "Ht", CASE WHEN l_linenumber <> 7 THEN l_tax * 100 END AS "Total_bili",
  CASE WHEN l_linenumber < 4 THEN l_tax * 50 END AS "Direct_bili", CASE WHEN l_linenumber <> 2 THEN l_quantity * 3.2 END AS "SpO2",
  CASE WHEN l_linenumber > 2 THEN l_discount * 300 END AS "FiO2_100", CASE WHEN l_linenumber <> 4 THEN l_discount * 8 END AS "FiO2_1",
  CAST(CASE WHEN l_linenumber <> 6 THEN l_partkey % 8 - 5 END AS DOUBLE) AS "RASS", CASE WHEN l_linenumber = 3 THEN 9.0::DOUBLE END AS "GCS"
  FROM lineitem)"""


def vitals(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.when(n != 1, q * 4).alias("SysBP"), F.when(n != 2, q * 3).alias("MeanBP"), F.when(n != 3, q * 2).alias("DiaBP"),
        F.when(~n.isin(1, 4), q * 2).alias("Temp_C"), F.when(~n.isin(1, 2), q + 20).alias("Temp_F"),
        F.when(n != 5, F.col("l_discount") * 100).alias("Hb"), F.when(n != 6, q).alias("Ht"),
        F.when(n != 7, F.col("l_tax") * 100).alias("Total_bili"), F.when(n < 4, F.col("l_tax") * 50).alias("Direct_bili"),
        F.when(n != 2, q * 3.2).alias("SpO2"), F.when(n > 2, F.col("l_discount") * 300).alias("FiO2_100"),
        F.when(n != 4, F.col("l_discount") * 8).alias("FiO2_1"),
        F.when(n != 6, (F.col("l_partkey") % 8 - 5).cast("double")).alias("RASS"), F.when(n == 3, F.lit(9.0)).alias("GCS"),
    )


@query("unit_repair", "IMP2 IMP1 FLT8", f"""
WITH {_VITAL_SQL},
a AS (SELECT k, n, p, s, "Temp_C", CASE WHEN "Temp_C" > 90 AND "Temp_F" IS NULL THEN "Temp_C" ELSE "Temp_F" END AS "Temp_F",
             CASE WHEN "FiO2_100" < 1 THEN "FiO2_100" * 100 ELSE "FiO2_100" END AS "FiO2_100", "SpO2" FROM vt),
b AS (SELECT k, n, p, s, CASE WHEN NOT "Temp_C" > 90 THEN "Temp_C" END AS "Temp_C", "Temp_F",
             CASE WHEN NOT "FiO2_100" < 20 THEN "FiO2_100" END AS "FiO2_100", CASE WHEN NOT "SpO2" > 150 THEN "SpO2" END AS "SpO2" FROM a)
SELECT k, n, p, s, "Temp_C", "Temp_F", round("FiO2_100", 6) AS "FiO2_100",
       round(CASE WHEN "SpO2" > 100 THEN 100 ELSE "SpO2" END, 6) AS "SpO2" FROM b""")
def unit_repair(spark, sf):
    bounds = {"Temp_C": (None, 90), "FiO2_100": (20, None), "SpO2": (None, 150)}
    out = cleaning.apply_in_turn(vitals(spark, sf), cleaning.unit_stages(bounds))
    return rounded(out.select("k", "n", "p", "s", "Temp_C", "Temp_F", "FiO2_100", "SpO2"), ["FiO2_100", "SpO2"])


@query("unit_pair_fill", "IMP3 FLT8", f"""
WITH {_VITAL_SQL} SELECT k, n, p, s, round(coalesce("FiO2_1", "FiO2_100" / 100), 6) AS "FiO2_1",
  round(coalesce("FiO2_100", "FiO2_1" * 100), 6) AS "FiO2_100" FROM vt""")
def unit_pair_fill(spark, sf):
    out = cleaning.apply_rules(vitals(spark, sf), cleaning.pair_fill_rules())
    return rounded(out.select("k", "n", "p", "s", "FiO2_1", "FiO2_100"), ["FiO2_1", "FiO2_100"])


@query("gcs_estimate", "IMP7", f"""
WITH {_VITAL_SQL} SELECT k, n, p, s, coalesce("GCS", CASE WHEN "RASS" >= 0 THEN 15.0::DOUBLE WHEN "RASS" = -1 THEN 14 WHEN "RASS" = -2 THEN 12
  WHEN "RASS" = -3 THEN 11 WHEN "RASS" = -4 THEN 6 WHEN "RASS" = -5 THEN 3 END) AS "GCS" FROM vt""")
def gcs_estimate(spark, sf):
    return cleaning.apply_rules(vitals(spark, sf), cleaning.gcs_rules()).select("k", "n", "p", "s", "GCS")


@query("vital_completion", "IMP7 FLT8", f"""
WITH {_VITAL_SQL},
a AS (SELECT * REPLACE (CASE WHEN "SysBP" IS NOT NULL AND "MeanBP" IS NOT NULL AND "DiaBP" IS NULL THEN (3 * "MeanBP" - "SysBP") / 2 ELSE "DiaBP" END AS "DiaBP") FROM vt),
b AS (SELECT * REPLACE (CASE WHEN "SysBP" IS NOT NULL AND "DiaBP" IS NOT NULL AND "MeanBP" IS NULL THEN ("SysBP" + 2 * "DiaBP") / 3 ELSE "MeanBP" END AS "MeanBP") FROM a),
c AS (SELECT * REPLACE (CASE WHEN "MeanBP" IS NOT NULL AND "DiaBP" IS NOT NULL AND "SysBP" IS NULL THEN 3 * "MeanBP" - 2 * "DiaBP" ELSE "SysBP" END AS "SysBP") FROM b),
d AS (SELECT * REPLACE (CASE WHEN "Temp_F" > 25 AND "Temp_F" < 45 THEN "Temp_F" ELSE "Temp_C" END AS "Temp_C",
                        CASE WHEN "Temp_F" > 25 AND "Temp_F" < 45 THEN NULL ELSE "Temp_F" END AS "Temp_F") FROM c),
e AS (SELECT * REPLACE (CASE WHEN "Temp_C" > 70 THEN "Temp_C" ELSE "Temp_F" END AS "Temp_F", CASE WHEN "Temp_C" > 70 THEN NULL ELSE "Temp_C" END AS "Temp_C") FROM d),
f AS (SELECT * REPLACE (coalesce("Temp_F", "Temp_C" * 1.8 + 32) AS "Temp_F") FROM e),
g AS (SELECT * REPLACE (coalesce("Temp_C", ("Temp_F" - 32) / 1.8) AS "Temp_C") FROM f),
h AS (SELECT * REPLACE (coalesce("Ht", "Hb" * 2.862 + 1.216) AS "Ht") FROM g),
i AS (SELECT * REPLACE (coalesce("Hb", ("Ht" - 1.216) / 2.862) AS "Hb") FROM h),
j AS (SELECT * REPLACE (coalesce("Direct_bili", "Total_bili" * 0.6934 - 0.1752) AS "Direct_bili") FROM i),
l AS (SELECT * REPLACE (coalesce("Total_bili", ("Direct_bili" + 0.1752) / 0.6934) AS "Total_bili") FROM j)
SELECT k, n, p, s, round("SysBP", 5) AS "SysBP", round("MeanBP", 5) AS "MeanBP", round("DiaBP", 5) AS "DiaBP", round("Temp_C", 5) AS "Temp_C",
  round("Temp_F", 5) AS "Temp_F", round("Hb", 5) AS "Hb", round("Ht", 5) AS "Ht", round("Total_bili", 5) AS "Total_bili",
  round("Direct_bili", 5) AS "Direct_bili" FROM l""")
def vital_completion(spark, sf):
    cols = ["SysBP", "MeanBP", "DiaBP", "Temp_C", "Temp_F", "Hb", "Ht", "Total_bili", "Direct_bili"]
    out = cleaning.apply_in_turn(vitals(spark, sf), cleaning.vital_stages())
    return rounded(out.select("k", "n", "p", "s", *cols), cols, 5)


@query("stepwise_fill", "IMP4", f"""
WITH {MEASUREMENTS} SELECT id, v,
  CASE WHEN v <= 100 THEN 24.0::DOUBLE WHEN v <= 200 THEN 36 WHEN v <= 250 THEN 40 END AS low,
  CASE WHEN v <= 60 THEN 60.0::DOUBLE WHEN v <= 80 THEN 70 WHEN v <= 99.99 THEN 80 WHEN v >= 450 THEN 100 WHEN v >= 150 THEN 90 END AS both FROM ev""")
def stepwise_fill(spark, sf):
    v = F.col("v")
    return measurements(spark, sf).select(
        "id", "v", scalar.stepwise(v, {100: 24, 200: 36, 250: 40}).alias("low"),
        scalar.stepwise(v, {60: 60, 80: 70, 99.99: 80}, {150: 90, 450: 100}).alias("both"),
    )


_OXYGEN_SQL = GAPPY + """, ox AS (SELECT stay AS icustayid, t AS timestep, id,
    CASE WHEN item = 1 THEN floor(v % 11) END AS "Interface", CASE WHEN item = 2 AND stay % 3 = 0 THEN 20 + floor(v % 80) END AS "FiO2_100",
    CASE WHEN item = 3 THEN v % 16 END AS "O2flow", CASE WHEN item = 4 AND stay % 4 = 0 THEN floor(v % 100) / 100 END AS "FiO2_1" FROM gap),
r1 AS (SELECT * REPLACE (coalesce("FiO2_1", "FiO2_100" / 100) AS "FiO2_1", coalesce("FiO2_100", "FiO2_1" * 100) AS "FiO2_100") FROM ox),
hl AS (SELECT *,
    coalesce("Interface", CASE WHEN timestep - last_value(CASE WHEN "Interface" IS NOT NULL THEN timestep END IGNORE NULLS) OVER w <= 24 * 3600 THEN last_value("Interface" IGNORE NULLS) OVER w END) AS i,
    coalesce("FiO2_100", CASE WHEN timestep - last_value(CASE WHEN "FiO2_100" IS NOT NULL THEN timestep END IGNORE NULLS) OVER w <= 12 * 3600 THEN last_value("FiO2_100" IGNORE NULLS) OVER w END) AS f,
    coalesce("O2flow", CASE WHEN timestep - last_value(CASE WHEN "O2flow" IS NOT NULL THEN timestep END IGNORE NULLS) OVER w <= 12 * 3600 THEN last_value("O2flow" IGNORE NULLS) OVER w END) AS o
  FROM r1 WINDOW w AS (PARTITION BY icustayid ORDER BY timestep, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
es AS (SELECT * REPLACE (CASE
    WHEN f IS NULL AND o IS NOT NULL AND i IN (0, 2) THEN CASE WHEN o <= 1 THEN 24 WHEN o <= 2 THEN 28 WHEN o <= 3 THEN 32 WHEN o <= 4 THEN 36 WHEN o <= 5 THEN 40 WHEN o <= 6 THEN 44 WHEN o <= 8 THEN 50 WHEN o <= 10 THEN 55 WHEN o <= 12 THEN 62 WHEN o <= 15 THEN 70 END
    WHEN f IS NULL AND o IS NULL AND i IN (0, 2) THEN 21
    WHEN f IS NULL AND o IS NOT NULL AND (i IS NULL OR i IN (1, 3, 4, 5, 6, 9, 10)) THEN CASE WHEN o <= 4 THEN 36 WHEN o <= 6 THEN 40 WHEN o <= 8 THEN 58 WHEN o <= 10 THEN 66 WHEN o <= 12 THEN 69 WHEN o <= 15 THEN 75 END
    WHEN f IS NULL AND o IS NULL AND (i IS NULL OR i IN (1, 3, 4, 5, 6, 9, 10)) THEN NULL
    WHEN f IS NULL AND o IS NOT NULL AND i = 7 THEN CASE WHEN o <= 6 THEN 60 WHEN o <= 8 THEN 70 WHEN o <= 9.99 THEN 80 WHEN o >= 15 THEN 100 WHEN o >= 10 THEN 90 END
    WHEN f IS NULL AND o IS NULL AND i = 7 THEN NULL ELSE "FiO2_100" END AS "FiO2_100") FROM hl)"""


@query("fio2_estimate", "IMP5 IMP6 IMP3", f"""
WITH {_OXYGEN_SQL} SELECT icustayid, timestep, id, round(coalesce("FiO2_1", "FiO2_100" / 100), 6) AS "FiO2_1",
  round(coalesce("FiO2_100", "FiO2_1" * 100), 6) AS "FiO2_100" FROM es""")
def fio2_estimate(spark, sf):
    item, v, stay = F.col("item"), F.col("v"), F.col("stay")
    ox = gappy(spark, sf).select(
        stay.alias("icustayid"), F.col("t").alias("timestep"), "id", F.when(item == 1, F.floor(v % 11).cast("double")).alias("Interface"),
        F.when((item == 2) & (stay % 3 == 0), 20.0 + F.floor(v % 80)).alias("FiO2_100"), F.when(item == 3, v % 16).alias("O2flow"),
        F.when((item == 4) & (stay % 4 == 0), F.floor(v % 100) / 100).alias("FiO2_1"),
    )
    out = cleaning.estimate_fio2(ox, tie=["id"])
    return rounded(out.select("icustayid", "timestep", "id", "FiO2_1", "FiO2_100"), ["FiO2_1", "FiO2_100"])


def _hold_sql(c: str, hours: int) -> str:
    at = f"last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER w"
    return f"coalesce({c}, CASE WHEN t - {at} <= {hours * 3600} THEN last_value({c} IGNORE NULLS) OVER w END) AS {c}"


_HOLD_HOURS = {"c1": 2, "c2": 6, "c3": 24, "c4": 72, "c5": 168}
_HELD = WIDE + ", held AS (SELECT stay, t, " + ", ".join(_hold_sql(c, h) for c, h in _HOLD_HOURS.items()) + """
  FROM wide WINDOW w AS (PARTITION BY stay ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def held(spark, sf):
    """Pivot and hold share one shuffle by stay."""
    hot = large_stays(spark, sf, "t")
    events = scan.colocate(measurements(spark, sf), ["stay"], hot)
    return impute.hold(wide_states(spark, sf, events=events), "stay", "t", _HOLD_HOURS, hot=hot)


@query("sample_and_hold", "IMP6 WN2", f"WITH {_HELD} SELECT * FROM held")
def sample_and_hold(spark, sf):
    return held(spark, sf)


_MASK = ", ".join(
    f"CAST(CASE WHEN o.{c} IS NOT NULL AND h.{c} IS NULL THEN -1 WHEN o.{c} IS DISTINCT FROM h.{c} THEN 1 ELSE 0 END AS TINYINT) AS {c}" for c in COLS)


@query("change_mask", "IMP11", f"""
WITH {_HELD}, o AS (SELECT stay, t, CASE WHEN c1 <= 250 THEN c1 END AS c1, c2, c3, c4, c5 FROM wide)
SELECT o.stay, o.t, {_MASK.replace('o.', 'h0.').replace('h.', 'n0.')} FROM held h0 JOIN o n0 ON h0.stay = n0.stay AND h0.t = n0.t
JOIN o ON o.stay = h0.stay AND o.t = h0.t""")
def change_mask(spark, sf):
    new = cleaning.null_outliers(wide_states(spark, sf), {"c1": (None, 250)})
    return cleaning.change_mask(held(spark, sf), new, ["stay", "t"], COLS)


def _interp_sql(part: str) -> str:
    return f"""
pos AS (SELECT *, row_number() OVER ({part} ORDER BY id) AS p FROM gap),
nb AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
              first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1 FROM pos
       WINDOW b AS ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              a AS ({part} ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT id, stay, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / (p1 - p0)), 6) AS v FROM nb"""


@query("interp_by_stay", "IMP9 WN3", f"WITH {GAPPY}, {_interp_sql('PARTITION BY stay')}")
def interp_by_stay(spark, sf):
    return impute.interpolate(gappy(spark, sf), ["id"], ["v"], by=["stay"]).select("id", "stay", F.round("v", 6).alias("v"))


@query("interp_log", "LN1 IMP9 WN3", f"""WITH {GAPPY}, n AS (SELECT id, stay, v, last_value(CASE WHEN v IS NOT NULL THEN id END IGNORE NULLS) OVER (PARTITION BY stay ORDER BY id) AS a,
  first_value(CASE WHEN v IS NOT NULL THEN id END IGNORE NULLS) OVER (PARTITION BY stay ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM gap)
SELECT stay || ':' || id AS value_row, 'v' AS value_col, 'linear interpolation' AS change_type, NULL::VARCHAR AS metadata, stay || ':' || unnest([a, b]) AS reference_row, 'v' AS reference_col
FROM n WHERE v IS NULL AND a IS NOT NULL AND b IS NOT NULL""")
def interp_log(spark, sf):
    """A record for each end of the gap that a value was interpolated in."""
    row = F.concat_ws(":", "stay", "id")
    out = impute.interpolate(gappy(spark, sf), ["id"], ["v"], by=["stay"], suffix="__new", source="__from", origin=row)
    return lineage.cell_log(out, row, {"v": F.col("v__from")}, "linear interpolation")


@query("interp_global", "IMP9 WN3 WN11", f"WITH {GAPPY}, {_interp_sql('')}")
def interp_global(spark, sf):
    return impute.interpolate(gappy(spark, sf), ["id"], ["v"]).select("id", "stay", F.round("v", 6).alias("v"))


@query("interp_low_missing", "IMP9 AG9", f"""
WITH {MEASUREMENTS}, gap AS (SELECT id, stay, CASE WHEN id % 25 <> 0 THEN v END AS v, CASE WHEN id % 3 <> 0 THEN v END AS x FROM ev), {_interp_sql('').replace('SELECT id, stay, round', 'SELECT id, stay, x, round')}""")
def interp_low_missing(spark, sf):
    ev = measurements(spark, sf).select("id", "stay", F.when(F.col("id") % 25 != 0, F.col("v")).alias("v"), F.when(F.col("id") % 3 != 0, F.col("v")).alias("x"))
    return impute.interpolate_sparse_gaps(ev, ["id"], ["v", "x"]).select("id", "stay", "x", F.round("v", 6).alias("v"))


@query("row_blocks", "WN11", f"WITH {MEASUREMENTS} SELECT id, row_number() OVER (ORDER BY stay, id) AS row, CAST(floor((row_number() OVER (ORDER BY stay, id) - 1) / 100) AS BIGINT) AS block FROM ev")
def row_blocks(spark, sf):
    return impute.row_blocks(measurements(spark, sf), ["stay", "id"], 100).select("id", "row", "block")


_KNN_DIMS, _KNN_BLOCK = 64, 10_000
_KNN_COLS = [f"x{i}" for i in range(_KNN_DIMS)]
_KNN_SQL = "WITH e AS (SELECT vec_id, " + ", ".join(
    f"CASE WHEN (vec_id * 7 + {i} * 3) % 5 <> 0 THEN round(CAST(embedding[{i + 1}] AS DOUBLE), 6) END AS x{i}" for i in range(_KNN_DIMS)
) + f""" FROM embeddings),
b AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS row, (row_number() OVER (ORDER BY vec_id) - 1) // {_KNN_BLOCK} AS blk FROM e),
d AS (SELECT l.row AS a, r.row AS z, """ + " + ".join(f"coalesce((l.x{i} - r.x{i}) * (l.x{i} - r.x{i}), 0)" for i in range(_KNN_DIMS)) + " AS s, " + " + ".join(
    f"CAST(l.x{i} IS NOT NULL AND r.x{i} IS NOT NULL AS INT)" for i in range(_KNN_DIMS)
) + """ AS c FROM b l JOIN b r ON l.blk = r.blk),
dd AS (SELECT a, z, CASE WHEN c > 0 THEN s / c ELSE 1e300 END AS dist FROM d),
""" + ",\n".join(
    f"f{i} AS (SELECT a, arg_min(q.x{i}, struct_pack(d := dist, z := z)) AS y FROM dd JOIN b q ON q.row = z WHERE q.x{i} IS NOT NULL GROUP BY a)" for i in range(_KNN_DIMS)
) + "\nSELECT vec_id, " + ", ".join(f"coalesce(x{i}, f{i}.y) AS x{i}" for i in range(_KNN_DIMS)) + " FROM b " + " ".join(
    f"LEFT JOIN f{i} ON f{i}.a = b.row" for i in range(_KNN_DIMS))


@query("knn_block", "IMP8 JN9 WN11", _KNN_SQL)
def knn_block(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", *[
        F.when((F.col("vec_id") * 7 + i * 3) % 5 != 0, F.round(F.get("embedding", F.lit(i)).cast("double"), 6)).alias(f"x{i}")
        for i in range(_KNN_DIMS)
    ])
    return impute.fill_from_nearest(e, ["vec_id"], _KNN_COLS, _KNN_BLOCK).drop("row")


_KNN_LOG_SQL = _KNN_SQL[: _KNN_SQL.index("f0 AS (")] + ",\n".join(
    f"f{i} AS (SELECT a, min(struct_pack(d := dist, z := z)) AS m FROM dd JOIN b q ON q.row = z WHERE q.x{i} IS NOT NULL GROUP BY a)" for i in range(_KNN_DIMS)
) + ",\nr AS (" + " UNION ALL ".join(f"SELECT b.row, 'x{i}' AS c, m FROM b JOIN f{i} ON f{i}.a = b.row WHERE b.x{i} IS NULL" for i in range(_KNN_DIMS)) + """)
SELECT 'v' || t.vec_id AS value_row, c AS value_col, 'nearest row' AS change_type, CASE WHEN m.d < 1e300 THEN 'shares columns' ELSE 'shares none' END AS metadata, 'v' || s.vec_id AS reference_row, c AS reference_col
FROM r JOIN b t ON t.row = r.row JOIN b s ON s.row = m.z"""


@query("knn_log", "LN1 IMP8", _KNN_LOG_SQL)
def knn_log(spark, sf):
    """A record for every cell filled from the nearest row, keyed by the rows' own names."""
    e = load(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "vec_id", *[
        F.when((F.col("vec_id") * 7 + i * 3) % 5 != 0, F.round(F.get("embedding", F.lit(i)).cast("double"), 6)).alias(f"x{i}")
        for i in range(_KNN_DIMS)
    ])
    out = impute.fill_from_nearest(e, ["vec_id"], _KNN_COLS, _KNN_BLOCK, source="__from", origin="name")
    made_from = {c: F.when(F.col(f"{c}__from").isNotNull(), F.array(F.col(f"{c}__from")["origin"])) for c in _KNN_COLS}
    near = {c: F.when(F.col(f"{c}__from")["distance"] < float("inf"), "shares columns").otherwise("shares none") for c in _KNN_COLS}
    return lineage.cell_log(out, F.col("name"), made_from, "nearest row", near)


@query("feature_corrections", "IMP10 FLT3 AG11", """
WITH m AS (SELECT quantile_cont(CASE WHEN l_linenumber <> 3 THEN l_partkey % 9 END, 0.5) AS md FROM lineitem)
SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_suppkey % 2 + 1 - 1 AS BIGINT) AS gender,
  CASE WHEN l_partkey % 220 > 150 THEN 91 ELSE l_partkey % 220 END AS age,
  CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE WHEN l_discount > 0 THEN 1.0 ELSE l_discount END AS mechvent,
  CASE WHEN l_linenumber = 3 THEN md ELSE CAST(l_partkey % 9 AS DOUBLE) END AS elixhauser,
  CASE WHEN l_linenumber = 2 THEN 0.0::DOUBLE ELSE l_tax END AS median_dose_vaso,
  CASE WHEN l_linenumber = 5 THEN 0.0::DOUBLE ELSE l_discount END AS max_dose_vaso FROM lineitem, m""")
def feature_corrections(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    df = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), p.alias("p"), (F.col("l_suppkey") % 2 + 1).alias("gender"), (p % 220).alias("age"),
        F.when(n != 1, F.col("l_discount")).alias("mechvent"), F.when(n != 3, (p % 9).cast("double")).alias("elixhauser"),
        F.when(n != 2, F.col("l_tax")).alias("median_dose_vaso"), F.when(n != 5, F.col("l_discount")).alias("max_dose_vaso"),
    )
    median = scan.exact_quantiles(df, [], "elixhauser", {"m": 0.5}).first()["m"]
    return cleaning.apply_in_turn(df, cleaning.correction_stages(median))


_SCORE_SQL = """sc AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 200 END AS "PaO2_FiO2", l_quantity * 5 AS "Platelets_count", l_tax * 160 AS "Total_bili",
  40 + l_quantity AS "MeanBP", l_discount * 2 - 0.1 AS max_dose_vaso, CAST(3 + l_partkey % 13 AS DOUBLE) AS "GCS", (l_suppkey % 60) / 10.0::DOUBLE AS "Creatinine",
  CAST(l_partkey % 300 * 9 AS DOUBLE) AS output_step, 30 + l_quantity / 5 AS "Temp_C", CASE WHEN l_linenumber <> 6 THEN l_quantity * 4 END AS "HR",
  CASE WHEN l_linenumber <> 5 THEN l_quantity END AS "RR", CAST(l_suppkey % 70 AS DOUBLE) AS "paCO2", l_quantity / 2 AS "WBC_count", CAST(l_partkey % 100 AS DOUBLE) AS age,
  CAST(l_partkey % 250 AS DOUBLE) AS "SysBP", CAST(l_suppkey % 120 AS DOUBLE) AS "BUN", l_discount * 70 AS "Potassium", 100.0::DOUBLE + l_quantity AS "Sodium",
  l_quantity / 2 AS "HCO3", CAST(l_linenumber % 2 AS DOUBLE) AS mechvent FROM lineitem)"""


def score_rows(spark, sf):
    q, p, s, n = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    d = lambda c: c.cast("double")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), p.alias("p"), s.alias("s"),
        F.when(n != 7, F.col("l_extendedprice") / 200).alias("PaO2_FiO2"), (q * 5).alias("Platelets_count"), (F.col("l_tax") * 160).alias("Total_bili"),
        (40 + q).alias("MeanBP"), (F.col("l_discount") * 2 - 0.1).alias("max_dose_vaso"), d(3 + p % 13).alias("GCS"), ((s % 60) / 10.0).alias("Creatinine"),
        d(p % 300 * 9).alias("output_step"), (30 + q / 5).alias("Temp_C"), F.when(n != 6, q * 4).alias("HR"), F.when(n != 5, q).alias("RR"),
        d(s % 70).alias("paCO2"), (q / 2).alias("WBC_count"), d(p % 100).alias("age"), d(p % 250).alias("SysBP"), d(s % 120).alias("BUN"),
        (F.col("l_discount") * 70).alias("Potassium"), (100 + q).alias("Sodium"), (q / 2).alias("HCO3"), d(n % 2).alias("mechvent"),
    )


def _first(pairs: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(pairs)) + " ELSE 0 END"


_SOFA_SQL = " + ".join(_first(x) for x in [
    ['"PaO2_FiO2" > 400', '"PaO2_FiO2" >= 300 AND "PaO2_FiO2" < 400', '"PaO2_FiO2" >= 200 AND "PaO2_FiO2" < 300', '"PaO2_FiO2" >= 100 AND "PaO2_FiO2" < 200', '"PaO2_FiO2" < 100'],
    ['"Platelets_count" > 150', '"Platelets_count" >= 100 AND "Platelets_count" < 150', '"Platelets_count" >= 50 AND "Platelets_count" < 100', '"Platelets_count" >= 20 AND "Platelets_count" < 50', '"Platelets_count" < 20'],
    ['"Total_bili" < 1.2::DOUBLE', '"Total_bili" >= 1.2::DOUBLE AND "Total_bili" < 2', '"Total_bili" >= 2 AND "Total_bili" < 6', '"Total_bili" >= 6 AND "Total_bili" < 12', '"Total_bili" > 12'],
    ['"MeanBP" >= 70', '"MeanBP" < 70 AND "MeanBP" >= 65', '"MeanBP" < 65', "max_dose_vaso > 0 AND max_dose_vaso <= 0.1::DOUBLE", "max_dose_vaso > 0.1::DOUBLE"],
    ['"GCS" > 14', '"GCS" > 12 AND "GCS" <= 14', '"GCS" > 9 AND "GCS" <= 12', '"GCS" > 5 AND "GCS" <= 9', '"GCS" <= 5'],
    ['"Creatinine" < 1.2::DOUBLE', '"Creatinine" >= 1.2::DOUBLE AND "Creatinine" < 2', '"Creatinine" >= 2 AND "Creatinine" < 3.5::DOUBLE', '("Creatinine" >= 3.5::DOUBLE AND "Creatinine" < 5) OR output_step < 500 * 4.0::DOUBLE / 24', '"Creatinine" > 5 OR output_step < 200 * 4.0::DOUBLE / 24'],
])


@query("score_bands", "SC3", f"WITH {_SCORE_SQL} SELECT k, n, p, s, {_SOFA_SQL} AS sofa FROM sc")
def score_bands(spark, sf):
    return score_rows(spark, sf).select("k", "n", "p", "s", scores.sofa().alias("sofa"))


@query("score_count", "SC4", f"""WITH {_SCORE_SQL} SELECT k, n, p, s,
  CAST(coalesce("Temp_C" >= 38 OR "Temp_C" <= 36, false) AS INT) + CAST(coalesce("HR" > 90, false) AS INT)
  + CAST(coalesce("RR" >= 20 OR "paCO2" <= 32, false) AS INT) + CAST(coalesce("WBC_count" >= 12 OR "WBC_count" < 4, false) AS INT) AS sirs FROM sc""")
def score_count(spark, sf):
    return score_rows(spark, sf).select("k", "n", "p", "s", scores.sirs().alias("sirs"))


def _bands_sql(c: str, edges, points) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 " + " ".join(f"WHEN {c} < {e} THEN {p}" for e, p in zip(edges, points)) + f" ELSE {points[-1]} END"


_SAPS_SQL = " + ".join([
    _bands_sql("age", [40, 60, 70, 75, 80], [0, 7, 12, 15, 16, 18]), _bands_sql('"HR"', [40, 70, 120, 160], [11, 2, 0, 4, 7]),
    _bands_sql('"SysBP"', [70, 100, 200], [13, 5, 0, 2]), _bands_sql('"Temp_C"', [39], [0, 3]),
    "mechvent * (" + _bands_sql('"PaO2_FiO2"', [100, 200], [11, 9, 6]) + ")", _bands_sql("output_step", [500, 1000], [11, 4, 0]),
    _bands_sql('"BUN"', [28, 84], [0, 6, 10]), _bands_sql('"WBC_count"', [1, 20], [12, 0, 3]), _bands_sql('"Potassium"', [3, 5], [3, 0, 3]),
    _bands_sql('"Sodium"', [125, 145], [5, 0, 1]), _bands_sql('"HCO3"', [15, 20], [5, 3, 0]), _bands_sql('"Total_bili"', [4, 6], [0, 4, 9]),
    _bands_sql('"GCS"', [6, 9, 11, 14], [26, 13, 7, 5, 0]),
])


@query("score_acute", "SC5", f"WITH {_SCORE_SQL} SELECT k, n, p, s, CAST({_SAPS_SQL} AS DOUBLE) AS saps FROM sc")
def score_acute(spark, sf):
    return score_rows(spark, sf).select("k", "n", "p", "s", scores.saps2().alias("saps"))


_OASIS_SQL = " + ".join([
    "mechvent * 9", "CASE WHEN age < 24 THEN 0 WHEN age <= 53 THEN 3 WHEN age <= 77 THEN 6 WHEN age <= 89 THEN 9 ELSE 7 END",
    'CASE WHEN "MeanBP" < 20.65 THEN 4 WHEN "MeanBP" < 51 THEN 3 WHEN "MeanBP" < 61.33 THEN 2 WHEN "MeanBP" < 143.44 THEN 0 ELSE 3 END',
    'CASE WHEN "GCS" <= 7 THEN 10 WHEN "GCS" < 14 THEN 4 WHEN "GCS" = 14 THEN 3 ELSE 0 END',
    'CASE WHEN "HR" IS NULL THEN 0 WHEN "HR" < 33 THEN 4 WHEN "HR" < 89 THEN 0 WHEN "HR" < 106 THEN 1 WHEN "HR" <= 125 THEN 3 ELSE 6 END',
    'CASE WHEN "RR" IS NULL THEN 0 WHEN "RR" < 6 THEN 10 WHEN "RR" < 13 THEN 1 WHEN "RR" < 22 THEN 0 WHEN "RR" < 30 THEN 1 WHEN "RR" < 44 THEN 6 ELSE 9 END',
    'CASE WHEN "Temp_C" < 33.22::DOUBLE THEN 3 WHEN "Temp_C" < 35.93::DOUBLE THEN 4 WHEN "Temp_C" < 36.89::DOUBLE THEN 2 WHEN "Temp_C" <= 39.88::DOUBLE THEN 2 ELSE 6 END',
    "CASE WHEN output_step < 671.09 THEN 10 WHEN output_step < 1427 THEN 5 WHEN output_step <= 2514 THEN 1 WHEN output_step <= 6896 THEN 0 ELSE 8 END",
])


@query("score_oasis", "SC6", f"WITH {_SCORE_SQL} SELECT k, n, p, s, CAST({_OASIS_SQL} AS DOUBLE) AS oasis FROM sc")
def score_oasis(spark, sf):
    return score_rows(spark, sf).select("k", "n", "p", "s", scores.oasis().alias("oasis"))


@query("ratio_mean_fill", "SC1 SC2 AG11 PRJ5", """
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity / (l_partkey % 5) END AS x FROM lineitem)
SELECT k, n, p, round(coalesce(x, (SELECT avg(x) FROM r)), 6) AS ratio FROM r""")
def ratio_mean_fill(spark, sf):
    df = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                                            F.col("l_quantity").alias("a"), (F.col("l_partkey") % 5).alias("b"))
    return scores.with_mean_filled_ratio(df, "a", "b", "ratio").select("k", "n", "p", F.round("ratio", 6).alias("ratio"))


@query("missingness", "AG9", f"WITH {WIDE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS share FROM wide" for c in COLS))
def missingness(spark, sf):
    return report.missingness(wide_states(spark, sf), COLS).withColumn("share", F.round("share", 6))


@query("scalar_functions", "FLT2 FLT3", f"""
WITH {MEASUREMENTS}, h AS (SELECT *, CASE WHEN id % 2 = 0 THEN v END AS w FROM ev)
SELECT id, round(round_even(v / 0.5, 0) * 0.5, 6) AS quantised, CAST((v >= 50)::INT + (v >= 100)::INT + (v >= 300)::INT AS INT) AS bin,
  coalesce(w, t::DOUBLE) AS filled, coalesce(w, 0.0) AS zeroed,
  list_transform(range(0, 5), lambda i: CASE WHEN i = item - 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot FROM h""")
def scalar_functions(spark, sf):
    v, w = F.col("v"), F.when(F.col("id") % 2 == 0, F.col("v"))
    return measurements(spark, sf).select(
        "id", F.round(scalar.quantise(v, 0.5), 6).alias("quantised"), scalar.digitize(v, [50.0, 100.0, 300.0]).alias("bin"),
        F.coalesce(w, F.col("t").cast("double")).alias("filled"), F.coalesce(w, F.lit(0.0)).alias("zeroed"),
        scalar.one_hot(F.col("item") - 1, 5).alias("hot"),
    )


@query("contain_fallback", "JN6 BLD1", f"""
WITH {STAYS}, e AS (SELECT l_suppkey * 10 + l_linenumber AS subject, l_orderkey AS admission, CAST(epoch(l_shipdate) AS BIGINT) AS t,
         CASE WHEN l_linenumber = 1 THEN l_partkey END AS stay FROM lineitem),
s2 AS (SELECT subject, admission // 3 * 3 AS admission, admission AS stay, intime, outtime FROM st),
c AS (SELECT subject, t, min(s2.stay) AS stay FROM (SELECT DISTINCT subject, t FROM e) JOIN s2 USING (subject) WHERE intime <= t + 172800 AND outtime >= t - 172800 GROUP BY 1, 2),
o AS (SELECT admission, min(stay) AS stay FROM s2 GROUP BY 1 HAVING count(*) = 1)
SELECT e.subject, e.admission, e.t, coalesce(e.stay, c.stay, o.stay) AS stay FROM e LEFT JOIN c ON c.subject = e.subject AND c.t = e.t LEFT JOIN o ON o.admission = e.admission""")
def contain_fallback(spark, sf):
    n = F.col("l_linenumber")
    e = load(spark, sf, "lineitem").select((F.col("l_suppkey") * 10 + n).alias("subject"), F.col("l_orderkey").alias("admission"),
                                           scalar.epoch(F.col("l_shipdate")).alias("t"), F.when(n == 1, F.col("l_partkey")).alias("stay"))
    s = stays(spark, sf).select("subject", (F.floor(F.col("admission") / 3) * 3).alias("admission"), F.col("admission").alias("stay"), "intime", "outtime")
    return joins.impute_stay_ids(e, s, "subject", "admission", "stay", "t")


_NEAR = f"""WITH {MEASUREMENTS}, ab AS (SELECT DISTINCT stay, t FROM ev WHERE item = 1), cu AS (SELECT stay, t, min(id) AS id FROM ev WHERE item = 2 GROUP BY 1, 2),
nr AS (SELECT ab.stay, ab.t, arg_min(cu.t, struct_pack(d := abs(cu.t - ab.t), c := cu.t)) AS near_time, arg_min(cu.id, struct_pack(d := abs(cu.t - ab.t), c := cu.t)) AS id
       FROM ab LEFT JOIN cu ON ab.stay = cu.stay GROUP BY 1, 2)"""


@query("nearest_event", "JN7 SR3", _NEAR + " SELECT * FROM nr")
def nearest_event(spark, sf):
    ev = measurements(spark, sf)
    return joins.nearest_event(ev.filter("item = 1").select("stay", "t").distinct(), ev.filter("item = 2").select("stay", F.col("t").alias("ct"), "id"), "stay", "t", "ct", ["id"])


@query("onset", "BLD2 JN7", _NEAR + """, ok AS (SELECT *, CASE WHEN near_time >= t AND near_time - t <= 24 * 3600 THEN t WHEN near_time <= t AND t - near_time <= 72 * 3600 THEN near_time END AS o FROM nr)
SELECT stay AS icustayid, arg_min(id, t) AS subject_id, arg_min(o, t) AS onset_time FROM ok WHERE o IS NOT NULL GROUP BY 1""")
def onset(spark, sf):
    ev = measurements(spark, sf).withColumnRenamed("stay", "icustayid")
    treat = ev.filter("item = 1").select("icustayid", F.col("t").alias("startdate"))
    cult = ev.filter("item = 2").select("icustayid", F.col("t").alias("charttime"), F.col("id").alias("subject_id"))
    return states.onset(treat, cult)


@query("around_onset", "FLT4 FLT5 BLD4", _NEAR + """, ok AS (SELECT *, CASE WHEN near_time >= t AND near_time - t <= 24 * 3600 THEN t WHEN near_time <= t AND t - near_time <= 72 * 3600 THEN near_time END AS o FROM nr),
os AS (SELECT stay, arg_min(o, t) AS o FROM ok WHERE o IS NOT NULL AND stay % 60 >= 18 GROUP BY 1)
SELECT stay, o AS onset_time, min(t) AS first_timestep, max(t) AS last_timestep, count(*) AS n FROM ev JOIN os USING (stay) WHERE t BETWEEN o - 53 * 3600 AND o + 29 * 3600 GROUP BY 1, 2""")
def around_onset(spark, sf):
    os = onset(spark, sf).filter(F.col("icustayid") % 60 >= 18).select(F.col("icustayid").alias("stay"), "onset_time")
    rows = joins.around(measurements(spark, sf), os, "stay", "t", "onset_time", 53 * 3600, 29 * 3600)
    return rows.groupBy("stay", "onset_time").agg(F.min("t").alias("first_timestep"), F.max("t").alias("last_timestep"), F.count(F.lit(1)).alias("n"))


@query("top_stays", "SR1 SR2 ST3 JN4", f"""
WITH {MEASUREMENTS}, d AS (SELECT DISTINCT stay FROM ev WHERE stay NOT IN (SELECT stay FROM ev WHERE v > 450)) SELECT stay FROM d ORDER BY stay LIMIT 20""")
def top_stays(spark, sf):
    ev = measurements(spark, sf)
    kept = joins.drop_members(ev.select("stay").distinct(), ev.filter("v > 450").select("stay").distinct(), "stay")
    return kept.orderBy("stay").limit(20)

"""Queries that write a table and read it back, and the state rows built from several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow import constants as C
from careflow.operators import bins, impute, joins, lineage, mdp, series, states
from careflow.plans.queries_clean import rounded
from careflow.plans.queries_model import counts
from careflow.plans.registry import query
from careflow.plans.standins import COUNTS, INTERVALS, MEASUREMENTS, STAYS, intervals, large_stays, measurements, stays
from careflow.session import cut_lineage, load, scratch_path
from careflow.sources import chunks, io


@query("stage_tables", "SRC1 SRC2 SNK1", f"WITH {MEASUREMENTS} SELECT stay AS icustayid, t AS charttime, CAST(item AS BIGINT) AS itemid, v AS value FROM ev")
def stage_tables(spark, sf):
    """Written as a raw extract with short floats; the intermediate table is absent, so the raw one is read."""
    root = scratch_path(spark, "stage")
    ev = measurements(spark, sf).select(F.col("stay").alias("icustayid"), F.col("t").alias("charttime"), F.col("item").cast("long").alias("itemid"), F.col("v").alias("value"))
    io.write_table(ev, f"{root}/raw_data/uo.csv", "csv", short_floats=True)
    return io.read_stage_table(spark, root, "uo")


@query("chunked_extract", "SRC3 SRC4 SRC5 SRC8", f"WITH {STAYS} SELECT subject AS subject_id, admission AS hadm_id, intime AS charttime, CAST(subject // 200 AS BIGINT) AS chunk FROM st")
def chunked_extract(spark, sf):
    """Ranges of 200 subjects: a first run has only the first five, a second run over all rows adds what the manifest does not list."""
    path = scratch_path(spark, "chunks")
    rows = io.rename_by_position(stays(spark, sf).select("subject", "admission", "intime"), ["subject_id", "hadm_id", "charttime"])
    chunks.write(rows.filter("subject_id < 1000"), path, "subject_id", step=200)
    chunks.write(rows, path, "subject_id", step=200, skip_present=True)
    return chunks.read(spark, path)


@query("chunk_manifest", "SRC4 SRC5", f"WITH {STAYS}, c AS (SELECT CAST(i AS BIGINT) AS chunk FROM range(-1, 10) r(i)) SELECT chunk, CAST(count(subject) AS BIGINT) AS rows FROM c LEFT JOIN st ON CASE WHEN subject // 500 BETWEEN 0 AND 9 THEN subject // 500 ELSE -1 END = chunk GROUP BY 1")
def chunk_manifest(spark, sf):
    """Ten ranges of 500 subjects and the rest, written twice; what the manifest counts, once for each."""
    path = scratch_path(spark, "manifest")
    rows = io.rename_by_position(stays(spark, sf).select("subject", "admission", "intime"), ["subject_id", "hadm_id", "charttime"])
    for _ in range(2):
        chunks.write(rows, path, "subject_id", step=500, chunks=10, skip_present=True)
    return chunks.manifest(spark, path).select("chunk", "rows")


@query("clustered_fetch", "SRC8", f"WITH {INTERVALS} SELECT stay, \"start\", item FROM iv WHERE stay BETWEEN 10 AND 40")
def clustered_fetch(spark, sf):
    path = scratch_path(spark, "clustered")
    io.write_clustered(intervals(spark, sf).select("stay", "start", "item"), path, "stay", "start")
    return spark.read.parquet(path).filter(F.col("stay").between(10, 40))


@query("capped_files", "SNK4", f"WITH {INTERVALS} SELECT stay, \"start\", item, 1 AS small_files FROM iv")
def capped_files(spark, sf):
    """Every interval, from files of at most 1000 rows."""
    path = scratch_path(spark, "capped")
    io.write_table(intervals(spark, sf).select("stay", "start", "item"), path, records_per_file=1000)
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    over = cut_lineage(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1000"), "over")
    return rows.join(over, "file", "left").select("stay", "start", "item", F.col("n").isNull().cast("int").alias("small_files"))


@query("prefixed_files", "SRC7 ST1", f"WITH {MEASUREMENTS} SELECT stay AS icustayid, t AS charttime, CAST(item AS BIGINT) AS itemid, v AS valuenum FROM ev")
def prefixed_files(spark, sf):
    """Measurements written as two extracts whose names start alike, and one whose name does not, read by their prefix."""
    root = scratch_path(spark, "prefixed")
    ev = measurements(spark, sf).select(F.col("stay").alias("icustayid"), F.col("t").alias("charttime"), F.col("item").cast("long").alias("itemid"), F.col("v").alias("valuenum"))
    for k, name in enumerate(("labs_ce", "labs_le")):
        io.write_table(ev.filter(F.col("itemid") % 2 == k), f"{root}/{name}.csv", "csv")
    io.write_table(ev, f"{root}/other.csv", "csv")
    return io.read_prefix(spark, root, "labs_", ev.schema)


@query("cached_flags", "SRC6", "SELECT l_orderkey AS hadm_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY 1")
def cached_flags(spark, sf):
    path = scratch_path(spark, "flags")
    name = f"careflow_flags_{path[-12:]}"
    build = lambda: load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("hadm_id")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    io.cached_table(spark, name, build, path)
    return io.cached_table(spark, name, build, path)


@query("split_layout", "SNK2 DS1", "SELECT o_orderkey AS k, o_custkey AS subject, o_totalprice AS price, CASE WHEN o_custkey % 5 < 3 THEN 'train' ELSE 'test' END AS split FROM orders")
def split_layout(spark, sf):
    path = scratch_path(spark, "split")
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("price"),
                                         F.when(F.col("o_custkey") % 5 < 3, "train").otherwise("test").alias("split"))
    io.write_split(o, path, {"raw": ["k", "price"], "metadata": ["k", "subject"]})
    raw, meta = (spark.read.parquet(f"{path}/{t}") for t in ("raw", "metadata"))
    return raw.join(meta.drop("split"), "k")


@query("saved_model", "SNK3 JN10", f"WITH {COUNTS} SELECT CAST(cnt.state AS INT) AS state, CAST(cnt.action AS INT) AS action, CAST(next_state AS INT) AS next_state, n, round(clin.p, 6) AS p FROM cnt JOIN clin ON clin.state = cnt.state AND clin.action = cnt.action")
def saved_model(spark, sf):
    path = scratch_path(spark, "model")
    c = counts(spark, sf)
    io.save_model(path, {"counts": c, "clinician": mdp.clinician_policy(c)}, {"gamma": 0.99, "n_states": 12})
    tables, _ = io.load_model(spark, path, ["counts", "clinician"])
    return rounded(tables["counts"].join(tables["clinician"], ["state", "action"]), ["p"]).select("state", "action", "next_state", "n", "p")


@query("record_files", "SRC9 SRC11 DS11 PRJ3", f"""WITH {MEASUREMENTS}, r AS (SELECT stay, CAST(floor((t - 1704067200) / 3600) AS BIGINT) AS h, CAST(floor((t - 1704067200) % 3600 / 60) AS BIGINT) AS m, item, v FROM ev)
SELECT CAST(stay AS VARCHAR) AS record, round(h + m / 60.0::DOUBLE, 6) AS hours, 'p' || item AS param, v AS value, CAST(stay % 2 AS DOUBLE) AS label FROM r""")
def record_files(spark, sf):
    root = scratch_path(spark, "records")
    s = F.col("t") - 1704067200
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    time = F.concat_ws(":", F.lpad(h.cast("string"), F.greatest(F.length(h.cast("string")), F.lit(2)), F.lit("0")), F.lpad(m.cast("string"), 2, "0"))
    ev = measurements(spark, sf)
    lines = ev.select(F.col("stay").alias("record"), time.alias("Time"), F.concat(F.lit("p"), F.col("item").cast("string")).alias("Parameter"), F.col("v").alias("Value"))
    io.write_records(lines, f"{root}/files", hot=large_stays(spark, sf))
    out = ev.select("stay").distinct().select("stay", *[F.lit(0).alias(f"o{i}") for i in range(4)], (F.col("stay") % 2).alias("o4"))
    out.write.option("header", True).csv(f"{root}/outcomes")
    records = io.read_records(spark, f"{root}/files", r"record=([^/.]+)[^/]*$")
    return rounded(records.select("record", "hours", "param", "value"), ["hours"]).join(io.read_outcomes(spark, f"{root}/outcomes"), "record", "left")


@query("sensor_log", "SRC10 DS12", f"WITH {MEASUREMENTS} SELECT CAST(e.stay AS VARCHAR) AS record, event_type AS tag, CAST(t AS DOUBLE) AS time, v AS x, v / 2 AS y, v / 4 AS z, CASE WHEN id % 2 = 0 THEN 'lying' ELSE 'sitting' END AS label FROM ev e JOIN events ON event_id = id")
def sensor_log(spark, sf):
    path = scratch_path(spark, "sensor")
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tag")).join(measurements(spark, sf), "id")
    rows = e.select("stay", "tag", F.col("t").cast("double"), F.lit("01.01.2024 00:00:00").alias("d"), "v", F.col("v") / 2, F.col("v") / 4, F.when(F.col("id") % 2 == 0, "lying").otherwise("sitting"))
    rows.toDF("a", "b", "c", "d", "e", "f", "g", "h").write.csv(path)
    return io.read_sensor_log(spark, path).drop("date")


_STATES_SQL = f"""WITH {MEASUREMENTS}, os AS (SELECT stay, min(t) + 10 * 86400 AS o, stay % 70 AS age FROM ev GROUP BY 1), w AS (SELECT stay, o FROM os WHERE age >= 18),
e AS (SELECT ev.*, id % 4 AS src FROM ev JOIN w USING (stay) WHERE t BETWEEN o - 53 * 3600 AND o + 29 * 3600),
ts AS (SELECT DISTINCT stay, t FROM e)
SELECT row_number() OVER (PARTITION BY ts.stay ORDER BY ts.t) - 1 AS bloc, ts.stay AS icustayid, ts.t AS timestep,
  {", ".join(f'max(CASE WHEN src = {k} AND item = {i + 1} THEN v END) AS "{name}"' for k, names in enumerate((C.VITALS, C.LABS)) for i, name in enumerate(names))},
  coalesce(min(CASE WHEN src = 2 THEN CAST(item % 2 AS DOUBLE) END), max(CASE WHEN src = 3 THEN CAST(item % 2 AS DOUBLE) END)) AS mechvent,
  coalesce(min(CASE WHEN src = 2 THEN 0.0::DOUBLE END), max(CASE WHEN src = 3 THEN CAST(item % 2 = 0 AS INT)::DOUBLE END)) AS extubated
FROM ts JOIN e ON e.stay = ts.stay AND e.t = ts.t GROUP BY ts.stay, ts.t"""


@query("patient_states", "BLD3 BLD4 AG6 AG8 FLT4 FLT5 PRJ4", _STATES_SQL)
def patient_states(spark, sf):
    ev = measurements(spark, sf)
    base = ev.select(F.col("stay").alias("icustayid"), F.col("t").alias("charttime"), F.col("item").cast("long").alias("itemid"), F.col("item").alias("source_item"), F.col("v").alias("valuenum"), (F.col("id") % 4).alias("src"))
    chart, labs = base.filter("src = 0"), base.filter("src = 1")
    vent = base.filter("src = 2").select("icustayid", "charttime", (F.col("itemid") % 2).alias("mechvent"), F.lit(0).alias("extubated"))
    done = base.filter("src = 3").select("icustayid", F.col("charttime").alias("starttime"), (F.col("itemid") % 2).alias("mechvent"), (F.col("itemid") % 2 == 0).cast("int").alias("extubated"))
    onsets = ev.groupBy(F.col("stay").alias("icustayid")).agg((F.min("t") + 10 * 86400).alias("onset_time"))
    demog = onsets.select("icustayid", (F.col("icustayid") % 70).alias("age"), F.lit(0).cast("long").alias("dischtime"))
    out, _ = states.patient_states(chart, labs, vent, onsets, demog, done)
    return out.select("bloc", "icustayid", "timestep", *C.VITALS, *C.LABS, "mechvent", "extubated")


def _hold_sql(c: str, hours: int) -> str:
    at = f'last_value(CASE WHEN "{c}" IS NOT NULL THEN timestep END IGNORE NULLS) OVER w'
    return f'coalesce("{c}", CASE WHEN timestep - {at} <= {hours * 3600} THEN last_value("{c}" IGNORE NULLS) OVER w END) AS "{c}"'


_WIDE_HELD = f"""SELECT icustayid, timestep, {", ".join(_hold_sql(c, h) for c, h in C.HOLD_HOURS.items())} FROM ({_STATES_SQL})
WINDOW w AS (PARTITION BY icustayid ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _held_states(spark, sf):
    return impute.hold(patient_states(spark, sf).drop("bloc"), "icustayid", "timestep", C.HOLD_HOURS)


@query("held_patient_states", "IMP6 BLD3", _WIDE_HELD)
def held_patient_states(spark, sf):
    """All 65 columns, held for their hours."""
    return _held_states(spark, sf)


def _hold_log_sql(c: str, hours: int) -> str:
    at = f'last_value(CASE WHEN "{c}" IS NOT NULL THEN timestep END IGNORE NULLS) OVER w'
    return f'CASE WHEN "{c}" IS NULL AND timestep - {at} <= {hours * 3600} THEN {at} END AS "{c}"'


@query("hold_log", "LN1 IMP6", f"""WITH h AS (SELECT icustayid, timestep, {", ".join(_hold_log_sql(c, h) for c, h in C.HOLD_HOURS.items())} FROM ({_STATES_SQL})
WINDOW w AS (PARTITION BY icustayid ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (UNPIVOT h ON {", ".join(f'"{c}"' for c in C.HOLD_HOURS)} INTO NAME value_col VALUE made)
SELECT icustayid || ':' || timestep AS value_row, value_col, 'sample and hold' AS change_type, NULL::VARCHAR AS metadata, icustayid || ':' || made AS reference_row, value_col AS reference_col FROM u""")
def hold_log(spark, sf):
    """A record for every cell of the 65 columns that was held, with the row it was measured in."""
    row = F.concat_ws(":", "icustayid", "timestep")
    kept = impute.hold(patient_states(spark, sf).drop("bloc"), "icustayid", "timestep", C.HOLD_HOURS, source="__from", origin=row)
    return lineage.cell_log(kept, row, {c: F.when(F.col(f"{c}__from").isNotNull(), F.array(f"{c}__from")) for c in C.HOLD_HOURS}, "sample and hold")


@query("binned_patient_states", "AG3 BLD5", f"""WITH hd AS ({_WIDE_HELD}), beg AS (SELECT icustayid, min(timestep) AS b FROM hd GROUP BY 1)
SELECT icustayid, CAST(j.i AS BIGINT) AS bin, {", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in C.STATE_COLUMNS)} FROM hd JOIN beg USING (icustayid), range(0, 20) j(i)
WHERE timestep >= b + j.i * 14400 AND timestep <= b + (j.i + 1) * 14400 GROUP BY 1, 2""")
def binned_patient_states(spark, sf):
    """Means of all 65 held columns in 20 bins of 4 hours."""
    held = _held_states(spark, sf)
    starts = bins.bin_starts(held, "icustayid", "timestep")
    e = bins.explode_points(held, starts, "icustayid", "timestep", 4 * 3600, 20)
    return rounded(e.groupBy("icustayid", "bin").agg(*[F.avg(c).alias(c) for c in C.STATE_COLUMNS]), C.STATE_COLUMNS)


@query("culture_table", "BLD1 FLT1 FLT2 ST1 JN6", f"""WITH {STAYS}, mb AS (SELECT l_suppkey * 10 + l_linenumber AS subject_id, l_orderkey AS hadm_id, CASE WHEN l_linenumber = 1 THEN l_partkey END AS icustayid, CAST(epoch(l_shipdate) AS BIGINT) AS charttime FROM lineitem WHERE l_linenumber <= 3),
s AS (SELECT subject AS subject_id, admission // 3 * 3 AS hadm_id, admission AS icustayid, intime, outtime FROM st),
c AS (SELECT m.subject_id, charttime, min(s.icustayid) AS f FROM (SELECT DISTINCT subject_id, charttime FROM mb) m JOIN s USING (subject_id) WHERE intime <= charttime + 172800 AND outtime >= charttime - 172800 GROUP BY 1, 2),
o AS (SELECT hadm_id, min(icustayid) AS f FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT mb.subject_id, mb.hadm_id, coalesce(mb.icustayid, c.f, o.f) AS icustayid, mb.charttime FROM mb LEFT JOIN c ON c.subject_id = mb.subject_id AND c.charttime = mb.charttime LEFT JOIN o ON o.hadm_id = mb.hadm_id
WHERE coalesce(mb.icustayid, c.f, o.f) IS NOT NULL""")
def culture_table(spark, sf):
    from careflow.functions.scalar import epoch

    n = F.col("l_linenumber")
    li = load(spark, sf, "lineitem").select((F.col("l_suppkey") * 10 + n).alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), F.when(n == 1, F.col("l_partkey")).alias("icustayid"),
                                            epoch(F.col("l_shipdate")).alias("at"), n.alias("n"))
    micro = li.filter("n <= 2").withColumns({"charttime": F.when(F.col("n") == 1, F.col("at")), "chartdate": F.col("at")})
    charted = li.filter("n = 3").withColumn("charttime", F.col("at"))
    s = stays(spark, sf).select(F.col("subject").alias("subject_id"), (F.floor(F.col("admission") / 3) * 3).alias("hadm_id"), F.col("admission").alias("icustayid"), "intime", "outtime")
    return states.culture_table(micro, charted, s)

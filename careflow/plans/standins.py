"""The given tables seen as hospital tables, for Spark and as SQL common table expressions.

events: measurements of a stay. orders: stays and admissions. lineitem: intervals with
doses. customer: patients. part: codes. labels: outcomes. conversations: trajectories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions.scalar import cases, epoch
from careflow.operators.scan import find_hot, row_number, scan
from careflow.session import hot_rows, load

ITEMS = ["click", "error", "purchase", "signup", "view"]
DAY = 86400


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """(id, stay, t, item 1..5, v), ids in time order."""
    item = cases([(F.col("event_type") == name, i) for i, name in enumerate(ITEMS, 1)])
    return load(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("stay"), epoch(F.col("ts")).alias("t"),
        item.alias("item"), F.col("value").alias("v"),
    )


MEASUREMENTS = """ev AS (
  SELECT event_id AS id, user_id AS stay, CAST(floor(epoch(ts)) AS BIGINT) AS t,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4
                         WHEN 'view' THEN 5 END AS item,
         value AS v
  FROM events)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements where every third value is missing."""
    return measurements(spark, sf).withColumn("v", F.when(F.col("id") % 3 != 0, F.col("v")))


GAPPY = MEASUREMENTS + """, gap AS (SELECT id, stay, t, item, CASE WHEN id % 3 <> 0 THEN v END AS v FROM ev)"""


def wide_states(spark: SparkSession, sf: str, names=tuple("c%d" % i for i in range(1, 6)), events: DataFrame | None = None) -> DataFrame:
    """One row per stay and time, one column per item."""
    from careflow.operators.states import widen

    return widen(measurements(spark, sf) if events is None else events, ["stay", "t"], "item", "v", "id", dict(enumerate(names, 1)))


WIDE = MEASUREMENTS + """, wide AS (
  SELECT stay, t,
         arg_max(v, id) FILTER (WHERE item = 1) AS c1, arg_max(v, id) FILTER (WHERE item = 2) AS c2,
         arg_max(v, id) FILTER (WHERE item = 3) AS c3, arg_max(v, id) FILTER (WHERE item = 4) AS c4,
         arg_max(v, id) FILTER (WHERE item = 5) AS c5
  FROM ev GROUP BY stay, t)"""


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """(subject, admission, intime, outtime) from orders; a stay lasts five days."""
    t = epoch(F.col("o_orderdate"))
    return load(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("admission"), t.alias("intime"),
        (t + 5 * DAY).alias("outtime"),
    )


STAYS = """st AS (
  SELECT o_custkey AS subject, o_orderkey AS admission, CAST(epoch(o_orderdate) AS BIGINT) AS intime,
         CAST(epoch(o_orderdate) AS BIGINT) + 432000 AS outtime FROM orders)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """(stay, item, start, end, rate, amount) from lineitem; no rate marks a bolus."""
    t = epoch(F.col("l_shipdate"))
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("stay"), F.col("l_partkey").alias("item"), t.alias("start"),
        (t + F.col("l_linenumber") * DAY).alias("end"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("rate"),
        F.col("l_extendedprice").alias("amount"),
    )


INTERVALS = """iv AS (
  SELECT l_suppkey AS stay, l_partkey AS item, CAST(epoch(l_shipdate) AS BIGINT) AS "start",
         CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 86400 AS "end",
         CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS rate, l_extendedprice AS amount
  FROM lineitem)"""


def large_stays(spark: SparkSession, sf: str, lead: str = "id") -> int:
    """Stays too large for one task, measured on the key columns alone."""
    return find_hot(measurements(spark, sf).select("stay", lead), ["stay"], lead, hot_rows(spark))


def trajectories(spark: SparkSession, sf: str, hot: int | None = None, events: DataFrame | None = None) -> DataFrame:
    """Visited states per stay: (stay, bloc from 1, state 0..9, action 0..4, outcome 0/1, v)."""
    ev = measurements(spark, sf) if events is None else events
    numbered = scan(ev, ["stay"], ["id"], {"bloc": row_number()}, hot=hot)
    return numbered.select(
        "stay", "bloc", F.floor(F.col("v") / 50).cast("int").alias("state"),
        (F.col("item") - 1).cast("int").alias("action"), (F.col("stay") % 2).cast("int").alias("outcome"), "v",
    )


TRAJECTORIES = MEASUREMENTS + """, tr AS (
  SELECT stay, row_number() OVER (PARTITION BY stay ORDER BY id) AS bloc, CAST(floor(v / 50) AS INT) AS state,
         CAST(item - 1 AS INT) AS action, CAST(stay % 2 AS INT) AS outcome, v FROM ev)"""

# Rows with the next action; the last row of a stay is its absorbing state (10 died, 11 survived).
RECORDS = TRAJECTORIES + """, rec AS (
  SELECT bloc, stay AS icustayid,
         CASE WHEN nxt IS NOT NULL THEN state WHEN outcome = 1 THEN 10 ELSE 11 END AS state,
         coalesce(nxt, -1) AS action, outcome,
         CASE WHEN nxt IS NOT NULL THEN 0.0 WHEN outcome = 1 THEN -100.0 ELSE 100.0 END AS reward
  FROM (SELECT *, lead(action) OVER (PARTITION BY stay ORDER BY bloc) AS nxt FROM tr))"""

COUNTS = RECORDS + """, steps AS (
  SELECT DISTINCT icustayid, state, action, nxt FROM
    (SELECT *, lead(state) OVER (PARTITION BY icustayid ORDER BY bloc) AS nxt FROM rec) WHERE nxt IS NOT NULL),
cnt0 AS (SELECT state, action, nxt AS next_state, count(*) AS n FROM steps GROUP BY 1, 2, 3),
cnt AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY state, action) AS pair FROM cnt0) WHERE pair > 5),
mod AS (SELECT state, action, next_state, n / pair AS p FROM cnt),
rew AS (SELECT state, action, sum(p * CASE next_state WHEN 11 THEN 100.0 WHEN 10 THEN -100.0 ELSE 0.0 END) AS r
        FROM mod GROUP BY 1, 2),
clin AS (SELECT state, action, n / sum(n) OVER (PARTITION BY state) AS p
         FROM (SELECT state, action, sum(n) AS n FROM cnt GROUP BY 1, 2)),
grid AS (SELECT CAST(s.i AS INT) AS state, CAST(a.i AS INT) AS action
         FROM range(0, 12) s(i), range(0, 5) a(i))"""


def unit_hash(*parts: str) -> str:
    """SQL text of the [0, 1) hash that `functions.scalar.hash_unit` computes."""
    joined = ", ".join(parts)
    return f"(CAST('0x' || substr(md5(concat_ws('|', {joined})), 1, 8) AS BIGINT) / 4294967296.0)"

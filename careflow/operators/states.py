"""From irregular long events to one wide row per stay and time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow import constants as C
from careflow.operators.joins import around, impute_stay_ids, nearest_event
from careflow.operators.scan import row_number, scan
from careflow.session import hot_rows

HOUR = 3600


def item_groups(spark, groups: Sequence[Sequence[int]]) -> DataFrame:
    """Code table: item id to its 1-based group."""
    rows = [(int(i), g) for g, ids in enumerate(groups, 1) for i in ids]
    return spark.createDataFrame(rows, "itemid long, grp int")


def recode_items(events: DataFrame, groups: DataFrame, item: str = "itemid", small: bool = False) -> DataFrame:
    """Replace item ids by group numbers; ids without a group stay as they are. Keeps `source_item`.

    The join is left to the optimiser; `small` says that the code table is one of fixed
    size, as those of `item_groups` are, and may be broadcast.
    """
    g = groups.select(F.col("itemid").alias(item), "grp")
    out = events.join(F.broadcast(g) if small else g, item, "left")
    return out.withColumns({"source_item": F.col(item), item: F.coalesce(F.col("grp"), F.col(item))}).drop("grp")


def widen(
    events: DataFrame, keys: Sequence[str], item: str, value: str, order: str, columns: Mapping[object, str],
) -> DataFrame:
    """One row per key, one column per item; of several events of an item the one last in `order` counts.

    The columns are fixed by `columns`, nothing is discovered from the data, and the
    whole pivot is one hash aggregate with partial aggregation.
    """
    picks = [
        F.max_by(F.when(F.col(item) == k, F.col(value)), F.when(F.col(item) == k, F.col(order))).alias(c)
        for k, c in columns.items()
    ]
    return events.groupBy(*keys).agg(*picks)


def last_per_time(events: DataFrame, keys: Sequence[str], item: str, value: str, source: str) -> DataFrame:
    """One event per key and item: the highest source item, then the highest value."""
    best = F.max(F.struct(F.col(source).alias("s"), F.col(value).alias("v")))
    return events.groupBy(*keys, item).agg(best["v"].alias(value))


def culture_table(microbiology: DataFrame, cultures: DataFrame, stays: DataFrame, **names) -> DataFrame:
    """Cultures from both sources with a time and a stay; rows that stay unresolved are dropped."""
    cols = ["subject_id", "hadm_id", "icustayid", "charttime"]
    timed = microbiology.withColumn("charttime", F.coalesce("charttime", "chartdate"))
    both = timed.select(cols).unionByName(cultures.select(cols))
    return impute_stay_ids(both, stays, **names).filter(F.col("icustayid").isNotNull())


def onset(
    treatments: DataFrame, cultures: DataFrame, stay: str = "icustayid", treat_time: str = "startdate",
    culture_time: str = "charttime", subject: str = "subject_id", culture_after_hours: int = 24,
    culture_before_hours: int = 72, hot_rows: int | None = None,
) -> DataFrame:
    """Presumed onset per stay from the first treatment whose nearest culture is close enough.

    A culture up to 24 h later puts the onset at the treatment, one up to 72 h
    earlier puts it at the culture; at equal times the first rule holds.
    """
    near = nearest_event(
        treatments.filter(F.col(treat_time).isNotNull()).select(stay, treat_time).distinct(),
        cultures, stay, treat_time, culture_time, [subject], hot_rows,
    )
    t, c = F.col(treat_time), F.col("near_time")
    when = F.when((c >= t) & (c - t <= culture_after_hours * HOUR), t).when(
        (c <= t) & (t - c <= culture_before_hours * HOUR), c
    )
    first = F.min_by(F.struct(F.col(subject), F.col("onset_time")), F.col(treat_time))
    return (
        near.withColumn("onset_time", when).filter(F.col("onset_time").isNotNull())
        .groupBy(stay).agg(first.alias("f")).select(F.col(f"f.{subject}"), stay, F.col("f.onset_time"))
    )


def patient_states(
    chart: DataFrame, labs: DataFrame, vent: DataFrame, onsets: DataFrame, stays: DataFrame,
    vent_procedures: DataFrame | None = None, hours_before: int = 49, hours_after: int = 25, margin_hours: int = 4,
    min_age: int = 18, members: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Wide state rows around onset, and the time bounds of each stay.

    `chart` and `labs` are recoded events. A row exists at every distinct event time
    of a stay inside the closed window. Charted ventilation goes before procedures.
    """
    w = stays.filter(F.col("age") >= min_age).select("icustayid", "dischtime")
    w = onsets.select("icustayid", "onset_time").join(w, "icustayid")
    if members is not None:
        w = w.join(members.select("icustayid"), "icustayid", "left_semi")
    before, after = (hours_before + margin_hours) * HOUR, (hours_after + margin_hours) * HOUR
    n = len(C.VITALS)

    def near(rows: DataFrame, time: str = "charttime") -> DataFrame:
        return around(rows, w, "icustayid", time, "onset_time", before, after)

    keys = ["icustayid", "timestep"]
    long_ = (
        near(chart).select("icustayid", F.col("charttime").alias("timestep"),
                           F.when(F.col("itemid").between(1, n), F.col("itemid")).otherwise(0).alias("item"),
                           "source_item", "valuenum")
        .unionByName(
            near(labs).select("icustayid", F.col("charttime").alias("timestep"),
                              F.when(F.col("itemid").between(1, len(C.LABS)), F.col("itemid") + n).otherwise(0).alias("item"),
                              "source_item", "valuenum"))
    )
    cells = last_per_time(long_, keys, "item", "valuenum", "source_item")
    charted = near(vent).groupBy("icustayid", F.col("charttime").alias("timestep")).agg(
        F.min(F.struct("mechvent", "extubated")).alias("v")
    )
    marks = charted.select(*keys, F.lit(-1).alias("item"), F.col("v.mechvent").cast("double").alias("m"),
                           F.col("v.extubated").cast("double").alias("x"))
    if vent_procedures is not None:
        flag = {c: F.max((F.col(c) > 0).cast("double")).alias(a) for c, a in (("mechvent", "m"), ("extubated", "x"))}
        performed = near(vent_procedures, "starttime").groupBy("icustayid", F.col("starttime").alias("timestep")).agg(*flag.values())
        marks = marks.unionByName(performed.select(*keys, F.lit(-2).alias("item"), "m", "x"))
    both = cells.unionByName(marks, allowMissingColumns=True)
    wide = both.groupBy(*keys).agg(
        *[F.max(F.when(F.col("item") == i, F.col("valuenum"))).alias(c) for i, c in enumerate(C.VITALS + C.LABS, 1)],
        *[F.coalesce(F.max(F.when(F.col("item") == -1, F.col(a))), F.max(F.when(F.col("item") == -2, F.col(a)))).alias(c)
          for c, a in (("mechvent", "m"), ("extubated", "x"))],
    )
    # One row per second of the window at most, so a stay is only measured if that could be large.
    hot = [] if before + after + 1 <= hot_rows(wide.sparkSession) else None
    numbered = scan(wide, ["icustayid"], ["timestep"], {"bloc": row_number()}, hot=hot)
    states = numbered.select((F.col("bloc") - 1).alias("bloc"), *keys, *C.STATE_COLUMNS)
    bounds = wide.groupBy("icustayid").agg(
        F.min("timestep").alias("first_timestep"), F.max("timestep").alias("last_timestep"),
    ).join(w, "icustayid").select("icustayid", "onset_time", "first_timestep", "last_timestep", "dischtime")
    return states, bounds


def state_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.LongType()) for c in ("bloc", "icustayid", "timestep")]
        + [T.StructField(c, T.DoubleType()) for c in C.STATE_COLUMNS]
    )

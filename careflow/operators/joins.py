"""Joins on time: nearest event, covering interval, stay lookup, code dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.operators.scan import known_after, last_known, scan

FANOUT = 8


def nearest_event(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, payload: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Attach to each left row the right event of its key closest in time, before or after.

    Ties go to the earlier event. Both tables are scanned once in time order, so the
    work is linear in the rows of a key, not in their product. Left rows of a key
    without events get nulls in `near_time` and the payload columns.
    """
    found = F.struct(F.col("__t").alias("t"), F.col("__p").alias("p"))
    once = right.groupBy(key, F.col(right_time).alias("__t")).agg(
        F.min(F.struct(F.lit(0).alias("one"), *[F.col(c) for c in payload])).alias("__p")
    ).withColumn("__left", F.lit(0))
    rows = left.withColumns({"__t": F.col(left_time), "__left": F.lit(1)})
    both = rows.unionByName(once, allowMissingColumns=True)
    event = F.when(F.col("__left") == 0, found)
    seen = scan(both, [key], ["__t", "__left"], {"__a": last_known(event), "__b": known_after(event)}, hot_rows)
    a, b = F.col("__a"), F.col("__b")
    take_before = b.isNull() | (a.isNotNull() & (F.col("__t") - a["t"] <= b["t"] - F.col("__t")))
    near = F.when(take_before, a).otherwise(b)
    return seen.filter(F.col("__left") == 1).select(
        *left.columns, near["t"].alias("near_time"), *[near["p"][c].alias(c) for c in payload],
    )


def _at_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def _pieces(start: Column, end: Column, levels: int) -> Column:
    """Aligned blocks of sizes 1, 8, 64, ... that together are exactly [start, end]."""
    parts = []
    for level in range(levels):
        size = FANOUT ** level
        low, high = F.ceil(start / size), F.floor((end + 1) / size) - 1
        if level + 1 < levels:
            up = size * FANOUT
            wide_low, wide_high = F.ceil(start / up) * FANOUT, (F.floor((end + 1) / up)) * FANOUT
            covered = wide_high > wide_low
            left = F.when(covered, F.least(high, wide_low - 1)).otherwise(high)
            right = F.when(covered, F.greatest(low, wide_high)).otherwise(high + 1)
        else:
            left, right = high, high + 1
        empty = F.array().cast("array<bigint>")
        blocks = F.concat(
            F.when(left >= low, F.sequence(low, left)).otherwise(empty),
            F.when(high >= right, F.sequence(right, high)).otherwise(empty),
        )
        parts.append(_at_level(blocks, level))
    return F.flatten(F.array(*parts))


def first_covering(
    points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, rank: str, payload: str,
    name: str, few: int = 64,
) -> DataFrame:
    """Attach to each point the payload of the lowest-ranked interval of its key that covers it, else null.

    Keys with at most `few` intervals are joined directly. The intervals of larger keys
    are cut into aligned blocks and only the best rank per block is kept, so a point
    meets one row per block size and never every interval of its key.
    """
    best = F.struct(F.col(rank).alias("r"), F.col(payload).alias("p")).alias("__best")
    spans = intervals.filter((F.col(end) >= F.col(start)) & F.col(key).isNotNull()).select(
        key, F.col(start).alias("__from"), F.col(end).alias("__to"), best,
    )
    asked = points.filter(F.col(key).isNotNull()).select(key, time).distinct()
    sizes = spans.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("__to") - F.col("__from")).alias("__longest"))
    large = sizes.filter(F.col("__n") > few)
    longest = large.agg(F.max("__longest")).first()[0]
    small = spans if longest is None else spans.join(large.select(key), key, "left_anti")
    inside = (F.col("__from") <= F.col(time)) & (F.col(time) <= F.col("__to"))
    found = asked.join(small, key).filter(inside).select(key, time, "__best")
    if longest is not None:
        found = found.unionByName(_covering_by_blocks(
            asked.join(large.select(key), key, "left_semi"), spans.join(large.select(key), key, "left_semi"), key, time, longest,
        ))
    found = found.groupBy(key, time).agg(F.min("__best")["p"].alias(name))
    return points.join(found, [key, time], "left")


def _covering_by_blocks(asked: DataFrame, spans: DataFrame, key: str, time: str, longest: int) -> DataFrame:
    levels = 1
    while FANOUT ** levels <= longest + 1:
        levels += 1
    blocks = (
        spans.select(key, "__best", F.explode(_pieces(F.col("__from"), F.col("__to"), levels)).alias("b"))
        .groupBy(key, F.col("b.level").alias("level"), F.col("b.block").alias("block"))
        .agg(F.min("__best").alias("__best"))
    )
    probes = F.explode(F.array(*[
        F.struct(F.lit(lv).alias("level"), F.floor(F.col(time) / FANOUT ** lv).alias("block")) for lv in range(levels)
    ]))
    return (
        asked.select(key, time, probes.alias("b")).select(key, time, "b.level", "b.block")
        .join(blocks, [key, "level", "block"]).select(key, time, "__best")
    )


def impute_stay_ids(
    events: DataFrame, stays: DataFrame, subject: str | None = "subject_id", admission: str = "hadm_id",
    stay: str = "icustayid", time: str = "charttime", intime: str = "intime", outtime: str = "outtime",
    rank: str | None = None, window: int = 48 * 3600,
) -> DataFrame:
    """Fill a missing stay: the first stay of the subject around the event, else the admission's only stay.

    Without a subject column only the admission rule applies. `rank` orders the
    stays of a subject; the stay id by default.
    """
    known = events.filter(F.col(stay).isNotNull())
    open_ = events.filter(F.col(stay).isNull())
    if subject:
        around = stays.select(
            subject, F.col(stay).alias("__stay"), F.col(rank or stay).alias("__rank"),
            (F.col(intime) - window).alias("__from"), (F.col(outtime) + window).alias("__to"),
        )
        open_ = first_covering(open_, around, subject, time, "__from", "__to", "__rank", "__stay", "__found")
    else:
        open_ = open_.withColumn("__found", F.lit(None).cast(stays.schema[stay].dataType))
    only = stays.groupBy(admission).agg(F.count(F.lit(1)).alias("__n"), F.min(stay).alias("__only"))
    only = only.filter(F.col("__n") == 1).select(admission, "__only")
    filled = open_.join(only, admission, "left").withColumn(stay, F.coalesce(F.col("__found"), F.col("__only")))
    return known.select(events.columns).unionByName(filled.select(events.columns))


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join to a code dimension with one row per code."""
    return rows.join(table.select(*on, *columns), list(on), "left")


def keep_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return rows.join(members.select(key), key, "left_semi")


def drop_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return rows.join(members.select(key), key, "left_anti")


def around(rows: DataFrame, centres: DataFrame, key: str, time: str, centre: str, before: int, after: int) -> DataFrame:
    """Rows within a closed window around their key's centre time."""
    j = rows.join(centres, key)
    return j.filter(F.col(time).between(F.col(centre) - before, F.col(centre) + after))

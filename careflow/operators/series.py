"""Irregular record series: quantised wide series, windows of fixed length, alignment, cubic splines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions.scalar import cases, quantise
from careflow.operators.scan import (
    find_hot, join_null_safe, known_before, last_known, next_known, row_number, row_number_from_end, scan,
)

from careflow.session import hot_rows as default_hot_rows


def quantised_series(
    readings: DataFrame, record: str, hours: str, param: str, value: str, params: Sequence[str], step: float = 0.1,
    from_zero: bool = True,
) -> DataFrame:
    """Wide series on quantised times: mean of repeated readings, 0 and mask 0 where nothing was read.

    With `from_zero` every record starts with a step at time 0.
    """
    rows = readings.select(
        record, quantise(F.col(hours), step).alias("tq"), F.col(param).alias("__p"), F.col(value).alias("__v"),
    )
    if from_zero:
        rows = rows.unionByName(
            readings.select(record).distinct().select(record, F.lit(0.0).alias("tq")), allowMissingColumns=True,
        )
    aggs = []
    for p in params:
        read = F.when(F.col("__p") == p, F.col("__v"))
        aggs += [F.coalesce(F.avg(read), F.lit(0.0)).alias(p), (F.count(read) > 0).cast("int").alias(f"{p}_mask")]
    return rows.groupBy(record, "tq").agg(*aggs)


def sensor_series(
    rows: DataFrame, record: str, tag: str, time: str, axes: Sequence[str], label: str, tags: Sequence[str],
    label_codes: Mapping[str, int], order: str, tick: float = 1e5,
) -> DataFrame:
    """Wide series of several sensors: mean per tag and axis, one observation mask per tag, first known label per step."""
    starts = rows.groupBy(record).agg(F.min(time).alias("__t0"))
    code = cases([(F.col(label) == k, v) for k, v in label_codes.items()])
    known = F.col(tag).isin(list(tags))
    timed = rows.join(starts, record).withColumns({
        "tq": F.bround((F.col(time) - F.col("__t0")) / tick, 0).cast("long"), "__label": F.when(known, code),
    })
    aggs = []
    for i, t in enumerate(tags):
        here = F.col(tag) == t
        aggs += [F.coalesce(F.avg(F.when(here, F.col(a))), F.lit(0.0)).alias(f"tag{i}_{a}") for a in axes]
        aggs.append(F.max(here.cast("int")).alias(f"tag{i}_mask"))
    first = F.min_by("__label", F.when(F.col("__label").isNotNull(), F.col(order))).alias("label")
    return timed.groupBy(record, "tq").agg(*aggs, first)


def subsequences(
    df: DataFrame, record: str, order: Sequence[str], time: str, length: int = 50, stride: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Overlapping windows of exactly `length` rows every `stride` rows, times counted from the window's first row.

    A window is kept only if rows remain after it, so the tail of a record is dropped.
    """
    stride = stride or length // 2
    n = scan(df, [record], order, {"__i": row_number(), "__j": row_number_from_end()}, hot_rows)
    i, size = F.col("__i") - 1, F.col("__i") + F.col("__j") - 1
    first = F.greatest(F.ceil((i - (length - 1)) / stride), F.lit(0).cast("long"))
    last = F.least(F.floor(i / stride), F.ceil((size - length) / stride) - 1)
    windows = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    out = n.withColumn("window", F.explode(windows)).withColumn("pos", F.col("__i") - 1 - F.col("window") * stride)
    one = Window.partitionBy(record, "window")
    return out.withColumn("rel_time", F.col(time) - F.min(F.when(F.col("pos") == 0, F.col(time))).over(one)).drop("__i", "__j")


def observed_range(df: DataFrame, columns: Sequence[str], mask: str = "_mask") -> dict[str, tuple[float, float]]:
    """Lowest and highest observed value per feature; unobserved cells are skipped."""
    aggs = []
    for c in columns:
        seen = F.when(F.col(f"{c}{mask}") == 1, F.col(c))
        aggs += [F.min(seen).alias(f"{c}__lo"), F.max(seen).alias(f"{c}__hi")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__lo"], row[f"{c}__hi"]) for c in columns}


def align(df: DataFrame, batch: str, record: str, time: str, columns: Sequence[str], mask: str = "_mask") -> DataFrame:
    """Place every series of a batch on the union of the batch's times.

    Observed cells are min-max normalised over the table and times scaled to [0, 1] by
    the batch maximum. Only rows with data are stored, with their index on the common
    axis and its size; every cell not stored is 0 with mask 0.
    """
    axis = df.select(batch, time).distinct()
    axis = scan(axis, [batch], [time], {"__i": row_number()})
    size = axis.groupBy(batch).agg(F.max("__i").alias("axis_size"), F.max(time).alias("__max"))
    ranges = observed_range(df, columns, mask)
    cells = {}
    for c, (low, high) in ranges.items():
        span = (high - low) if low is not None and high != low else 1.0
        value = (F.col(c) - F.lit(low).cast("double")) / F.lit(float(span))
        cells[c] = F.when(F.col(f"{c}{mask}") == 1, value).otherwise(0.0)
    out = df.join(axis, [batch, time]).join(size, batch)
    scaled = F.when(F.col("__max") == 0, F.col(time)).otherwise(F.col(time) / F.col("__max"))
    return out.withColumns(cells).select(
        batch, record, (F.col("__i") - 1).alias("axis_index"), "axis_size", scaled.alias("time_scaled"),
        *columns, *[f"{c}{mask}" for c in columns],
    )


def knot_bends(gap: np.ndarray, rise: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of natural cubic splines, for many series laid end to end.

    `gap` and `rise` are the distance and the difference to the next knot, `inner` tells whether a knot has neighbours of
    its series on both sides; all others have no bend. At an inner knot the slopes of both sides must agree, which gives

        gap[i-1] * bend[i-1] + 2 * (gap[i-1] + gap[i]) * bend[i] + gap[i] * bend[i+1] = 6 * (rise[i] / gap[i] - rise[i-1] / gap[i-1])

    and is solved by elimination forward and substitution back.
    """
    n = len(inner)
    bend = np.zeros(n)
    at = np.flatnonzero(inner)
    if not len(at):
        return bend
    left, right = gap[at - 1], gap[at]
    want = 6 * (rise[at] / right - rise[at - 1] / left)
    weight, first = 2 * (left + right), np.r_[True, np.diff(at) > 1]
    pivot, held = np.empty(len(at)), np.empty(len(at))
    for i, (lo, w, r, new) in enumerate(zip(left.tolist(), weight.tolist(), want.tolist(), first.tolist())):
        share = 0.0 if new else lo / pivot[i - 1]
        pivot[i] = w - (0.0 if new else share * lo)
        held[i] = r - (0.0 if new else share * held[i - 1])
    solved = np.empty(len(at))
    after = 0.0
    for i in range(len(at) - 1, -1, -1):
        solved[i] = after = (held[i] - right[i] * after) / pivot[i]
        if first[i]:
            after = 0.0
    bend[at] = solved
    return bend


SPAN = ("start", "stop", "left", "right", "left_bend", "right_bend")


def spline_coefficients(
    df: DataFrame, keys: Sequence[str], time: str, value: str, piece: int = 4096, halo: int = 80,
    groups: int | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Natural cubic spline of every series: for each time but the last the span between two knots that holds it.

    A span has its ends (`start`, `stop`), the values there (`left`, `right`) and the second derivatives (`left_bend`,
    `right_bend`). Missing values at the ends take the first or last known value; a series without any value gets zeros.
    Series are cut into pieces of `piece` knots that overlap by `halo`: what lies `halo` knots away changes a bend by
    less than 2^-halo, so the pieces give the same spans as the whole series and no task holds one. Many pieces
    share one of `groups` groups (four for each shuffle partition) and are solved together.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    groups = groups or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = find_hot(df, keys, time, hot_rows or default_hot_rows(df.sparkSession))
    rows = scan(df, keys, [time], {
        "__i": row_number(), "__j": row_number_from_end(), "__next": next_known(v), "__last": last_known(v),
    }, hot_rows, hot)
    end = F.when(F.col("__i") == 1, F.col("__next")).when(F.col("__j") == 1, F.col("__last"))
    rows = rows.select(*keys, F.col(time).cast("double").alias("t"), F.coalesce(v, end).alias("x"), "__j")
    knots = scan(rows.filter(F.col("x").isNotNull()), keys, ["t"], {"__k": row_number()}, hot_rows, hot)
    k = F.col("__k") - 1
    own = F.floor(k / piece)
    near = F.filter(F.sequence(own - 1, own + 1), lambda p: (p >= 0) & (k >= p * piece - halo) & (k <= (p + 1) * piece + halo))
    spread = knots.select(*keys, "t", "x", k.alias("k"), F.explode(near).alias("p"))
    spread = spread.withColumn("g", F.pmod(F.xxhash64(*keys, "p"), F.lit(groups)))
    out_schema = T.StructType([df.schema[c] for c in keys] + [T.StructField(c, T.DoubleType()) for c in SPAN])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "p", "k"])
        t, x, number, part = (pdf[c].to_numpy() for c in ("t", "x", "k", "p"))
        go_on = part[1:] == part[:-1]
        for c in keys:
            series = pdf[c]
            go_on &= ((series.to_numpy()[1:] == series.to_numpy()[:-1]) | (series.isna().to_numpy()[1:] & series.isna().to_numpy()[:-1]))
        gap, rise = np.where(go_on, np.diff(t), 1.0), np.where(go_on, np.diff(x), 0.0)
        bend = knot_bends(gap, rise, np.r_[False, go_on] & np.r_[go_on, False])
        res = pdf.iloc[:-1][keys].copy()
        for name, column in zip(SPAN, (t[:-1], t[1:], x[:-1], x[1:], bend[:-1], bend[1:])):
            res[name] = column
        return res[go_on & (number[:-1] >= part[:-1] * piece) & (number[:-1] < (part[:-1] + 1) * piece)]

    solved = spread.groupBy("g").applyInPandas(solve, out_schema).withColumnRenamed("start", "t")
    placed = join_null_safe(rows.select(*keys, "t", "__j"), solved, [*keys, "t"], "left")
    span = F.struct(F.col("t").alias("start"), *SPAN[1:])
    held = scan(placed, keys, ["t"], {"__c": last_known(F.when(F.col("stop").isNotNull(), span))}, hot_rows, hot)
    zero = F.lit(0.0)
    empty = F.struct(F.col("t").alias("start"), (F.col("t") + 1).alias("stop"), *[zero.alias(c) for c in SPAN[2:]])
    return held.filter(F.col("__j") > 1).withColumn("__c", F.coalesce("__c", empty)).select(*keys, "t", *[F.col("__c")[c].alias(c) for c in SPAN])


def spline_values(coefficients: DataFrame, queries: DataFrame, keys: Sequence[str], time: str, hot_rows: int | None = None) -> DataFrame:
    """Value, slope and second derivative of the splines at query times; times outside use the first or last span.

    With u and w the shares of the span after and before the time, the value is the straight line between the ends plus a
    sixth of the squared width times (u^3 - u) and (w^3 - w) of the bends there.
    """
    keys = list(keys)
    asked = queries.select(*keys, F.col(time).cast("double").alias("t"), F.lit(0).alias("__coef")).distinct()
    both = asked.unionByName(coefficients.withColumn("__coef", F.lit(1)), allowMissingColumns=True)
    span = F.when(F.col("__coef") == 1, F.struct(*SPAN))
    found = scan(both, keys, ["t", "__coef"], {"__a": known_before(span), "__b": next_known(span)}, hot_rows)
    c = F.coalesce(F.col("__a"), F.col("__b"))
    width = c["stop"] - c["start"]
    u, w = (c["stop"] - F.col("t")) / width, (F.col("t") - c["start"]) / width
    bowed = c["left_bend"] * (u * u * u - u) + c["right_bend"] * (w * w * w - w)
    tilt = c["right_bend"] * (3 * w * w - 1) - c["left_bend"] * (3 * u * u - 1)
    return found.filter(F.col("__coef") == 0).select(
        *keys, F.col("t").alias(time),
        (u * c["left"] + w * c["right"] + width * width / 6 * bowed).alias("value"),
        ((c["right"] - c["left"]) / width + width / 6 * tilt).alias("slope"),
        (u * c["left_bend"] + w * c["right_bend"]).alias("bend"),
    )

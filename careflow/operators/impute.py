"""Imputation along time, along row order and from the nearest row."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.operators.scan import (
    find_hot, known_after, known_before, last_known, number_rows, row_number, same_rows, scan,
)
from careflow.session import hot_rows as default_hot_rows


def hold(
    df: DataFrame, key: str | Sequence[str], time: str, hours: Mapping[str, float], tie: Sequence[str] = (),
    into: Mapping[str, str] | None = None, source: str | None = None, hot: int | None = None,
    hot_rows: int | None = None, origin: Column | None = None,
) -> DataFrame:
    """Fill nulls with the last measured value of the same key while it is fresh enough.

    A value stays valid for `hours[column]` from when it was measured, fills do not
    extend it. All columns share one sort. `into` writes to other column names,
    `source` also keeps `<column><source>`, the time a filled value was measured or, if
    given, the `origin` of the row it was measured in.
    """
    origin = F.col(time) if origin is None else origin
    keys = [key] if isinstance(key, str) else list(key)
    steps = {
        f"__h{i}": last_known(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(time).alias("t"), *([origin.alias("o")] if source else []))))
        for i, c in enumerate(hours)
    }
    out = scan(df, keys, [time, *tie], steps, hot_rows, hot)
    cols: dict[str, Column] = {}
    for i, (c, h) in enumerate(hours.items()):
        last = F.col(f"__h{i}")
        fresh = F.col(time) - last["t"] <= int(h * 3600)
        cols[(into or {}).get(c, c)] = F.coalesce(F.col(c), F.when(fresh, last["v"]))
        if source:
            cols[f"{c}{source}"] = F.when(F.col(c).isNull() & fresh, last["o"])
    return out.withColumns(cols).drop(*steps)


def interpolate(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], by: Sequence[str] = (), suffix: str = "",
    hot_rows: int | None = None, source: str | None = None, origin: Column | None = None,
) -> DataFrame:
    """Linear interpolation of inner gaps over row positions, no extrapolation.

    `by=[]` runs over the one global row order, across entities. `order` must be a
    total order with a numeric leading column. `source` also keeps `<column><source>`, the
    `origin` of the two rows a filled value lies between.
    """
    keys = list(by)
    hot = find_hot(df, keys, order[0], hot_rows or default_hot_rows(df.sparkSession))
    if keys:
        pos = scan(df, keys, order, {"__pos": row_number()}, hot_rows, hot)
    else:
        pos = number_rows(df, order, "__pos", hot_rows, hot)
    steps = {}
    for i, c in enumerate(columns):
        point = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("__pos").alias("p"), *([origin.alias("o")] if source else [])))
        steps[f"__a{i}"], steps[f"__b{i}"] = known_before(point), known_after(point)
    both = scan(pos, keys, ["__pos"], steps, hot_rows, same_rows(hot))
    cols = {}
    for i, c in enumerate(columns):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        inner = a["v"] + (b["v"] - a["v"]) * (F.col("__pos") - a["p"]) / (b["p"] - a["p"])
        cols[f"{c}{suffix}"] = F.coalesce(F.col(c), inner)
        if source:
            cols[f"{c}{source}"] = F.when(F.col(c).isNull() & inner.isNotNull(), F.array(a["o"], b["o"]))
    return both.withColumns(cols).drop("__pos", *steps)


def null_rates(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of nulls per column, as one row brought to the driver."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def interpolate_sparse_gaps(df: DataFrame, order: Sequence[str], columns: Sequence[str], below: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Interpolate the columns whose null rate is above 0 and under `below`."""
    picked = [c for c, r in null_rates(df, columns).items() if 0 < r < below]
    return interpolate(df, order, picked, by) if picked else df


def row_blocks(df: DataFrame, order: Sequence[str], size: int, name: str = "block", hot_rows: int | None = None) -> DataFrame:
    """Number rows in global order and cut them into blocks of `size`; keeps the row number."""
    out = number_rows(df, order, "row", hot_rows)
    return out.withColumn(name, F.floor((F.col("row") - 1) / size).cast("long"))


def _shared_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean squared difference over the columns that both rows have, infinite without any; rows along the last axis, NaN is missing."""
    diff = a - b
    have = ~(np.isnan(a) | np.isnan(b))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(have.any(axis=-1), np.where(have, diff * diff, 0.0).sum(axis=-1) / have.sum(axis=-1), np.inf)


def _least_distances(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances between the rows `part` and all rows, by products of values, squares and masks.

    The bound takes off what rounding can add to the products; it is -inf where they are not numbers.
    """
    mask = (~np.isnan(x)).astype(float)
    z = np.where(mask > 0, x, 0.0)
    z = np.where(mask > 0, z - z.sum(axis=0) / np.maximum(mask.sum(axis=0), 1), 0.0)
    sq = z * z
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        squares = sq[part] @ mask.T + mask[part] @ sq.T
        shared = mask[part] @ mask.T
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps
        least = ((1 - slack) * squares - 2 * (z[part] @ z.T)) / shared
        least = np.where(shared > 0, np.maximum(least, 0.0), np.inf)
    return np.where(np.isnan(least), -np.inf, least)


def nearest_in_block(x: np.ndarray, most_null: float = 1.0, slab: int = 256, near: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest-row fill of one block: filled values, the row each came from (-1: none) and its distance.

    The distance of two rows is the mean squared difference over shared columns, the first row wins ties.
    A row that lacks a column never shares it, so one distance serves all columns. Bounds by matrix products
    pick the `near` rows that may be nearest; a cell is settled by their exact distances if one that has the
    column is below the bound of all others, else by the exact distances to every row.
    """
    missing = np.isnan(x)
    out, origin, far = x.copy(), np.full(x.shape, -1, dtype=np.int64), np.full(x.shape, np.nan)
    rate = missing.mean(axis=0)
    targets = np.array([c for c in range(x.shape[1]) if 0 < rate[c] < 1 and rate[c] <= most_null], dtype=int)
    if not len(targets):
        return out, origin, far
    rows = np.flatnonzero(missing[:, targets].any(axis=1))
    used = x[:, rate < 1]
    near = min(near, len(x))
    for at in range(0, len(rows), slab):
        part = rows[at:at + slab]
        least = _least_distances(used, part)
        order = np.argpartition(least, near - 1, axis=1) if near < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
        picked = np.sort(order[:, :near], axis=1)
        rest = np.full(len(part), np.inf) if near == len(x) else np.take_along_axis(least, order[:, near:], axis=1).min(axis=1)
        dist = _shared_distance(used[part][:, None, :], used[picked])
        open_ = np.zeros(len(part), dtype=bool)
        for c in targets:
            lacks = np.where(missing[picked, c], np.inf, dist)
            best = lacks.argmin(axis=1)
            d = lacks[np.arange(len(part)), best]
            need, sure = missing[part, c], d < rest
            open_ |= need & ~sure
            take = np.flatnonzero(need & sure)
            origin[part[take], c], far[part[take], c] = picked[take, best[take]], d[take]
        for i in part[open_]:
            d = _shared_distance(used[i], used)
            for c in targets[missing[i, targets] & (origin[i, targets] < 0)]:
                donors = np.flatnonzero(~missing[:, c])
                origin[i, c] = donors[d[donors].argmin()]
                far[i, c] = d[origin[i, c]]
    at, c = np.nonzero(origin >= 0)
    out[at, c] = x[origin[at, c], c]
    return out, origin, far


def fill_from_nearest(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], block: int = 10_000, most_null: float = 0.9,
    keep_source: bool = False, hot_rows: int | None = None, source: str | None = None, origin: str | None = None,
) -> DataFrame:
    """1-nearest-neighbour fill inside blocks of consecutive rows.

    Blocks are a partition key of bounded size, so a task holds at most `block` rows
    and row pairs only ever exist inside it. With `keep_source` the row number each
    filled value came from is added as `<column>_row`. `source` keeps `<column><source>` of
    filled cells: the column `origin` of the row the value came from, and its `distance`
    (infinite for a row that shares no column).
    """
    cols, keys = list(columns), list(dict.fromkeys([*order]))
    numbered = row_blocks(df, order, block, "__block", hot_rows)
    schema = numbered.drop("__block").withColumns({c: F.col(c).cast("double") for c in cols})
    if source:
        kind = f"struct<origin:{df.schema[origin].dataType.simpleString()},distance:double>"
        schema = schema.withColumns({f"{c}{source}": F.lit(None).cast(kind) for c in cols})
    if keep_source:
        schema = schema.withColumns({f"{c}_row": F.lit(None).cast("long") for c in cols})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        values, place, far = nearest_in_block(pdf[cols].to_numpy(dtype="float64"), most_null)
        pdf[cols] = values
        if source:
            names = pdf[origin].tolist()
            for j, c in enumerate(cols):
                pdf[f"{c}{source}"] = [{"origin": names[p], "distance": d} if p >= 0 else None for p, d in zip(place[:, j].tolist(), far[:, j].tolist())]
        if keep_source:
            number = pdf["row"].to_numpy()
            for j, c in enumerate(cols):
                pdf[f"{c}_row"] = pd.array(np.where(place[:, j] < 0, 0, number[place[:, j]]), dtype="Int64")
                pdf.loc[place[:, j] < 0, f"{c}_row"] = pd.NA
        return pdf.drop(columns="__block")

    return numbered.groupBy("__block").applyInPandas(fill, schema.schema)

"""Ordered scans per key that stay balanced when one key holds most of the rows.

A window over `partitionBy(key)` puts a whole key into one task. `scan` first
measures the keys. Where none is large it is exactly that window. Where some are,
the rows are dealt into ranges of keys and order columns together and written, so a
large key is cut wherever its rows are, whatever its value, null or not, and
however many keys are large. The window runs inside a range, and one small table of
totals carries the running state of a key from range to range. A range border
crosses one key at most, so that table has under two rows a range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.session import cut_lineage
from careflow.session import hot_rows as default_hot_rows

PIECE = "__piece"


@dataclass(frozen=True)
class Step:
    """One output column of a scan."""

    kind: str
    expr: Column
    backward: bool = False


def running_sum(expr: Column) -> Step:
    """Sum over this row and every earlier one; nulls count as 0."""
    return Step("sum", F.coalesce(expr, F.lit(0)))


def remaining_sum(expr: Column) -> Step:
    """Sum over this row and every later one; nulls count as 0."""
    return Step("sum", F.coalesce(expr, F.lit(0)), backward=True)


def row_number() -> Step:
    return running_sum(F.lit(1).cast("long"))


def row_number_from_end() -> Step:
    return remaining_sum(F.lit(1).cast("long"))


def last_known(expr: Column) -> Step:
    """Most recent non-null value, this row included."""
    return Step("known", expr)


def next_known(expr: Column) -> Step:
    """Nearest non-null value ahead, this row included."""
    return Step("known", expr, backward=True)


def known_before(expr: Column) -> Step:
    """Most recent non-null value of the earlier rows."""
    return Step("known_strict", expr)


def known_after(expr: Column) -> Step:
    return Step("known_strict", expr, backward=True)


def previous(expr: Column) -> Step:
    """Value of the row before, null or not."""
    return Step("neighbour", expr)


def following(expr: Column) -> Step:
    """Value of the row after, null or not."""
    return Step("neighbour", expr, backward=True)


#: Cells of carried state, two rows a range and one column a step, up to which they are broadcast.
CARRY_CELLS = 200_000


def find_hot(df: DataFrame, keys: Sequence[str], lead: str, limit: int) -> int:
    """Rows of the whole table if a key has more than `limit` of them, else 0."""
    largest, total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return total if (largest or 0) > limit else 0


def same_rows(hot: int) -> int | None:
    """What a measurement says about a scan of the same rows in another order: no large key stays none."""
    return 0 if not hot else None


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join on columns of the same names in which null equals null; `few` broadcasts a right side of bounded size."""
    names = {c: f"__on_{i}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    same = [left[c].eqNullSafe(right[n]) for c, n in names.items()]
    return left.join(F.broadcast(right) if few else right, same, how).drop(*names.values())


def colocate(df: DataFrame, keys: Sequence[str], hot: int) -> DataFrame:
    """Shuffle once by `keys` so that finer groupings and windows of the same keys need no further shuffle.

    Left alone where a key is large, since it would land in one partition.
    """
    return df if hot else df.repartition(*keys)


def _ranges(total: int, limit: int) -> int:
    return -(-total // limit) + 1


def deal_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], total: int, limit: int) -> DataFrame:
    """The rows in ranges of about `limit`, by keys and then order, written with the range's number, so that it stays the same in every use."""
    dealt = df.repartitionByRange(_ranges(total, limit), *[F.col(c).asc() for c in [*keys, *order]])
    return cut_lineage(dealt.withColumn(PIECE, F.spark_partition_id().cast("long")), "ranges")


def _order(order: Sequence[str], backward: bool) -> list[Column]:
    return [F.col(c).desc() if backward else F.col(c).asc() for c in order]


def _local(step: Step, part: list[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*part).orderBy(*_order(order, step.backward))
    if step.kind == "sum":
        return F.sum(step.expr).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if step.kind == "known":
        return F.last(step.expr, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if step.kind == "known_strict":
        return F.last(step.expr, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.lag(F.struct(step.expr.alias("v"))).over(w)


def _summary(step: Step, order: Sequence[str]) -> Column:
    if step.kind == "sum":
        return F.sum(step.expr)
    value = F.struct(step.expr.alias("v"))
    if step.kind != "neighbour":
        value = F.when(step.expr.isNotNull(), value)
    pick = F.min_by if step.backward else F.max_by
    at = F.struct(*[F.col(c) for c in order])
    return pick(value, F.when(value.isNotNull(), at))


def _carry(step: Step, col: str, keys: Sequence[str]) -> Column:
    at = F.desc(PIECE) if step.backward else F.asc(PIECE)
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if step.kind == "sum":
        return F.sum(col).over(w)
    return F.last(col, ignorenulls=True).over(w)


def _combine(step: Step, local: Column, carry: Column | None) -> Column:
    if step.kind == "sum":
        return local if carry is None else local + F.coalesce(carry, F.lit(0))
    if step.kind == "neighbour":
        return (local if carry is None else F.coalesce(local, carry))["v"]
    return local if carry is None else F.coalesce(local, carry["v"])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Mapping[str, Step],
    hot_rows: int | None = None,
    hot: int | None = None,
) -> DataFrame:
    """Append one column per step, evaluated per key in ascending `order`.

    `order` must be a total order inside a key; nulls come first. `keys=[]` scans the
    whole table in one global order. Pass `hot` (from
    `find_hot`) to reuse one measurement for several scans of the same rows.
    """
    limit = hot_rows or default_hot_rows(df.sparkSession)
    if hot is None:
        hot = find_hot(df, keys, order[0], limit)
    names = {f"__s{i}": (name, step) for i, (name, step) in enumerate(steps.items())}
    if not hot:
        if not keys:
            df = df.withColumn(PIECE, F.lit(0))
        part = list(keys) or [PIECE]
        out = df.withColumns({tmp: _local(s, part, order) for tmp, (_, s) in names.items()})
        out = out.withColumns({name: _combine(s, F.col(tmp), None) for tmp, (name, s) in names.items()})
        return out.drop(*names, PIECE)
    tagged = deal_ranges(df, keys, order, hot, limit)
    at = [*keys, PIECE]
    small = tagged.groupBy(*at).agg(*[_summary(s, order).alias(tmp) for tmp, (_, s) in names.items()])
    own = Window.partitionBy(*keys)
    small = small.withColumn("__pieces", F.count(F.lit(1)).over(own)).filter(F.col("__pieces") > 1)
    carries = small.select(*at, *[_carry(s, tmp, keys).alias(f"{tmp}c") for tmp, (_, s) in names.items()])
    out = tagged.withColumns({tmp: _local(s, at, order) for tmp, (_, s) in names.items()})
    few = 2 * _ranges(hot, limit) * len(names) <= CARRY_CELLS
    out = join_null_safe(out, carries, at, "left", few=few)
    out = out.withColumns({name: _combine(s, F.col(tmp), F.col(f"{tmp}c")) for tmp, (name, s) in names.items()})
    return out.drop(*names, *[f"{t}c" for t in names], PIECE)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of `probs`.

    Groups of ordinary size use the built-in aggregate. Where a group is large the
    values are counted first, ranked by a balanced scan and picked by rank, so no
    task holds a group's values.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    limit = hot_rows or default_hot_rows(df.sparkSession)
    hot = find_hot(rows, keys, value, limit)
    if not hot:
        every = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__q")
        got = rows.groupBy(*keys).agg(every) if keys else rows.agg(every)
        return got.select(*keys, *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = scan(
        counts, keys, [value],
        {"__to": running_sum(F.col("__n")), "__rest": remaining_sum(F.col("__n"))}, limit,
    ).withColumn("__last", F.col("__to") + F.col("__rest") - F.col("__n") - 1)

    def at(rank: Column) -> Column:
        inside = (F.col("__to") - F.col("__n") <= rank) & (rank < F.col("__to"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = []
    for name, p in probs.items():
        pos = F.col("__last") * F.lit(float(p))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def number_rows(
    df: DataFrame, order: Sequence[str], name: str = "row", hot_rows: int | None = None, whole: int | None = None,
) -> DataFrame:
    """1-based row number in one global order, without a single-partition sort on large tables."""
    return scan(df, [], order, {name: row_number()}, hot_rows, whole)

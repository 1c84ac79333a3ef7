"""Column expressions used across the operators. All stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def outside(c: Column, low: float | None, high: float | None) -> Column:
    """True where a value lies out of its open-ended bounds; null is not out of bounds."""
    tests = []
    if low is not None:
        tests.append(c < F.lit(low))
    if high is not None:
        tests.append(c > F.lit(high))
    test = F.lit(False)
    for t in tests:
        test = test | t
    return F.coalesce(test, F.lit(False))


def cases(pairs: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Ordered CASE: the first condition that holds wins."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def stepwise(
    x: Column,
    at_most: Mapping[float, float],
    at_least: Mapping[float, float] | None = None,
) -> Column:
    """Step lookup. The tightest `x <= key` wins, then the highest `x >= key`; a 0 result is null."""
    pairs = [(x <= k, float(v)) for k, v in sorted(at_most.items())]
    pairs += [(x >= k, float(v)) for k, v in sorted((at_least or {}).items(), reverse=True)]
    return F.nullif(cases(pairs), F.lit(0.0))


def digitize(x: Column, edges: Sequence[float | Column]) -> Column:
    """Number of edges at or below `x`: 0 under the first edge, bins closed on the left."""
    total = F.lit(0)
    for e in edges:
        total = total + (x >= e).cast("int")
    return total


def to_base36(c: Column) -> Column:
    return F.conv(c.cast("string"), 10, 36)


def from_base36(c: Column) -> Column:
    return F.conv(c, 36, 10).cast("long")


def softmax_of(q: Column, over) -> Column:
    """Softmax of `q` over a window's rows, shifted by the maximum."""
    e = F.exp(q - F.max(q).over(over))
    return e / F.sum(e).over(over)


def one_hot(index: Column, size: int) -> Column:
    """Array of `size` zeros with a 1 at `index`; all zeros for an index out of range or null."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.coalesce((i == index).cast("double"), F.lit(0.0)),
    )


def quantise(t: Column, step: float) -> Column:
    """Round to a multiple of `step`, halves to even."""
    return F.bround(t / F.lit(step), 0) * F.lit(step)


def hash_unit(*parts: Column | str) -> Column:
    """Reproducible number in [0, 1) from an MD5 of the parts, equal on every engine."""
    return F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_below(share: float, *parts: Column | str) -> Column:
    """`hash_unit(...) < share` as one comparison of hexadecimal text."""
    bound = math.ceil(share * 4294967296)
    if bound >= 4294967296:
        return F.lit(True)
    return F.substring(hash_order(*parts), 1, 8) < F.lit(f"{max(bound, 0):08x}")


def hash_order(*parts: Column | str) -> Column:
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def code_of_text(text: Column, codes: Mapping[str, int], otherwise: Column) -> Column:
    """Numeric code of a lower-cased text value, else another column."""
    low = F.lower(text)
    by_code: dict[int, list[str]] = {}
    for word, code in codes.items():
        by_code.setdefault(code, []).append(word)
    return cases([(low.isin(words), float(code)) for code, words in by_code.items()], otherwise)

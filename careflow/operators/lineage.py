"""Change log at cell level and the questions asked of it.

A record says that a cell `(value_row, value_col)` was set by a change, from a
reference cell where there is one. `seq` orders the records in time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions.scalar import from_base36, to_base36
from careflow.operators.scan import find_hot, known_before, last_known, running_sum, same_rows, scan
from careflow.session import cut_lineage, hot_rows

RECORD = ["seq", "value_row", "value_col", "change_type", "metadata", "reference_row", "reference_col"]


def with_references(log: DataFrame) -> DataFrame:
    """The cell each record depends on; a missing part of the reference is the record's own."""
    return log.withColumns({
        "from_row": F.coalesce("reference_row", "value_row"), "from_col": F.coalesce("reference_col", "value_col"),
    })


def cell_log(
    df: DataFrame, row: Column, references: Mapping[str, Column], change_type: str, metadata: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One record per changed cell and row it was made from, for all columns in one pass over `df`.

    `row` names a row, by its own key rather than its position; `references` holds for each column the rows that a
    changed cell was made from, as an array that is null where the cell did not change. `metadata` is a text per column.
    """
    none = F.lit(None).cast("string")
    cells = F.array(*[
        F.when(made_from.isNotNull(), F.struct(F.lit(c).alias("value_col"), made_from.alias("rows"), (metadata or {}).get(c, none).alias("metadata")))
        for c, made_from in references.items()
    ])
    changed = df.select(row.alias("value_row"), F.explode(F.array_compact(cells)).alias("c"))
    return changed.select(
        "value_row", "c.value_col", F.lit(change_type).alias("change_type"), "c.metadata", F.explode("c.rows").alias("reference_row"), F.col("c.value_col").alias("reference_col"))


def matching(log: DataFrame, rows: DataFrame | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Records of the queried cells: given rows, given columns, or both."""
    out = log
    if rows is not None:
        out = out.join(rows.select("value_row").distinct(), "value_row", "left_semi")
    if cols is not None:
        out = out.filter(F.col("value_col").isin(list(cols)))
    return out


QUERY = ["query_row", "query_col"]
CELL = ["cell_row", "cell_col"]
OTHER = ["other_row", "other_col"]


def _nodes(steps: DataFrame) -> DataFrame:
    """Where each record leads, from one scan over all cells and one within them.

    `steps` has a record's place in time `at`, its cell and the other cell it leads to. `target` is the last record of the other
    cell before it (null within its own cell). The state "this cell up to `at`" leads to the targets of all records
    up to `at`: with `changes` 0 they lie in one cell, and `next`, the latest, is the only way on.
    """
    key = ["key_row", "key_col"]
    outside = ~(F.col(CELL[0]).eqNullSafe(F.col(OTHER[0])) & F.col(CELL[1]).eqNullSafe(F.col(OTHER[1])))

    def point(cell: Sequence[str], kind: int) -> Column:
        return F.struct(*[F.col(c).alias(k) for c, k in zip(cell, key)], F.lit(kind).alias("kind"))

    points = steps.select("*", outside.alias("outside"), F.inline(F.array_compact(F.array(point(CELL, 1), F.when(outside, point(OTHER, 0))))))
    hot = find_hot(points, key, "at", hot_rows(steps.sparkSession))
    last = scan(points, key, ["at", "kind"], {"last": last_known(F.when(F.col("kind") == 1, F.col("at")))}, hot=hot)
    led = last.filter("kind = 0 or not outside").select("at", "seq", *CELL, *OTHER, F.when(F.col("kind") == 0, F.col("last")).alias("target"))
    place = F.when(F.col("target").isNotNull(), F.struct(*OTHER))
    led = scan(led, CELL, ["at"], {"__before": known_before(place), "next": last_known(F.col("target"))}, hot=same_rows(hot))
    turn = F.col("target").isNotNull() & F.col("__before").isNotNull() & ~F.col("__before").eqNullSafe(F.struct(*OTHER))
    return scan(led, CELL, ["at"], {"changes": running_sum(turn.cast("long"))}, hot=same_rows(hot)).drop("__before")


def _reach(steps: DataFrame, cells: DataFrame) -> DataFrame:
    """All records reached from the queried cells; `(query cell, seq)` pairs, each once.

    A state is a cell with its records up to a place in time, named by the last of them. States with one way on form
    chains, whose 2^k-th successors come from k self-joins; a query follows a whole chain by one join a power of two. Only where
    a cell's records lead to several cells is another round taken. So written rounds grow with the logarithm of the
    chain length and the number of such cells in a row, not with the number of hops.
    """
    nodes = cut_lineage(_nodes(steps), "lineage")
    jumps = [nodes.filter("changes = 0 and next is not null").select("at", "next")]
    while True:
        ahead = jumps[-1].select(F.col("at").alias("next"), F.col("next").alias("after"))
        longer = cut_lineage(jumps[-1].join(ahead, "next").select("at", F.col("after").alias("next")), "jumps")
        if longer.isEmpty():
            break
        jumps.append(longer)
    several = nodes.filter("changes > 0").select("at", *CELL)
    branching = not several.isEmpty()

    tops = nodes.groupBy(*CELL).agg(F.max("at").alias("at"))
    new = tops.join(cells, CELL, "left_semi").select(*[F.col(c).alias(q) for c, q in zip(CELL, QUERY)], "at")
    seen = None
    while True:
        for jump in jumps:
            new = new.join(jump, "at", "left").select(*QUERY, F.explode(F.array("at", "next")).alias("at")).filter("at is not null")
        new = cut_lineage(new.distinct(), "reached")
        seen = new if seen is None else seen.unionByName(new)
        if not branching:
            break
        here = new.join(several, "at").groupBy(*QUERY, *CELL).agg(F.max("at").alias("until"))
        led = nodes.filter("target is not null").select(*CELL, *OTHER, "at", "target")
        step = here.join(led, CELL).filter("at <= until").groupBy(*QUERY, *OTHER).agg(F.max("target").alias("at"))
        new = cut_lineage(step.select(*QUERY, "at").join(seen, [*QUERY, "at"], "left_anti"), "front")
        if new.isEmpty():
            break
    until = seen.join(nodes.select("at", *CELL), "at").groupBy(*QUERY, *CELL).agg(F.max("at").alias("until"))
    return until.join(nodes.select(*CELL, "at", "seq"), CELL).filter("at <= until").select(*QUERY, "seq")


def dependencies(
    log: DataFrame, rows: DataFrame | None = None, cols: Sequence[str] | None = None, before: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every record the queried cells depend on, and the path of each queried cell.

    Returns the records and `(query_row, query_col, seq)`, where `seq` gives the order the changes were made in.
    `before` leaves out records from that sequence number on.
    """
    log = log if before is None else log.filter(F.col("seq") < before)
    refs = with_references(log)
    cells = matching(log, rows, cols).select(F.col("value_row").alias(CELL[0]), F.col("value_col").alias(CELL[1])).distinct()
    steps = refs.select(
        F.col("seq").alias("at"), "seq", F.col("value_row").alias(CELL[0]), F.col("value_col").alias(CELL[1]),
        F.col("from_row").alias(OTHER[0]), F.col("from_col").alias(OTHER[1]))
    path = _reach(steps, cells)
    return log.join(path.select("seq").distinct(), "seq", "left_semi"), path


def descendants(log: DataFrame, rows: DataFrame | None = None, cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every record made from the queried cells, and which queried cell each comes from.

    The same walk with time and references turned round: a record leads from the cell it was made from to its own.
    """
    refs = with_references(log)
    steps = refs.select(
        (-F.col("seq")).alias("at"), "seq", F.col("from_row").alias(CELL[0]), F.col("from_col").alias(CELL[1]),
        F.col("value_row").alias(OTHER[0]), F.col("value_col").alias(OTHER[1]))
    hit = steps if rows is None else steps.join(rows.select(F.col("value_row").alias(CELL[0])).distinct(), CELL[0], "left_semi")
    hit = hit if cols is None else hit.filter(F.col(CELL[1]).isin(list(cols)))
    path = _reach(steps, hit.select(*CELL).distinct())
    return log.join(path.select("seq").distinct(), "seq", "left_semi"), path


def change_types(log: DataFrame) -> DataFrame:
    return log.select("change_type").distinct()


def of_type(log: DataFrame, change_type: str) -> DataFrame:
    return log.filter(F.col("change_type") == change_type)


def summary(log: DataFrame) -> DataFrame:
    """Records per change type and column."""
    return log.groupBy("change_type", "value_col").agg(F.count(F.lit(1)).alias("records"))


def encode_rows(log: DataFrame) -> DataFrame:
    """Row numbers as base-36 text, the form the log is stored in."""
    return log.withColumns({c: to_base36(F.col(c)) for c in ("value_row", "reference_row")})


def decode_rows(log: DataFrame) -> DataFrame:
    return log.withColumns({c: from_base36(F.col(c)) for c in ("value_row", "reference_row")})

"""Cohort selection on binned rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.session import cut_lineage


def extreme_stays(
    df: DataFrame, limits: Mapping[str, float] = {"output_step": 12000, "Total_bili": 10000, "input_step": 10000},
    stay: str = "icustayid",
) -> DataFrame:
    """Stays with any value over its limit."""
    over = F.lit(False)
    for c, limit in limits.items():
        over = over | (F.col(c) > limit)
    return df.filter(over).select(stay).distinct()


def stopped_treatment(
    df: DataFrame, stay: str = "icustayid", bloc: str = "bloc", death: str = "morta_90", vaso: str = "max_dose_vaso",
    score: str = "SOFA", low: float = 0.01, high: float = 0.3, blocs: int = 20,
) -> DataFrame:
    """Stays that died after treatment was withdrawn: vasopressor stopped while the score was still high."""
    last = F.max_by(F.struct(F.col(vaso).alias("v"), F.col(score).alias("s")), F.col(bloc))
    g = df.groupBy(stay).agg(
        F.max(death).alias("d"), F.max(vaso).alias("mv"), F.max(score).alias("ms"), last.alias("l"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.filter(
        (F.col("d") == 1) & (F.col("l.v").isNull() | (F.col("l.v") < low)) & (F.col("mv") > high)
        & (F.col("l.s") >= F.col("ms") / 2) & (F.col("n") < blocs)
    ).select(stay)


def died_during_record(
    df: DataFrame, stay: str = "icustayid", died: str = "died_within_48h_of_out_time",
    delay: str = "delay_end_of_record_and_discharge_or_death", hours: float = 24,
) -> DataFrame:
    return df.filter((F.col(died) == 1) & (F.col(delay) < hours)).select(stay).distinct()


def exclude_in_turn(df: DataFrame, rules: list[tuple], stay: str = "icustayid") -> tuple[DataFrame, DataFrame]:
    """Apply exclusion rules one after the other, each on what the last left.

    `rules` are (name, function from rows to stays); each is evaluated once and its
    stays are written out, so the plan does not nest. Returns the rows kept and an
    audit table with the stays before each rule, those it removed and those left.
    """
    audit = None
    for i, (name, rule) in enumerate(rules):
        out = cut_lineage(rule(df))
        kept = df.join(out, stay, "left_anti")
        row = (
            df.select(stay).distinct().join(out.withColumn("__x", F.lit(1)), stay, "left")
            .agg(F.count(F.lit(1)).alias("before"), F.count("__x").alias("removed"))
            .select(F.lit(i).alias("step"), F.lit(name).alias("rule"), "before", "removed",
                    (F.col("before") - F.col("removed")).alias("after"))
        )
        audit = row if audit is None else audit.unionByName(row)
        df = kept
    return df, audit


def cohort_table(
    df: DataFrame, onsets: DataFrame, stay: str = "icustayid", bloc: str = "bloc", death: str = "morta_90",
    score: str = "SOFA", second: str = "SIRS", at_least: float = 2,
) -> DataFrame:
    """One row per stay that reached the score, with its outcome and onset."""
    g = df.groupBy(stay).agg(
        F.min_by(death, bloc).alias(death), F.max(score).alias(f"max_{score}"), F.max(second).alias(f"max_{second}"),
    )
    return g.filter(F.col(f"max_{score}") >= at_least).join(onsets.select(stay, "onset_time"), stay, "left")


def select_cohort(df: DataFrame, bounds: DataFrame, drop_extreme: bool = True) -> tuple[DataFrame, DataFrame]:
    """The study cohort and the audit of its exclusions."""
    rules = [("extreme values", extreme_stays)] if drop_extreme else []
    rules += [("treatment stopped", stopped_treatment), ("died during record", died_during_record)]
    kept, audit = exclude_in_turn(df, rules)
    return cohort_table(kept, bounds), audit

"""Severity scores and ratios as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.functions.scalar import cases


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(a, b)


def with_mean_filled_ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Ratio whose missing values take the mean of the others; the mean is one number brought to the driver."""
    value = ratio(F.col(a), F.col(b))
    mean = df.agg(F.avg(value)).first()[0]
    return df.withColumn(name, F.coalesce(value, F.lit(mean).cast("double")))


def bands(x: Column, edges: Sequence[float], points: Sequence[float]) -> Column:
    """Points of the left-closed band that holds x, 0 for null."""
    pairs = [(x < e, p) for e, p in zip(edges, points)]
    return F.when(x.isNull(), 0).otherwise(cases(pairs, points[len(edges)]))


def first_band(conditions: Sequence[Column], highest: bool = False) -> Column:
    """Index of the first condition that holds, 0 if none; `highest` takes the last one instead."""
    pairs = list(enumerate(conditions))
    if highest:
        pairs.reverse()
    return cases([(c, i) for i, c in pairs], 0)


def sofa(hours: float = 4.0, highest: bool = False) -> Column:
    """Sum of six organ scores. Values on an open edge fall in no band and score 0."""
    pf, plt, bili = F.col("PaO2_FiO2"), F.col("Platelets_count"), F.col("Total_bili")
    bp, vaso, gcs = F.col("MeanBP"), F.col("max_dose_vaso"), F.col("GCS")
    cr, out = F.col("Creatinine"), F.col("output_step")
    organs = [
        [pf > 400, (pf >= 300) & (pf < 400), (pf >= 200) & (pf < 300), (pf >= 100) & (pf < 200), pf < 100],
        [plt > 150, (plt >= 100) & (plt < 150), (plt >= 50) & (plt < 100), (plt >= 20) & (plt < 50), plt < 20],
        [bili < 1.2, (bili >= 1.2) & (bili < 2), (bili >= 2) & (bili < 6), (bili >= 6) & (bili < 12), bili > 12],
        [bp >= 70, (bp < 70) & (bp >= 65), bp < 65, (vaso > 0) & (vaso <= 0.1), vaso > 0.1],
        [gcs > 14, (gcs > 12) & (gcs <= 14), (gcs > 9) & (gcs <= 12), (gcs > 5) & (gcs <= 9), gcs <= 5],
        [cr < 1.2, (cr >= 1.2) & (cr < 2), (cr >= 2) & (cr < 3.5),
         ((cr >= 3.5) & (cr < 5)) | (out < 500 * hours / 24), (cr > 5) | (out < 200 * hours / 24)],
    ]
    score = F.lit(0)
    for o in organs:
        score = score + first_band(o, highest)
    return score


def sirs() -> Column:
    """Number of inflammatory criteria met; a missing value meets none."""
    t, hr, rr, co2, wbc = (F.col(c) for c in ("Temp_C", "HR", "RR", "paCO2", "WBC_count"))
    return count_true([(t >= 38) | (t <= 36), hr > 90, (rr >= 20) | (co2 <= 32), (wbc >= 12) | (wbc < 4)])


def count_true(conditions: Sequence[Column]) -> Column:
    score = F.lit(0)
    for c in conditions:
        score = score + F.coalesce(c, F.lit(False)).cast("int")
    return score


def saps2(vent: str = "mechvent") -> Column:
    """Acute physiology score; the oxygen ratio counts only under ventilation."""
    score = F.lit(0.0)
    for name, steps in C.SAPS_BANDS.items():
        edges = [high for _, high, _ in steps[:-1]]
        points = bands(F.col(name), edges, [p for *_, p in steps])
        score = score + (points * F.coalesce(F.col(vent), F.lit(0.0)) if name == "PaO2_FiO2" else points)
    return score


def oasis(vent: str = "mechvent", as_written: bool = False) -> Column:
    """Acute severity score. `as_written` tests three consciousness bands on the blood pressure, as published code does."""
    age, bp, gcs, hr, rr, t, out = (F.col(c) for c in ("age", "MeanBP", "GCS", "HR", "RR", "Temp_C", "output_step"))
    g = bp if as_written else gcs
    parts = [
        cases([(age < 24, 0), (age <= 53, 3), (age <= 77, 6), (age <= 89, 9), (age > 89, 7)], 0),
        cases([(bp < 20.65, 4), (bp < 51, 3), (bp < 61.33, 2), (bp < 143.44, 0), (bp >= 143.44, 3)], 0),
        F.greatest(
            cases([(gcs <= 7, 10)], 0), cases([((gcs > 7) & (g < 14), 4)], 0), cases([(g == 14, 3)], 0),
        ),
        cases([(hr < 33, 4), (hr < 89, 0), (hr < 106, 1), (hr <= 125, 3), (hr > 125, 6)], 0),
        cases([(rr < 6, 10), (rr < 13, 1), (rr < 22, 0), (rr < 30, 1), (rr < 44, 6), (rr >= 44, 9)], 0),
        cases([(t < 33.22, 3), (t < 35.93, 4), (t < 36.89, 2), (t <= 39.88, 2), (t > 39.88, 6)], 0),
        cases([(out < 671.09, 10), (out < 1427, 5), (out <= 2514, 1), (out <= 6896, 0), (out > 6896, 8)], 0),
    ]
    score = F.coalesce(F.col(vent), F.lit(0.0)) * 9
    for p in parts:
        score = score + p
    return score


def with_scores(df: DataFrame, hours: float = 4.0) -> DataFrame:
    """Oxygen ratio, shock index, organ failure and inflammation scores on binned rows."""
    df = df.withColumn("PaO2_FiO2", ratio(F.col("paO2"), F.col("FiO2_1")))
    df = with_mean_filled_ratio(df, "HR", "SysBP", "Shock_Index")
    return df.withColumns({"SOFA": sofa(hours), "SIRS": sirs()})

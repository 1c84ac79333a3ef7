"""Row-wise repairs of wide state rows, and the change mask between two versions of a table.

Every function is a projection: no shuffle, whole-stage codegen. A repair can also
yield its change log, built from the same conditions that change the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.functions.scalar import cases, outside, stepwise
from careflow.operators.impute import hold


@dataclass(frozen=True)
class Rule:
    """Set `column` to `value` where `when` holds; named for the change log."""

    name: str
    column: str
    when: Column
    value: Column
    reference_col: str | None = None
    metadata: str | None = None


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Apply rules that all read the incoming row; later rules on one column win."""
    out: dict[str, Column] = {}
    for r in rules:
        keep = out.get(r.column, F.col(r.column))
        out[r.column] = F.when(r.when, r.value).otherwise(keep)
    return df.withColumns(out)


def apply_in_turn(df: DataFrame, stages: Sequence[Sequence[Rule]]) -> DataFrame:
    """Apply stages one after the other, each seeing the result of the last."""
    for rules in stages:
        df = apply_rules(df, rules)
    return df


def log_rules(df: DataFrame, row: Sequence[str], rules: Sequence[Rule], order: int = 0) -> DataFrame:
    """Change log of `rules` on `df` as it stands: one record per changed cell."""
    records = F.array(*[
        F.when(
            r.when,
            F.struct(
                F.lit(order + i).alias("step"), F.lit(r.column).alias("value_col"), F.lit(r.name).alias("change_type"),
                F.lit(r.metadata).cast("string").alias("metadata"), F.lit(r.reference_col).cast("string").alias("reference_col"),
            ),
        )
        for i, r in enumerate(rules)
    ])
    hit = df.select(*row, F.explode(F.filter(records, lambda x: x.isNotNull())).alias("r"))
    return hit.select(*row, "r.*")


def log_in_turn(df: DataFrame, row: Sequence[str], stages: Sequence[Sequence[Rule]]) -> tuple[DataFrame, DataFrame]:
    """Result of `apply_in_turn` with the log of every stage."""
    log, order = None, 0
    for rules in stages:
        part = log_rules(df, row, rules, order)
        log = part if log is None else log.unionByName(part)
        df = apply_rules(df, rules)
        order += len(rules)
    return df, log


def outlier_rules(bounds: Mapping[str, tuple] = C.BOUNDS) -> list[Rule]:
    return [
        Rule("outlier", c, outside(F.col(c), low, high), F.lit(None).cast("double"))
        for c, (low, high) in bounds.items()
    ]


def null_outliers(df: DataFrame, bounds: Mapping[str, tuple] = C.BOUNDS) -> DataFrame:
    return apply_rules(df, outlier_rules(bounds))


def unit_stages(bounds: Mapping[str, tuple] = C.BOUNDS, clamp_row: Sequence[str] = ()) -> list[list[Rule]]:
    """Unit repairs around the outlier filter.

    `clamp_row` lists columns that are set to 100 together with SpO2; by default
    only SpO2 itself is clamped.
    """
    over = F.col("SpO2") > 100
    return [
        [Rule("temp_F logged as temp_C", "Temp_F", (F.col("Temp_C") > 90) & F.col("Temp_F").isNull(),
              F.col("Temp_C"), "Temp_C"),
         Rule("FiO2_100 < 1", "FiO2_100", F.col("FiO2_100") < 1, F.col("FiO2_100") * 100)],
        outlier_rules(bounds),
        [Rule("Clamp SpO2 > 100", c, over, F.lit(100).cast("double")) for c in ("SpO2", *clamp_row)],
    ]


def pair_fill_rules(fraction: str = "FiO2_1", percent: str = "FiO2_100", metadata: str | None = None) -> list[Rule]:
    """Fill a fraction from its percent twin and back, both from the original pair."""
    a, b = F.col(fraction), F.col(percent)
    return [
        Rule(f"Transfer {fraction} from {percent}", fraction, a.isNull() & b.isNotNull(), b / 100, percent, metadata),
        Rule(f"Transfer {percent} from {fraction}", percent, a.isNotNull() & b.isNull(), a * 100, fraction, metadata),
    ]


def gcs_of_rass(rass: Column) -> Column:
    pairs = [(rass >= 0, 15.0)] + [(rass == k, float(v)) for k, v in C.GCS_OF_RASS.items()]
    return cases(pairs)


def gcs_rules() -> list[Rule]:
    known = gcs_of_rass(F.col("RASS"))
    return [Rule("Estimate GCS from RASS", "GCS", F.col("GCS").isNull() & known.isNotNull(), known, "RASS")]


def fio2_rules(interface: str, fio2: str, flow: str, as_written: bool = False) -> list[Rule]:
    """Inspired-oxygen estimates from *held* interface, fraction and flow.

    `as_written` reads the two non-rebreather tests with the operator precedence of
    the original expression, where they never hold for a real interface code.
    """
    i, f, o = F.col(interface), F.col(fio2), F.col(flow)
    no_fio2, has_flow, no_flow = f.isNull(), o.isNotNull(), o.isNull()
    bare = i.isin(*C.INTERFACE_NONE_OR_CANNULA)
    mask = i.isNull() | i.isin(*C.INTERFACE_MASK_OR_VENTILATOR)
    full = F.lit(False) if as_written else F.coalesce(i == C.INTERFACE_NON_REBREATHER, F.lit(False))
    null = F.lit(None).cast("double")
    parts = [
        ("C1", no_fio2 & has_flow & bare, stepwise(o, C.FIO2_CANNULA)),
        ("C2", no_fio2 & no_flow & bare, F.lit(21.0)),
        ("C3", no_fio2 & has_flow & mask, stepwise(o, C.FIO2_MASK)),
        ("C4", no_fio2 & no_flow & mask, null),
        ("C5", no_fio2 & has_flow & full, stepwise(o, C.FIO2_NON_REBREATHER, C.FIO2_NON_REBREATHER_FROM)),
        ("C6", no_fio2 & no_flow & full, null),
    ]
    return [Rule("FiO2 estimation", "FiO2_100", F.coalesce(w, F.lit(False)), v, None, m) for m, w, v in parts]


def estimate_fio2(df: DataFrame, key: str = "icustayid", time: str = "timestep", tie: Sequence[str] = (), as_written: bool = False, hot: int | None = None) -> DataFrame:
    """Fill the oxygen fraction: unit pair, six interface rules on held values, unit pair again."""
    df = apply_rules(df, pair_fill_rules(metadata="R1"))
    sources = {"__i": "Interface", "__f": "FiO2_100", "__o": "O2flow"}
    df = hold(df, key, time, {c: C.HOLD_HOURS[c] for c in sources.values()}, tie,
              into={c: t for t, c in sources.items()}, hot=hot)
    df = apply_rules(df, fio2_rules("__i", "__f", "__o", as_written)).drop(*sources)
    return apply_rules(df, pair_fill_rules(metadata="R2"))


def vital_stages() -> list[list[Rule]]:
    """Blood-pressure triple, temperature swap and conversion, haemoglobin, bilirubin; order matters."""
    s, m, d = F.col("SysBP"), F.col("MeanBP"), F.col("DiaBP")
    tc, tf = F.col("Temp_C"), F.col("Temp_F")
    hb, ht = F.col("Hb"), F.col("Ht")
    tot, direct = F.col("Total_bili"), F.col("Direct_bili")
    null = F.lit(None).cast("double")
    swapped, hot = (tf > 25) & (tf < 45), tc > 70

    def fill(name: str, target: str, source: str, value: Column) -> list[Rule]:
        return [Rule(name, target, F.col(source).isNotNull() & F.col(target).isNull(), value, source)]

    return [
        [Rule("BP estimation", "DiaBP", s.isNotNull() & m.isNotNull() & d.isNull(), (3 * m - s) / 2)],
        [Rule("BP estimation", "MeanBP", s.isNotNull() & d.isNotNull() & m.isNull(), (s + 2 * d) / 3)],
        [Rule("BP estimation", "SysBP", m.isNotNull() & d.isNotNull() & s.isNull(), 3 * m - 2 * d)],
        [Rule("Temp_C from Temp_F", "Temp_C", swapped, tf, "Temp_F"), Rule("Temp_C from Temp_F", "Temp_F", swapped, null)],
        [Rule("Temp_F from Temp_C", "Temp_F", hot, tc, "Temp_C"), Rule("Temp_F from Temp_C", "Temp_C", hot, null)],
        fill("Calculate Temp_F from Temp_C", "Temp_F", "Temp_C", tc * 1.8 + 32),
        fill("Calculate Temp_C from Temp_F", "Temp_C", "Temp_F", (tf - 32) / 1.8),
        fill("Calculate Ht from Hb", "Ht", "Hb", hb * 2.862 + 1.216),
        fill("Calculate Hb from Ht", "Hb", "Ht", (ht - 1.216) / 2.862),
        fill("Calculate direct bili from total bili", "Direct_bili", "Total_bili", tot * 0.6934 - 0.1752),
        fill("Calculate total bili from direct bili", "Total_bili", "Direct_bili", (direct + 0.1752) / 0.6934),
    ]


def correction_stages(median_score: float | None) -> list[list[Rule]]:
    """Feature corrections on binned rows; `median_score` fills a missing comorbidity score."""
    fixes = [
        Rule("shift gender", "gender", F.col("gender").isNotNull(), F.col("gender") - 1),
        Rule("clamp age", "age", F.col("age") > 150, F.lit(91)),
        Rule("replace missing mechvent", "mechvent", F.col("mechvent").isNull(), F.lit(0.0)),
        Rule("zero missing median dose vaso", "median_dose_vaso", F.col("median_dose_vaso").isNull(), F.lit(0.0)),
        Rule("zero missing max dose vaso", "max_dose_vaso", F.col("max_dose_vaso").isNull(), F.lit(0.0)),
        Rule("replace missing elixhauser with median", "elixhauser", F.col("elixhauser").isNull(), F.lit(median_score)),
    ]
    return [fixes, [Rule("binary mechvent", "mechvent", F.col("mechvent") > 0, F.lit(1.0))]]


def change_mask(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per cell: 1 added or changed, -1 removed, 0 same. Rows are matched by key."""
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in columns])

    def cell(c: str) -> Column:
        a, b = F.col(f"__o_{c}"), F.col(c)
        return cases([(a.isNotNull() & b.isNull(), -1), (~a.eqNullSafe(b), 1)], 0).cast("byte").alias(c)

    return new.select(*keys, *columns).join(o, list(keys)).select(*keys, *[cell(c) for c in columns])


def add_missing(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Select `columns` plus the rest, adding the absent ones as null."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(dtype) for c in columns if c not in have}) if set(columns) - have else df

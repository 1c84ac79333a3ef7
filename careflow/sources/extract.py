"""Extracts from a hospital warehouse: one DataFrame builder per raw table.

Builders take the source tables and the names of the columns that differ between
warehouse generations. Times come in as timestamps and leave as epoch seconds.
Nothing is sorted or materialised here; code-list filters reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow import constants as C
from careflow.functions.scalar import cases, code_of_text, epoch
from careflow.operators.scan import row_number, scan

DAY = 86400


def numeric3(c: Column) -> Column:
    """Fixed-point with three decimals, rounded half up."""
    return F.round(c.cast("decimal(38,9)"), 3)


def antibiotics(
    prescriptions: DataFrame, stays: DataFrame, gsn: Sequence[str] = tuple(C.ANTIBIOTIC_GSN), stay: str = "stay_id",
) -> DataFrame:
    """Antibiotic prescriptions; every stay of the admission is kept, or null where there is none."""
    p = prescriptions.filter(F.col("gsn").isin(list(gsn)))
    return p.join(stays.select("hadm_id", F.col(stay).alias("icustayid")), "hadm_id", "left").select(
        "hadm_id", "icustayid",
        epoch(F.col("starttime")).alias("startdate"), epoch(F.col("stoptime")).alias("enddate"),
        "gsn", "ndc",
        F.col("dose_val_rx").alias("dose_val"), F.col("dose_unit_rx").alias("dose_unit"), "route",
    )


def chart_events(
    events: DataFrame, items: Sequence[int] = tuple(C.CHART_ITEMS), stay: str = "stay_id",
    min_stay: int | None = None, max_stay: int | None = None,
    text_codes: Mapping[str, int] = C.INTERFACE_CODES,
) -> DataFrame:
    """Distinct chart events with text values coded, optionally for one half-open range of stays."""
    e = events.filter(F.col("value").isNotNull() & F.col("itemid").isin(list(items)))
    if min_stay is not None:
        e = e.filter(F.col(stay) >= min_stay)
    if max_stay is not None:
        e = e.filter(F.col(stay) < max_stay)
    return e.select(
        F.col(stay).alias("icustayid"), epoch(F.col("charttime")).alias("charttime"), "itemid",
        code_of_text(F.col("value"), text_codes, F.col("valuenum")).alias("valuenum"),
    ).distinct()


def comorbidity_rows(admissions: DataFrame, stays: DataFrame, flags: DataFrame, stay: str = "stay_id") -> DataFrame:
    names = [c for c in flags.columns if c != "hadm_id"]
    return (
        admissions.select("subject_id", "hadm_id")
        .join(stays.select("hadm_id", F.col(stay).alias("icustayid")), "hadm_id")
        .join(flags, "hadm_id")
        .select("subject_id", "hadm_id", "icustayid", *names)
    )


def cultures(events: DataFrame, items: Sequence[int] = tuple(C.CULTURE_ITEMS), stay: str = "stay_id") -> DataFrame:
    return events.filter(F.col("itemid").isin(list(items))).select(
        "subject_id", "hadm_id", F.col(stay).alias("icustayid"),
        epoch(F.col("charttime")).alias("charttime"), "itemid",
    )


def admission_order(stays: DataFrame, subject: str, start: str, tie: Sequence[str], name: str = "adm_order") -> DataFrame:
    """Number the stays of each subject by start time."""
    return scan(stays, [subject], [start, *tie], {name: row_number()})


def death_within(death: Column, since: Column, seconds: int) -> Column:
    """1 where a death is recorded no later than `seconds` after `since`, else 0; earlier deaths count."""
    return F.coalesce((death - since <= seconds).cast("int"), F.lit(0))


def demographics(
    admissions: DataFrame, stays: DataFrame, patients: DataFrame, flags: DataFrame, stay: str = "stay_id",
    birth: str = "anchor",
) -> DataFrame:
    """One row per stay: order, unit, times, age, deaths and the number of comorbidities.

    `birth="anchor"` derives the age from an anchor year and age, `"date"` from a date of birth.
    """
    names = [c for c in flags.columns if c != "hadm_id"]
    score = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    scored = flags.select("hadm_id", score.alias("elixhauser"))
    j = (
        admissions.select("subject_id", "hadm_id", "admittime", "dischtime")
        .join(stays.select("hadm_id", F.col(stay).alias("icustayid"), "first_careunit", "intime", "outtime", "los"), "hadm_id")
        .join(scored, "hadm_id")
        .join(patients, "subject_id")
    )
    if birth == "anchor":
        age = F.year("intime") - F.col("anchor_year") + F.col("anchor_age")
        dob = F.col("anchor_year") - F.col("anchor_age")
    else:
        age = F.round(hours_between(epoch(F.col("intime")), epoch(F.col("dob"))) / 8760).cast("int")
        dob = F.col("dob")
    out = j.select(
        "subject_id", "hadm_id", "icustayid",
        epoch(F.col("admittime")).alias("admittime"), epoch(F.col("dischtime")).alias("dischtime"),
        cases([(F.col("first_careunit") == k, v) for k, v in C.CARE_UNITS.items()]).alias("unit"),
        epoch(F.col("intime")).alias("intime"), epoch(F.col("outtime")).alias("outtime"), "los",
        age.alias("age"), dob.alias("dob"), epoch(F.col("dod")).alias("dod"),
        F.col("dod").isNotNull().alias("expire_flag"),
        cases([(F.col("gender") == k, v) for k, v in C.GENDERS.items()]).alias("gender"),
        "elixhauser",
    ).withColumns({
        "morta_hosp": death_within(F.col("dod"), F.col("dischtime"), DAY),
        "morta_90": death_within(F.col("dod"), F.col("intime"), 90 * DAY),
    })
    return admission_order(out, "subject_id", "intime", ["icustayid"])


def equivalent_volume(
    rows: DataFrame, item: str = "itemid", amount: str = "amount", factors: Mapping[float, Sequence] = C.TONICITY,
) -> DataFrame:
    """Add `tev`: amount weighted by the tonicity of the fluid, three decimals."""
    tev = cases([(F.col(item).isin(list(ids)), F.col(amount) * f) for f, ids in factors.items()], F.col(amount))
    return rows.withColumn("tev", numeric3(tev))


def fluids(
    events: DataFrame, point: bool = False, items: Sequence[int] = tuple(C.FLUID_ITEMS), stay: str = "stay_id",
    factors: Mapping[float, Sequence] = C.TONICITY,
) -> DataFrame:
    """Fluid inputs with equivalent volume: intervals with a rate, or point records."""
    keep = F.col("amount").isNotNull() & F.col("itemid").isin(list(items))
    if not point:
        keep = keep & F.col(stay).isNotNull()
    e = equivalent_volume(events.filter(keep), factors=factors)
    amount = numeric3(F.col("amount")).alias("amount")
    if point:
        return e.select(F.col(stay).alias("icustayid"), epoch(F.col("charttime")).alias("charttime"), "itemid", amount, "tev")
    return e.select(
        F.col(stay).alias("icustayid"), epoch(F.col("starttime")).alias("starttime"),
        epoch(F.col("endtime")).alias("endtime"), "itemid", amount, numeric3(F.col("rate")).alias("rate"), "tev",
    )


def charted_labs(events: DataFrame, items: Sequence[int] = tuple(C.CHARTED_LAB_ITEMS), stay: str = "stay_id") -> DataFrame:
    keep = F.col("valuenum").isNotNull() & F.col(stay).isNotNull() & F.col("itemid").isin(list(items))
    return events.filter(keep).select(
        F.col(stay).alias("icustayid"), epoch(F.col("charttime")).alias("charttime"), "itemid", "valuenum",
    )


def inside_window(
    events: DataFrame, windows: DataFrame, key: str | Sequence[str], time: str, start: str, end: str,
    after_start: int = 0, before_end: int = 0,
) -> DataFrame:
    """Events at least `after_start` past the start and `before_end` short of the end of a window with the same key.

    Every window that holds the event gives a row; the key equality keeps it a hash or merge join.
    """
    on = [key] if isinstance(key, str) else list(key)
    j = events.join(windows, on)
    return j.filter((F.col(time) - F.col(start) >= after_start) & (F.col(end) - F.col(time) >= before_end))


def hospital_labs(
    events: DataFrame, stays: DataFrame, items: Sequence[int] = tuple(C.HOSPITAL_LAB_ITEMS), stay: str = "stay_id",
    margin: int = DAY,
) -> DataFrame:
    """Laboratory events inside a stay narrowed by `margin` seconds on both sides."""
    w = stays.select(
        "subject_id", "hadm_id", F.col(stay).alias("icustayid"),
        epoch(F.col("intime")).alias("intime"), epoch(F.col("outtime")).alias("outtime"),
    ).distinct()
    e = events.filter(F.col("itemid").isin(list(items)) & F.col("valuenum").isNotNull()).select(
        "hadm_id", epoch(F.col("charttime")).alias("charttime"), "itemid", "valuenum",
    )
    return inside_window(e, w, "hadm_id", "charttime", "intime", "outtime", margin, margin).select(
        "icustayid", "charttime", "itemid", "valuenum",
    )


def to_minutes(value: Column, unit: Column) -> Column:
    return cases([(unit == "hour", value * 60), (unit == "min", value), (unit == "day", value * 1440)], value)


def ventilation_procedures(procedures: DataFrame, groups: Mapping[str, Sequence] = C.VENT_PROCEDURE_ITEMS) -> DataFrame:
    """Ventilation procedures with three 0/1 flags by item and the duration in minutes."""
    every = sorted({i for ids in groups.values() for i in ids})
    flags = [F.col("itemid").isin(list(ids)).cast("int").alias(name) for name, ids in groups.items()]
    return procedures.filter(F.col("itemid").isin(every)).select(
        "subject_id", "hadm_id", F.col("stay_id").alias("icustayid"),
        epoch(F.col("starttime")).alias("starttime"), epoch(F.col("endtime")).alias("endtime"),
        *flags, "itemid", to_minutes(F.col("value"), F.col("valueuom")).alias("value"),
    )


def max_flags(rows: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """One row per key, each flag 1 where any row meets its condition; null conditions count as 0."""
    return rows.groupBy(*keys).agg(
        *[F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias(name) for name, cond in flags.items()]
    )


def ventilation(events: DataFrame, stay: str = "stay_id") -> DataFrame:
    item, value = F.col("itemid"), F.col("value")
    codes = [C.EXTUBATION_ITEM, C.VENT_TYPE_ITEM, C.OXYGEN_DEVICE_ITEM, *C.VENT_MEASUREMENT_ITEMS]
    e = events.filter(value.isNotNull() & item.isin(codes)).select(
        F.col(stay).alias("icustayid"), epoch(F.col("charttime")).alias("charttime"), "itemid", "value",
    )
    self_out = (item == C.EXTUBATION_ITEM) & (value == "Self Extubation")
    return max_flags(e, ["icustayid", "charttime"], {
        "mechvent": ((item == C.VENT_TYPE_ITEM) & (value != "Other/Remarks"))
        | ((item == C.OXYGEN_DEVICE_ITEM) & (value == "Ventilator"))
        | item.isin(C.VENT_MEASUREMENT_ITEMS),
        "extubated": ((item == C.EXTUBATION_ITEM) & (value == "Extubated")) | self_out,
        "selfextubated": self_out,
    })


def microbiology(events: DataFrame, stays: DataFrame, stay: str = "stay_id") -> DataFrame:
    s = stays.select("subject_id", "hadm_id", F.col(stay).alias("icustayid"))
    return events.join(s, ["subject_id", "hadm_id"], "left").select(
        "subject_id", "hadm_id", "icustayid", epoch(F.col("charttime")).alias("charttime"),
        epoch(F.col("chartdate")).alias("chartdate"), "org_itemid", "spec_itemid", "ab_itemid", "interpretation",
    )


def first_known_total(entities: DataFrame, key: str, sources: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """Sum each source per key; an entity takes the first source that has a total, else null."""
    out = entities.select(key)
    parts = []
    for i, (rows, amount) in enumerate(sources):
        part = f"__p{i}"
        out = out.join(rows.groupBy(key).agg(F.sum(amount).alias(part)), key, "left")
        parts.append(F.col(part))
    return out.select(key, F.coalesce(*parts).alias(name))


def preadmission_fluid(
    stays: DataFrame, known_items: DataFrame, inputs: Sequence[DataFrame], stay: str = "stay_id",
    items: Sequence[int] = tuple(C.PREADMISSION_FLUID_ITEMS),
) -> DataFrame:
    """Volume before admission per stay; `inputs` in order of preference."""
    known = known_items.select("itemid")
    sources = [
        (i.filter(F.col("itemid").isin(list(items))).join(known, "itemid").select(F.col(stay).alias("icustayid"), "amount"), "amount")
        for i in inputs
    ]
    return first_known_total(stays.select(F.col(stay).alias("icustayid")), "icustayid", sources, "input_preadm")


def preadmission_urine(outputs: DataFrame, stays: DataFrame, stay: str = "stay_id", items: Sequence[int] = tuple(C.PREADMISSION_URINE_ITEMS)) -> DataFrame:
    """Distinct outputs recorded before admission, with the minutes to the start of the stay."""
    o = outputs.filter(F.col("itemid").isin(list(items))).select(
        F.col(stay).alias("icustayid"), epoch(F.col("charttime")).alias("charttime"), "itemid", "value",
    )
    s = stays.select(F.col(stay).alias("icustayid"), epoch(F.col("intime")).alias("intime"))
    return o.join(s, "icustayid").select(
        "icustayid", "charttime", "itemid", "value",
        minute_boundaries(F.col("intime"), F.col("charttime")).alias("datediff_minutes"),
    ).distinct()


def minute_boundaries(later: Column, earlier: Column) -> Column:
    """Minute boundaries crossed between two epoch times."""
    return (F.floor(later / 60) - F.floor(earlier / 60)).cast("long")


def urine(outputs: DataFrame, items: Sequence[int] = tuple(C.URINE_ITEMS), stay: str = "stay_id") -> DataFrame:
    keep = F.col(stay).isNotNull() & F.col("value").isNotNull() & F.col("itemid").isin(list(items))
    return outputs.filter(keep).select(
        F.col(stay).alias("icustayid"), epoch(F.col("charttime")).alias("charttime"), "itemid", "value",
    )


def standard_rate(
    item: Column, unit: Column, rate: Column,
    noradrenaline: Sequence = tuple(C.NORADRENALINE), adrenaline: Sequence = tuple(C.ADRENALINE),
    vasopressin: Sequence = tuple(C.VASOPRESSIN), phenylephrine: Sequence = tuple(C.PHENYLEPHRINE),
    dopamine: Sequence = tuple(C.DOPAMINE), weight: float = C.DEFAULT_WEIGHT_KG,
    per_kg_min: str = "mcg/kg/min", per_min: str = "mcg/min", units_min: str = "units/min", units_hour: str = "units/hour",
) -> Column:
    """Noradrenaline-equivalent rate. Rules are tried in order: a vasopressin rate over 0.2 is hourly whatever its unit."""
    rules = []
    for drugs, factor in ((noradrenaline, 1.0), (adrenaline, 1.0)):
        rules += [(item.isin(list(drugs)) & (unit == per_kg_min), rate * factor),
                  (item.isin(list(drugs)) & (unit == per_min), rate * factor / weight)]
    is_vasopressin = item.isin(list(vasopressin))
    rules += [(is_vasopressin & (rate > 0.2), rate * 5 / 60),
              (is_vasopressin & (unit == units_min), rate * 5),
              (is_vasopressin & (unit == units_hour), rate * 5 / 60)]
    for drugs, factor in ((phenylephrine, 0.45), (dopamine, 0.01)):
        rules += [(item.isin(list(drugs)) & (unit == per_kg_min), rate * factor),
                  (item.isin(list(drugs)) & (unit == per_min), rate * factor / weight)]
    return numeric3(cases(rules))


def vasopressors(events: DataFrame, point: bool = False, items: Sequence[int] = tuple(C.VASOPRESSOR_ITEMS), stay: str = "stay_id") -> DataFrame:
    """Standardised vasopressor doses: intervals without rewritten orders, or point records."""
    e = events.filter(F.col("itemid").isin(list(items)) & F.col("rate").isNotNull())
    dose = standard_rate(F.col("itemid"), F.col("rateuom"), F.col("rate")).alias("ratestd")
    if point:
        return e.select(F.col(stay).alias("icustayid"), "itemid", epoch(F.col("charttime")).alias("charttime"), dose)
    return e.filter(F.col("statusdescription") != "Rewritten").select(
        F.col(stay).alias("icustayid"), "itemid", epoch(F.col("starttime")).alias("starttime"),
        epoch(F.col("endtime")).alias("endtime"), dose,
    )


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole hours between two epoch times, cut toward zero."""
    h = (later - earlier) / 3600
    return F.when(h >= 0, F.floor(h)).otherwise(F.ceil(h)).cast("long")


def notes(events: DataFrame, stays: DataFrame, stay: str = "stay_id", summary: str = "Discharge summary", hours_after: int = 48) -> DataFrame:
    """Notes of an admission with a stay: summaries, and notes dated within the stay (plus `hours_after`)."""
    s = stays.filter(F.col(stay).isNotNull()).select(
        "hadm_id", F.col(stay).alias("icustayid"),
        epoch(F.col("intime")).alias("__in"), epoch(F.col("outtime")).alias("__out"),
    )
    day = epoch(F.col("chartdate"))
    near = (hours_between(day, F.col("__in")) >= 0) & (hours_between(day, F.col("__out")) <= hours_after)
    j = events.filter(F.col("iserror").isNull()).join(s, "hadm_id")
    return j.filter((F.col("category") == summary) | near).select(
        "subject_id", "hadm_id", "icustayid", "chartdate", "charttime", "category", "text",
    )


def comorbidity_rules(spark, codes: Mapping[str, Sequence[tuple[int, int, Sequence[str]]]] = C.COMORBIDITY_CODES) -> DataFrame:
    """Rule table `(version, len, prefix, flag)`; its size is that of the published definition."""
    rows = [(version, length, code, flag) for flag, lists in codes.items() for version, length, listed in lists for code in listed]
    return spark.createDataFrame(rows, "version int, len int, prefix string, flag string")


def coded_flags(
    entities: DataFrame, codes: DataFrame, rules: DataFrame, key: str, flags: Sequence[str],
    code: str = "code", version: str = "version", small: bool = False,
) -> DataFrame:
    """0/1 flags per entity from coded rows and a prefix rule table; entities without codes get 0.

    Each code is looked up once per prefix length by equality, and rows that set no flag are gone before the shuffle.
    `small` says that the rule table is one of fixed size, as that of `comorbidity_rules` is, and may be broadcast.
    """
    lengths = [0, 3, 4]
    probes = F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("len"),
            (F.col(code) if n == 0 else F.substring(F.col(code), 1, n)).alias("prefix"),
        ) for n in lengths
    ]))
    probed = codes.select(F.col(key), F.col(version).cast("int").alias("version"), probes.alias("p")).select(
        key, "version", "p.len", "p.prefix",
    )
    hits = probed.join(F.broadcast(rules) if small else rules, ["version", "len", "prefix"]).select(key, "flag")
    per = hits.groupBy(key).agg(
        *[F.max(F.when(F.col("flag") == f, 1).otherwise(0)).alias(f) for f in flags]
    )
    return entities.select(key).distinct().join(per, key, "left").select(
        key, *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in flags],
    )


def comorbidities(admissions: DataFrame, diagnoses: DataFrame, key: str = "hadm_id") -> DataFrame:
    """The 30 comorbidity flags per admission."""
    raw = coded_flags(
        admissions, diagnoses, comorbidity_rules(admissions.sparkSession), key, list(C.COMORBIDITY_CODES),
        code="icd_code", version="icd_version", small=True,
    )

    def merged(name: str) -> Column:
        if name not in C.COMORBIDITY_MERGES:
            return F.col(name)
        set_by, unset_by = C.COMORBIDITY_MERGES[name]
        value = F.greatest(*[F.col(f) for f in set_by]) if len(set_by) > 1 else F.col(set_by[0])
        return value if unset_by is None else F.when(F.col(unset_by) == 1, 0).otherwise(value)

    return raw.select(key, *[merged(n).alias(n) for n in C.COMORBIDITIES])

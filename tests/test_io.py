"""Readers and writers on small files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from careflow.operators import joins, lineage, series
from careflow.plans.standins import measurements
from careflow.sources import extract, io


def test_first_existing_path_and_types(spark, tmp_path):
    raw = tmp_path / "raw_data"
    raw.mkdir()
    (raw / "uo.csv").write_text("icustayid,charttime,itemid,value\n1,10,5,2.5\n,11,5,NaN\n")
    df = io.read_stage_table(spark, str(tmp_path), "uo")
    assert [tuple(r) for r in df.orderBy("charttime").collect()] == [(1, 10, 5, 2.5), (None, 11, 5, None)]
    assert io.read_table(spark, str(raw / "uo.csv"), schema=io.raw_schema("uo"), need_stay=True).count() == 1
    mid = tmp_path / "intermediates"
    mid.mkdir()
    (mid / "uo.csv").write_text("icustayid,charttime,itemid,value\n7,10,5,2.5\n")
    assert io.read_stage_table(spark, str(tmp_path), "uo").first().icustayid == 7
    assert io.read_stage_table(spark, str(tmp_path), "vaso_cv", optional=True) is None
    with pytest.raises(FileNotFoundError):
        io.read_stage_table(spark, str(tmp_path), "vaso_cv")


def test_prefix_union_and_positional_names(spark, tmp_path):
    for i in (0, 1):
        (tmp_path / f"ce{i}.csv").write_text(f"a,b,c,d\n{i},1,2,3.0\n")
    (tmp_path / "labs.csv").write_text("a,b,c,d\n9,1,2,3.0\n")
    df = io.read_prefix(spark, str(tmp_path), "ce", io.raw_schema("ce"))
    assert sorted(r.icustayid for r in df.collect()) == [0, 1]
    named = io.rename_by_position(spark.createDataFrame([("5", 1.0)], "x string, y double"), ["hadm_id", "value"])
    assert named.dtypes == [("hadm_id", "bigint"), ("value", "double")]


def test_short_floats(spark):
    xs = [0.0, 1.0, 2.5, 1234567.0, 0.1 + 0.2, 100.0, -3.14159265, 1e-5, None]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r.s for r in df.select(io.short_float(F.col("v")).alias("s")).collect()]
    assert [None if g is None else float(g) for g in got] == [None if x is None else float("%g" % x) for x in xs]
    assert got[:3] == ["0", "1", "2.5"] and got[5] == "100"


def test_write_once_and_file_size(spark, tmp_path):
    df = spark.range(100).repartition(1)
    io.write_table(df, str(tmp_path / "t"), records_per_file=30)
    assert len(list(Path(tmp_path / "t").glob("*.parquet"))) == 4
    io.write_table(spark.range(5), str(tmp_path / "t"), mode="ignore")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_record_files(spark, tmp_path):
    d = tmp_path / "set"
    d.mkdir()
    (d / "132539.txt").write_text("Time,Parameter,Value\n00:00,RecordID,132539\n00:07,HR,73\n00:08,HR,75\n37:37,Temp,35.6\n")
    (d / "132540.txt").write_text("Time,Parameter,Value\n01:00,HR,60\n")
    rec = io.read_records(spark, str(d))
    assert rec.count() == 4
    q = series.quantised_series(rec, "record", "hours", "param", "value", ["HR", "Temp"], 0.1)
    got = {(r.record, round(r.tq, 1)): (r.HR, r.HR_mask, r.Temp, r.Temp_mask) for r in q.collect()}
    assert got == {("132539", 0.0): (0, 0, 0, 0), ("132539", 0.1): (74.0, 1, 0, 0), ("132539", 37.6): (0, 0, 35.6, 1),
                   ("132540", 0.0): (0, 0, 0, 0), ("132540", 1.0): (60.0, 1, 0, 0)}
    (tmp_path / "outcomes.txt").write_text("RecordID,a,b,c,d,e\n132539,1,2,3,4,1\n")
    assert io.read_outcomes(spark, str(tmp_path / "outcomes.txt")).first().label == 1.0


def test_written_records_are_one_file_each(spark, tmp_path):
    rows = [(i % 7 if i % 50 else None, f"{i:02d}:30", "p,1" if i % 3 else None, i / 4 if i % 5 else None) for i in range(300)]
    lines = spark.createDataFrame(rows, "record long, Time string, Parameter string, Value double").repartition(6)
    io.write_records(lines, str(tmp_path / "new"))
    lines.write.partitionBy("record").option("header", True).csv(str(tmp_path / "spark"))
    name = r"record=([^/.]+)"
    new, old = (io.read_records(spark, str(tmp_path / d), name) for d in ("new", "spark"))
    new, old = (d.select("record", "hours", "param", "value") for d in (new, old))
    assert len(list((tmp_path / "new").rglob("*.csv"))) == 8 < len(list((tmp_path / "spark").rglob("*.csv")))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, new.collect())) == sorted(map(key, old.collect())) and new.count() > 190
    io.write_records(lines, str(tmp_path / "hot"), hot=300)
    assert io.read_records(spark, str(tmp_path / "hot"), name).count() == new.count()


def test_capped_files_are_read_without_a_shuffle_of_rows(spark):
    from careflow.plans.queries_io import capped_files

    plan = capped_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_comorbidity_rules(spark):
    # A whole code "C1" equals the two-character entry of the three-character list.
    d = spark.createDataFrame([
        (1, "39891", 9), (1, "4010", 9), (2, "I50", 10), (2, "E112", 10), (2, "E119", 10), (3, "C15", 10), (3, "C77", 10),
        (4, "428", 10), (5, "R64", 10), (6, "E03", 10), (7, "C1", 10), (7, "C9", 10)], "hadm_id long, icd_code string, icd_version int")
    ad = spark.createDataFrame([(i,) for i in range(1, 9)], "hadm_id long")
    got = {r.hadm_id: {k for k, v in r.asDict().items() if v == 1 and k != "hadm_id"} for r in extract.comorbidities(ad, d).collect()}
    assert got == {1: {"congestive_heart_failure", "hypertension"}, 2: {"congestive_heart_failure", "diabetes_complicated"}, 3: {"metastatic_cancer"},
                   4: set(), 5: {"weight_loss"}, 6: set(), 7: {"solid_tumor"}, 8: set()}


def test_code_dimension_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("drug,gsn,ndc\nA,002542,00206886202\n")
    codes = io.read_table(spark, str(tmp_path / "codes.csv"), schema="drug string, gsn string, ndc string")
    rows = spark.createDataFrame([("002542",), ("2542",)], "gsn string")
    assert {r.gsn: r.drug for r in joins.lookup(rows, codes, ["gsn"], ["drug"]).collect()} == {"002542": "A", "2542": None}


def test_lineage_chain_diamond_and_self(spark):
    log = spark.createDataFrame([
        (1, 10, "a", "x", None, 10, "b"), (2, 10, "c", "x", None, 10, "a"), (3, 10, "d", "y", None, 10, "a"), (4, 10, "e", "y", None, 10, "c"),
        (5, 10, "e", "z", None, 10, "d"), (6, 99, "a", "x", None, None, None), (7, 10, "a", "late", None, 10, "zz")],
        "seq long, value_row long, value_col string, change_type string, metadata string, reference_row long, reference_col string")
    rows = spark.createDataFrame([(10,)], "value_row long")
    recs, path = lineage.dependencies(log, rows, ["e"])
    assert sorted(r.seq for r in recs.collect()) == [1, 2, 3, 4, 5]
    assert {(r.query_row, r.query_col) for r in path.collect()} == {(10, "e")}
    assert sorted(r.seq for r in lineage.dependencies(log, rows, ["e"], before=5)[0].collect()) == [1, 2, 4]
    down, _ = lineage.descendants(log, rows, ["b"])
    assert sorted(r.seq for r in down.collect()) == [1, 2, 3, 4, 5]
    assert {r.change_type for r in lineage.change_types(log).collect()} == {"x", "y", "z", "late"}
    coded = lineage.encode_rows(log)
    assert coded.filter("seq = 6").first().value_row == "2R" and lineage.decode_rows(coded).filter("seq = 6").first().value_row == 99


def test_stand_in_times_do_not_depend_on_the_session_zone(spark):
    sf = "/root/testdata/sf0.001"
    a = {r.id: r.t for r in measurements(spark, sf).collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {r.id: r.t for r in measurements(spark, sf).collect()} == a
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

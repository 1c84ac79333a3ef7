"""Readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow import constants as C

ID_COLUMNS = ("hadm_id", "subject_id", "timestep", "icustayid", "itemid")

_FLAGS = ", ".join(f"{c} int" for c in C.COMORBIDITIES)
RAW_TABLES = {
    "abx": "hadm_id long, icustayid long, startdate long, enddate long, gsn string, ndc string, dose_val string, dose_unit string, route string",
    "culture": "subject_id long, hadm_id long, icustayid long, charttime long, itemid long",
    "comorbidities": f"subject_id long, hadm_id long, icustayid long, {_FLAGS}",
    "microbio": "subject_id long, hadm_id long, icustayid long, charttime long, chartdate long, org_itemid long, spec_itemid long, ab_itemid long, interpretation string",
    "demog": "subject_id long, hadm_id long, icustayid long, admittime long, dischtime long, adm_order int, unit int, intime long, outtime long, los double, age int, dob long, dod long, expire_flag boolean, gender int, morta_hosp int, morta_90 int, elixhauser int",
    "ce": "icustayid long, charttime long, itemid long, valuenum double",
    "labs_ce": "icustayid long, charttime long, itemid long, valuenum double",
    "labs_le": "icustayid long, charttime long, itemid long, valuenum double",
    "mechvent": "icustayid long, charttime long, mechvent int, extubated int, selfextubated int",
    "mechvent_pe": "subject_id long, hadm_id long, icustayid long, starttime long, endtime long, mechvent int, extubated int, selfextubated int, itemid long, value double",
    "preadm_fluid": "icustayid long, input_preadm double",
    "fluid_mv": "icustayid long, starttime long, endtime long, itemid long, amount double, rate double, tev double",
    "fluid_cv": "icustayid long, charttime long, itemid long, amount double, tev double",
    "vaso_mv": "icustayid long, itemid long, starttime long, endtime long, ratestd double",
    "vaso_cv": "icustayid long, itemid long, charttime long, ratestd double",
    "preadm_uo": "icustayid long, charttime long, itemid long, value double, datediff_minutes long",
    "uo": "icustayid long, charttime long, itemid long, value double",
    "notes": "subject_id long, hadm_id long, icustayid long, chartdate timestamp, charttime timestamp, category string, text string",
}


#: Characters that are escaped in file names: those Spark escapes in the names of partitions, and the dot that ends the id.
_ESCAPED = r"""[\x01-\x1f"#%'*./:=?\\\x7f{\[\]^]"""


def raw_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(RAW_TABLES[table])


def read_table(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, fmt: str = "csv", need_stay: bool = False) -> DataFrame:
    """Typed read of one or more paths; `need_stay` drops rows without a stay. CSV headers are required."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("nanValue", "NaN")
    df = reader.load(list(paths))
    nan_free = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    df = df.withColumns(nan_free) if nan_free else df
    return df.filter(F.col("icustayid").isNotNull()) if need_stay else df


def read_first(spark: SparkSession, paths: Sequence[str], optional: bool = False, **options) -> DataFrame | None:
    """Read the first path that exists; with `optional` a missing table is None."""
    for p in paths:
        try:
            return read_table(spark, p, **options)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if optional:
        return None
    raise FileNotFoundError(", ".join(paths))


def read_stage_table(spark: SparkSession, directory: str, name: str, fmt: str = "csv", optional: bool = False) -> DataFrame | None:
    """A table of the intermediate stage if it was written, else its raw extract."""
    suffix = ".csv" if fmt == "csv" else ""
    paths = [f"{directory}/intermediates/{name}{suffix}", f"{directory}/raw_data/{name}{suffix}"]
    return read_first(spark, paths, optional, fmt=fmt, schema=raw_schema(name) if name in RAW_TABLES else None)


def read_prefix(spark: SparkSession, directory: str, prefix: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Every file of a directory whose name starts with `prefix`, as one table."""
    return read_table(spark, f"{directory}/{prefix}*", schema=schema, fmt=fmt)


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Name columns by position and cast the id columns to 64-bit integers."""
    out = df.toDF(*names)
    return out.withColumns({c: F.col(c).cast("long") for c in names if c in ID_COLUMNS})


def write_clustered(df: DataFrame, path: str, stay: str, time: str, files: int | None = None) -> None:
    """Write sorted by stay and time, so a reader of some stays skips most row groups."""
    ranged = df.repartitionByRange(files, stay, time) if files else df.repartitionByRange(stay, time)
    ranged.sortWithinPartitions(stay, time).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", records_per_file: int | None = None, short_floats: bool = False) -> None:
    """Write a table; `mode="ignore"` keeps one that is there, `short_floats` prints doubles with six digits."""
    if short_floats:
        df = df.withColumns({
            f.name: short_float(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType)
        })
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    w.save(path)


def short_float(c):
    """Text of a double with at most six significant digits and no trailing zeros."""
    size = F.floor(F.log10(F.abs(c)))
    fixed = F.round(c.cast("decimal(38,12)"), 12)
    digits = F.format_string("%.6g", c)
    plain = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(c.isNotNull(), F.when(c == 0, F.lit("0")).when(size < -12, c.cast("string")).when(fixed == 0, F.lit("0")).otherwise(plain))


def write_split(df: DataFrame, path: str, parts: Mapping[str, Sequence[str]], split: str = "split") -> None:
    """Write raw features, normalised features and metadata, each partitioned by split."""
    for name, columns in parts.items():
        df.select(*columns, split).write.mode("overwrite").partitionBy(split).parquet(f"{path}/{name}")


def cached_table(spark: SparkSession, name: str, build, path: str | None = None) -> DataFrame:
    """A derived table, built and saved on first use, in the warehouse or under `path`."""
    if not spark.catalog.tableExists(name):
        w = build().write
        (w.option("path", path) if path else w).saveAsTable(name)
    return spark.table(name)


def save_model(path: str, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> None:
    """Save the tables of a model and its parameters as text, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if params:
        spark = next(iter(tables.values())).sparkSession
        rows = [(k, str(v)) for k, v in params.items()]
        spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str, tables: Sequence[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    loaded = {t: spark.read.parquet(f"{path}/{t}") for t in tables}
    try:
        params = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}
    except AnalysisException:
        params = {}
    return loaded, params


def _record_pass(path: str, record: str, header: str):
    """Lines sorted by record in, one file a record of the task written; out comes the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        part, open_name, out, files = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            for name, group in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=itemgetter(0)):
                if name != open_name:
                    if out is not None:
                        out.close()
                    file = re.sub(_ESCAPED, lambda m: f"%{ord(m[0]):02X}", name)
                    out, open_name, files = store.open_output_stream(f"{root}/{record}={file}.{part:05d}.csv"), name, files + 1
                    out.write(header.encode())
                out.write("".join(f"{line}\n" for _, line in group).encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def write_records(lines: DataFrame, path: str, record: str = "record", hot: int = 0) -> None:
    """Write `lines` as text with a header, one file `record=<id>.<number>.csv` a record, which its task writes in place; a new folder that pyarrow can open.

    All files are in one folder, which is listed at once. A record of null is named as Spark names such a partition. With a record too large for one task (`hot`) its rows stay
    where they are, in several files. A task that is repeated writes the same files again.
    """
    spark, columns = lines.sparkSession, [c for c in lines.columns if c != record]
    name = F.coalesce(F.nullif(F.col(record).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = lines.select(name.alias(record), F.to_csv(F.struct(*columns)).alias("line"))
    if not hot:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), record)
    where = path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")
    rows.sortWithinPartitions(record).mapInArrow(_record_pass(where, record, ",".join(columns) + "\n"), "files long").agg(F.sum("files")).collect()


def read_records(spark: SparkSession, path: str, record: str = r"([^/.]+)[^/]*$") -> DataFrame:
    """One text file per record with lines `HH:MM,param,value`: `(record, hours, param, value)`.

    `record` finds the record id in the file path; by default it is the file name up to its first dot.
    """
    rows = spark.read.schema("time string, param string, value double").option("header", True).csv(path)
    part = F.split("time", ":")
    return rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), record, 1).alias("record"),
        (part[0].cast("double") + part[1].cast("double") / 60).alias("hours"), "param", "value",
    ).filter(F.col("param") != "RecordID")


def read_sensor_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "record string, tag string, time double, date string, x double, y double, z double, label string"
    return spark.read.schema(schema).csv(path)


def read_outcomes(spark: SparkSession, path: str, label: int = 4) -> DataFrame:
    """Outcome of each record: the `label`-th value after the id, counted from 0."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(rows.columns[0]).alias("record"), F.col(rows.columns[1 + label]).cast("double").alias("label"))

"""Chunked tables with a manifest of what is complete.

A run writes its chunks to a hidden staging folder, counts them, and commits by renaming one
manifest file into place. Only then do the files move to the table, each by a rename. A
run that dies before its commit leaves nothing that counts; one that dies after it is
finished by the next `write` or `finish`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REST = -1
#: Both start with an underscore, so readers of the table do not see them.
MANIFEST, STAGED = "_manifest", "_staged"
RECORD = "run string, chunk long, rows long"


def stay_chunk(stay: str, base: int, step: int, chunks: int | None = None) -> Column:
    """Number of the range a stay id falls in; null ids, ids below `base` and ids beyond `chunks` ranges are in the chunk `REST`."""
    chunk = F.floor((F.col(stay) - base) / step).cast("long")
    inside = chunk >= 0 if chunks is None else (chunk >= 0) & (chunk < chunks)
    return F.when(inside, chunk).otherwise(F.lit(REST).cast("long"))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _names(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Committed chunks: `run`, `chunk` and the number of `rows`."""
    Path, fs = _files(spark, path)
    names = [n for n in _names(fs, Path(f"{path}/{MANIFEST}")) if n.endswith(".json")]
    if not names:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json([f"{path}/{MANIFEST}/{n}" for n in names])


def commit(spark: SparkSession, path: str, run: str, rows: dict[int, int]) -> None:
    """Make a staged run count: its manifest is written aside and renamed."""
    Path, fs = _files(spark, path)
    aside, final = Path(f"{path}/{MANIFEST}/.{run}"), Path(f"{path}/{MANIFEST}/{run}.json")
    out = fs.create(aside, True)
    out.write(bytearray("".join(json.dumps({"run": run, "chunk": c, "rows": n}) + "\n" for c, n in sorted(rows.items())), "utf-8"))
    out.close()
    if not fs.rename(aside, final):
        raise OSError(f"cannot commit {final}")


def finish(spark: SparkSession, path: str) -> None:
    """Move the files of committed runs into the table; runs without a commit stay aside. Safe to repeat."""
    Path, fs = _files(spark, path)
    for run in _names(fs, Path(f"{path}/{STAGED}")):
        if not fs.exists(Path(f"{path}/{MANIFEST}/{run}.json")):
            continue
        staged = f"{path}/{STAGED}/{run}"
        for chunk in [n for n in _names(fs, Path(staged)) if n.startswith("chunk=")]:
            source, target = Path(f"{staged}/{chunk}"), Path(f"{path}/{chunk}")
            fs.mkdirs(target)
            for name in [n for n in _names(fs, source) if n.endswith(".parquet")]:
                if not fs.rename(Path(source, name), Path(target, name)):
                    raise OSError(f"cannot move {name} to {target}")
        fs.delete(Path(staged), True)


def write(
    df: DataFrame, path: str, stay: str, base: int = 0, step: int = 1_000_000, chunks: int | None = None,
    skip_present: bool = False,
) -> dict[int, int]:
    """Write every row by half-open ranges of the stay id, the rest as one more chunk; returns rows per chunk written.

    `skip_present` leaves chunks alone that the manifest lists; else rows are appended. With `chunks` the rows are
    taken as the whole table, and chunks without rows are recorded too, so that they count as present. Rows of a chunk are
    brought together before writing, and large chunks are split again, so files are few and even.
    """
    spark = df.sparkSession
    finish(spark, path)
    done = manifest(spark, path).select("chunk").distinct()
    out = df.withColumn("chunk", stay_chunk(stay, base, step, chunks))
    if skip_present:
        out = out.join(F.broadcast(done) if chunks is not None and chunks < 100_000 else done, "chunk", "left_anti")
    run = uuid.uuid4().hex
    staged = f"{path}/{STAGED}/{run}"
    out.hint("rebalance", "chunk").write.partitionBy("chunk").parquet(staged)
    counts = spark.read.schema(out.schema).parquet(staged).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    rows = {r["chunk"]: r["n"] for r in counts.collect()}
    if chunks is not None:
        kept = {r["chunk"] for r in done.collect()} if skip_present else set()
        rows = {c: 0 for c in [REST, *range(chunks)] if c not in kept} | rows
    commit(spark, path, run, rows)
    finish(spark, path)
    return rows


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all committed chunks; an error if files and manifest do not agree."""
    finish(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = reader.parquet(path).withColumn("chunk", F.col("chunk").cast("long"))
    listed = manifest(spark, path).filter("rows > 0").groupBy("chunk").agg(F.sum("rows").alias("listed"))
    found = out.groupBy("chunk").agg(F.count(F.lit(1)).alias("found"))
    odd = listed.join(found, "chunk", "full").filter(~F.col("listed").eqNullSafe(F.col("found"))).head(1)
    if odd:
        raise ValueError(f"chunk {odd[0]['chunk']}: {odd[0]['found']} rows, the manifest has {odd[0]['listed']}")
    return out

"""Session defaults, lineage cutting and table loading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_HOT_ROWS = 2_000_000
#: Scratch folders of this process.
SCRATCH: list[str] = []


def build_session(master: str | None = None, app: str = "careflow", **conf: str) -> SparkSession:
    """Session with the settings the operators expect; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold before the key is split."""
    return int(spark.conf.get("spark.careflow.hotRows", str(DEFAULT_HOT_ROWS)))


def spread(df: DataFrame) -> DataFrame:
    """Deal few or lopsided partitions over the shuffle partitions before a step that costs much more CPU than a shuffle of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in `spark.checkpoint.dir`. Only a local session without that setting gets a temporary folder, which is removed at exit."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="careflow-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage every executor can reach."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process has written to scratch folders; results that still read them are lost."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a result as a table on shared storage and read it back.

    It survives executor loss and stops plans growing in loops. A table rather than a
    row checkpoint: it is columnar, later readers take only the columns they use, and
    its true size is known to the optimiser (a checkpoint keeps the estimate of its
    old plan, which multiplies with every self-join of a loop).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")

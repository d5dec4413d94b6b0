"""Session defaults and the lineage cut used by iterative operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "lumenlake", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: `spark.checkpoint.dir` of the session.

    Only a local master may fall back to a temporary folder, because there the
    driver and all tasks share one disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="lumenlake-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder now and continue from there.

    A lost executor then costs a re-read, not a recomputation, and a plan whose
    row order or partition ids matter is evaluated exactly once.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """(`df` as read back from a new table in the checkpoint folder, its path).

    For loops: unlike a checkpoint the table carries no constraints of earlier
    rounds into the next plan, and it can be dropped once a round is over. `options`
    are those of the Parquet writer; long texts take least disk with `compression="zstd"`.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of `write_table`."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def held_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which go back to what they were."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# The shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package as a zip, whatever folder and master the driver runs in."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenlake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lumenlake"), "zip", root, "lumenlake"))
    sc._lumenlake_shipped = True

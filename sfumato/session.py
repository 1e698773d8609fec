"""Session settings and the places for lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started.

    Nothing is done where the workers' PYTHONPATH has it.  On one machine they are told the path; executors elsewhere get the
    package as an archive from the driver.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_sfumato_shipped", False):
        return
    if sc.master == "local" or sc.master.startswith("local["):
        known = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in known:
            sc.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    else:
        folder = tempfile.mkdtemp(prefix="sfumato-package-")
        sc.addPyFile(shutil.make_archive(f"{folder}/sfumato", "zip", root, "sfumato"))
    sc._sfumato_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that long lineages survive the loss of executors.

    The folder is that of the session (see shared_folder).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on one machine, where that is unset, a temporary folder.  A cluster must name one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="sfumato-checkpoint-")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

"""Session settings shared by the library, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    ``master`` is only for local runs; on a cluster spark-submit supplies it.
    """
    builder = SparkSession.builder.appName("gustline")
    if master:
        builder = (builder.master(master)
                   .config("spark.driver.memory", os.environ.get("GUSTLINE_DRIVER_MEMORY", "8g"))
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.sql.shuffle.partitions", "8"))
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # wide aggregates (Gram sums) stay in generated code longer
        "spark.sql.codegen.aggregate.splitAggregateFunc.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once; they may start in any folder."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gustline-package-"), "gustline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(at, name)
                    out.write(file, os.path.join(os.path.basename(folder), os.path.relpath(file, folder)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)


_LOCAL_BASE: list[str] = []


def _shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _LOCAL_BASE:     # tests on one machine
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="gustline-"))
    return _LOCAL_BASE[0]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``."""
    return f"{_shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` work, in the folder the session names."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_shared_base(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read several times, and continue from the written one.

    The steps after it start from a plain scan: nothing before is planned or computed again,
    also not when an executor is lost.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

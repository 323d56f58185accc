"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Wide projections compile to methods beyond the 8000 bytecodes the JVM is willing to
# optimise; below this limit Spark splits them instead of fusing the whole stage.
JIT_LIMIT = "8000"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, whatever the driver's working directory."""
    context = spark.sparkContext
    if getattr(context, "_veilframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # read by the driver's own file server, so a driver-local folder will do
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="veilframe-code-")), "veilframe.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    context._veilframe_shipped = True


def tune(spark: SparkSession) -> None:
    """Session settings the operators count on, for sessions built elsewhere.

    UTC for rotation windows, budget clocks and day partitions.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)


def build_session(app: str = "veilframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on.

    Time zone UTC (budget clocks and rotation windows are UTC) and adaptive
    execution with skew-join handling. Cluster sizing is left to the caller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": JIT_LIMIT,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only used when Spark itself runs in this one
    process (``local[...]`` master); on a cluster the setting is required,
    because an executor's local disk is gone when the executor is lost.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is deleted."""
    return f"{shared_dir(spark)}/veilframe/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    The partitions of the result are the partitions that were written, which
    is what makes partition-relative positions stable across later jobs.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    return df.checkpoint(eager=True)

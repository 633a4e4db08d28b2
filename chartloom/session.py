"""Sessions, input tables and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "chartloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed for them."""
    package = Path(__file__).resolve().parent
    root, context = str(package.parent), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_chartloom_shipped", False):
        return
    if context.master.startswith("local["):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, context.environment.get("PYTHONPATH")]))
    else:
        archive = Path(tempfile.mkdtemp(), "chartloom_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))  # Spark copies it to every executor
    context._chartloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_ready(spark: SparkSession) -> None:
    """Uses the shared folder of spark.checkpoint.dir. Only where it is unset, as in tests, one is made, which ends with the program."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"chartloom-checkpoint-{os.getpid()}")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so a lost executor costs nothing.

    A session with spark.cleaner.referenceTracking.cleanCheckpoints removes what is no longer referred to; local_session sets it.
    """
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that is written and read again."""
    _checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

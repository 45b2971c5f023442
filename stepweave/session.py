"""Sessions and what Python workers need of the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this package on its Python workers' path where they see the driver's files. Elsewhere it is
    installed or sent with --py-files."""
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{have}".rstrip(":")
    return spark


def local_session(name: str = "stepweave", cores: str = "8", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.driver.memory": "4g",
    } | conf
    return ready(SparkSession.builder.appName(name).master(f"local[{cores}]").config(map=settings).getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir, which all executors share. On one machine, where that may be
    unset (tests), a temporary one that ends with the process; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="stepweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes what this application left in the shared folder. Frames that read from there are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed and kept in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()

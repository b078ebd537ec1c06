"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application: their Python workers unpickle functions by its name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(here, f"{top}/tree/{os.path.basename(here)}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{top}/{os.path.basename(here)}", "zip", f"{top}/tree")
        kept = f"{tempfile.mkdtemp(prefix='ancestra-')}/{os.path.basename(archive)}"  # the driver serves it to executors as long as it lives
        shutil.move(archive, kept)
    spark.sparkContext.addPyFile(kept)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where neither that setting nor a
    checkpoint folder is present is a temporary folder made, and only on a local master; on
    a cluster executors would each write to their own disks, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ancestra-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("ancestra").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

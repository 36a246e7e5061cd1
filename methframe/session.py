"""Session settings, table access and the places where lineage is cut."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that only matter for speed on one machine; a cluster sets its own.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions)
    for key, value in (LOCAL | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that can't import it from where they run; once a context. Whatever sends Python code to workers calls this."""
    sc = spark.sparkContext
    if getattr(sc, "_methframe_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="methframe-")) / "methframe.zip"  # read by the driver's own file server
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._methframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped() -> None:
    """``ship`` for expressions, which know no session."""
    if spark := SparkSession.getActiveSession():
        ship(spark)


def partitions_of(spark: SparkSession) -> int:
    ship(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder is the one in ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine, as in tests, a
    temporary folder is used; elsewhere that is an error. ``localCheckpoint`` is never used: its single copy dies with an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    ship(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="methframe-"))
    return df.checkpoint()

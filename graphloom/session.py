"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark's file server, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not if it already runs from an archive
        target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"graphloom/{f.relative_to(root)}")
        sc.addPyFile(str(target))
    sc._graphloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Where it is unset a local master (tests, a laptop) gets a temporary folder; on a cluster that is an error, as
    every machine would write to its own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders that ``cut`` has written and that still stand, by the DataFrame that reads them.
_WRITTEN = "_graphloom_path"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder as Parquet and read back: a plan starts anew, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    setattr(back, _WRITTEN, path)
    return back


def forget(*written: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for these tables, once nothing that is still to run reads them."""
    for df in written:
        path = getattr(df, _WRITTEN, None)
        if path is not None:
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
            setattr(df, _WRITTEN, None)

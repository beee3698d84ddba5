"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Lookup tables (units, zones, offices, targets) that are turned into Python dictionaries must stay under this many rows.
MAX_LOOKUP_ROWS = 100_000


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lekhya") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEKHYA_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per context, so that they need no path to it of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_lekhya_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lekhya-")) / "lekhya.zip"  # read by the driver only, which serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lekhya_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, columns pruned by whatever is selected later."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. A temporary one only on a local master; elsewhere its lack is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and existing.isDefined():
        return existing.get()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lekhya-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not existing.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder, deleted when the session ends or, unless it is to be kept till then, by `release`."""
    path = f"{shared_dir(spark).rstrip('/')}/lekhya-{label}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    sc = spark.sparkContext
    if not keep:
        sc._lekhya_paths = [*getattr(sc, "_lekhya_paths", []), path]
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors. See `release`."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all intermediate results so far; call it when the results built on them are written. The number of folders deleted."""
    paths = getattr(spark.sparkContext, "_lekhya_paths", [])
    for path in paths:
        fs, p = _path(spark, path)
        fs.delete(p, True)
    spark.sparkContext._lekhya_paths = []
    return len(paths)


def lookup_rows(df: DataFrame, limit: int = MAX_LOOKUP_ROWS) -> list:
    """Rows of a small lookup table; refuses anything that could grow with the data."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"lookup table has more than {limit} rows")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is heavy per row; scans that are wide enough stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def nonempty(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A batch function that passes on only results with rows: the column types of empty frames are not to be relied on."""

    @wraps(f)
    def run(batches: Iterator[pd.DataFrame], *args) -> Iterator[pd.DataFrame]:
        for out in f((b for b in batches if len(b)), *args):
            if len(out):
                yield out

    return run

"""What every operator needs of the cluster: workers that find this package, and tables that outlive executors."""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows for a task that holds all it reads, such as one that drops repeated rows: some 100 bytes each, twice.
ROWS = 500_000
_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, unless PYTHONPATH already leads to it."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import tempfile

    at = Path(tempfile.mkdtemp()) / "latticework.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in (_ROOT / "latticework").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir, or a local one where it is unset and all runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="latticework-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by hash of keys, in so many partitions that each has about ROWS of its rows (rows: how many there are at most).

    Adaptive execution sizes partitions by compressed bytes and up to the number of shuffle partitions only; it leaves these
    as they are.  Where the cores alone make tasks that small, df is returned as it is.
    """
    n = -(-rows // ROWS)
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/latticework-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete every table that this application stored; for when none of its DataFrames is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""What depends on the session: the package on the workers, the shared folder, the cores."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20  # what a core reads of a table that is large enough
ROOT = Path(__file__).resolve().parent.parent

_tables: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless PYTHONPATH names its folder there already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quernstone_shipped", False):
        return
    archive = os.path.realpath(os.path.join(tempfile.mkdtemp(), "quernstone.zip"))
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "quernstone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(archive)
    context._quernstone_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new folder name in spark.checkpoint.dir, which all machines share. Only a session in one process may do without.

    What is written there is deleted when the driver ends, or by release() before.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{folder.rstrip('/')}/quernstone-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(release)
    _tables.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return that table: its lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete what was written to scratch folders, the tables of cut() among them; frames that still read them can't be used any more."""
    while _tables:
        try:
            delete(*_tables.pop())
        except Exception:  # the session has ended
            return


#: Rows (of a few hundred bytes at most) up to which a written table is broadcast.
BROADCAST_ROWS = 200_000
#: The same for rows of a word and a number or two: some ten MB for a million.
NARROW_ROWS = 2_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, a table that is cheap to count, with a broadcast hint if it has at most `limit` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df itself; an input too small to have a split for every core is first shuffled, by keys if there are any."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SPLIT_BYTES:
        return df
    return df.repartition(*keys) if keys else df.repartition(cores)

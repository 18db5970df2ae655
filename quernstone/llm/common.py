"""What the operators share: table reading, written intermediate tables, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few dozen bytes each) up to which a counted table may be broadcast.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str, int]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session in one process, as in tests, may do without and gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return that table.

    The lineage ends there, so a lost executor costs no recomputation, and rows, ids and range
    boundaries stay as they are however often the result is read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quernstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """cut(make()), after which the tables that make wrote on its way are deleted."""
    began = len(_written)
    result = cut(make())
    own = [x for x in _written[began:-1] if x[2] == threading.get_ident()]
    for entry in own:
        _written.remove(entry)
        _delete(*entry[:2])
    return result


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete the intermediate tables; frames that still read them can't be used any more. Called as the driver ends;
    a long session may call it when it has written its results."""
    while _written:
        spark, path, _ = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its driver is gone
            return


def fresh(name: str, columns: Collection[str]) -> str:
    """name, with underscores after it until no column is called that (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; beyond that the join shuffles.

    df should be cheap to count: a written table or a short aggregate.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def shuffles(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))

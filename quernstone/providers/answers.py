"""Answers of language models kept in a table by what was asked, so that a job that stops, or runs again, asks nothing twice.

The table is a folder of Parquet files, in a place that all machines share: sha (of the model's name and the prompt), answer,
error, tries. A run asks the prompts that have no answer there, each once however often it is in the data; tasks write what they have got
every few calls and when they fail, and files appear whole or not at all.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from .clients import GENERATIVE, Client, rendered

STORE = "sha string, answer string, error string, tries int"
_ARROW = pa.schema([("sha", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("tries", pa.int32())])
#: Calls between two writes of a task, tries of a call, seconds before the second try (doubled each time), letters kept of an error.
EACH, TRIES, WAIT_S, ERROR_CHARS = 20, 3, 1.0, 500


def address(prompt: Column | str, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n"), col(prompt)).cast("binary"), 256)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """sha, answer, error, tries: one row for each prompt that was ever asked, an answer before an error, fewest tries first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORE)
    rows = spark.read.schema(STORE).parquet(store)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "tries", "answer", "error"))
    return rows.groupBy("sha").agg(best.alias("r")).select("sha", "r.answer", "r.error", "r.tries")


def _ask(client: Client, prompt: str, tries: int, wait: float) -> tuple[str | None, str | None, int]:
    for i in range(1, tries + 1):
        try:
            return client.generate(prompt), None, i
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        if i < tries:
            time.sleep(wait * 2 ** (i - 1))
    return None, error, tries


def ask(prompts: DataFrame, client: Client, store: str, parallel: int = 8, calls_a_second: float | None = None, each: int = EACH, tries: int = TRIES, wait: float = WAIT_S) -> int:
    """Ask (sha, prompt) rows that have no answer in the store, failed ones again; the number of prompts asked now.

    At most `parallel` tasks ask at a time, each at most calls_a_second / parallel times a second, so the whole job keeps the limit.
    A task that Spark repeats reads first what its earlier attempts wrote; one that is killed loses `each` - 1 answers at most.
    """
    spark = prompts.sparkSession
    done = stored(spark, store).where(F.col("error").isNull()).select("sha")
    open_ = prompts.select("sha", "prompt").dropDuplicates(["sha"]).join(done, "sha", "left_anti").repartition(parallel, "sha")
    run, pause = uuid.uuid4().hex, parallel / calls_a_second if calls_a_second else 0.0
    where = store if "://" in store or store.startswith("file:") else os.path.abspath(store)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(where)
        mine = f"part-{run}-{TaskContext.get().partitionId():05d}-"
        files.create_dir(folder, recursive=True)
        known: set[str] = set()  # of this partition and run only
        for f in files.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(mine):
                with files.open_input_file(f.path) as opened:
                    known.update(pq.read_table(opened, columns=["sha"])["sha"].to_pylist())
        held: list[tuple] = []
        asked, after = 0, 0.0

        def write() -> None:
            if held:
                name = f"{uuid.uuid4().hex}.parquet"
                rows = pa.Table.from_pylist([dict(zip(_ARROW.names, r)) for r in held], _ARROW)
                with files.open_output_stream(f"{folder}/_{mine}{name}") as out:
                    pq.write_table(rows, out)
                files.move(f"{folder}/_{mine}{name}", f"{folder}/{mine}{name}")
                held.clear()

        try:
            for batch in batches:
                for sha, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if sha in known:
                        continue
                    time.sleep(max(0.0, after - time.monotonic()))
                    after = time.monotonic() + pause
                    held.append((sha, *_ask(client, prompt, tries, wait)))
                    asked += 1
                    if len(held) >= each:
                        write()
        finally:
            write()
        yield pa.RecordBatch.from_pydict({"asked": pa.array([asked], pa.int64())})

    return open_.mapInArrow(answer, "asked long").agg(F.sum("asked")).first()[0] or 0


def answered(df: DataFrame, task: str, client: Client, store: str, model: str = "", text: str = "text", out: str | None = None, context: str = "", **limits) -> DataFrame:
    """df with the answers to a generating task's prompts and `<out>_error`, the reason where there is none.

    Only prompts without an answer in the store are asked (see `ask` for limits); `model` keeps the answers of different models apart.
    Null texts are asked as empty ones; repeated rows share one answer and stay.
    """
    out = out or GENERATIVE[task].output
    if {out, f"{out}_error"} & set(df.columns):
        raise ValueError(f"{out} is a column already")
    prompt = rendered(task, text, context)
    ask(df.select(address(prompt, model).alias("sha"), prompt.alias("prompt")), client, store, **limits)
    rows = df.select(F.struct(*df.columns).alias("row"), address(prompt, model).alias("sha"))
    told = stored(df.sparkSession, store).select("sha", F.col("answer").alias("answer"), F.col("error").alias("error"))
    return rows.join(told, "sha", "left").select("row.*", F.col("answer").alias(out), F.col("error").alias(f"{out}_error"))

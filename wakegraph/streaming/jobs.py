"""Job logs and states as streams: ring buffers, state machines, expiry and staged writes.

A stream of lines has job_id, seq, at, stream, text; a stream of state changes has job_id, seq, status.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakegraph.session import shared_dir

# The states of a job and which of them are final.
STATUS = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED")
BUFFER = 2000


def table_stream(spark: SparkSession, base: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a table as a stream."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(base)


def last_lines(lines: DataFrame, n: int = BUFFER) -> DataFrame:
    """(job_id, total, texts): after each batch the last n lines of every job that got new ones, and how many it had.

    Update mode. The state of a job is its buffer of n lines, whatever the log's length.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, seqs, texts = state.get if state.exists else (0, [], [])
        rows = list(zip(seqs, texts))
        for b in batches:
            total += len(b)
            rows = sorted([*rows, *zip(b["seq"], b["text"])], key=lambda r: r[0])[-n:]
        state.update((int(total), [int(s) for s, _ in rows], [t for _, t in rows]))
        yield pd.DataFrame({"job_id": [key[0]], "total": [total], "texts": [[t for _, t in rows]]})

    kind = lines.schema["job_id"].dataType.simpleString()
    return lines.select("job_id", "seq", "text").groupBy("job_id").applyInPandasWithState(
        step, f"job_id {kind}, total long, texts array<string>", "total long, seqs array<long>, texts array<string>", "update", GroupStateTimeout.NoTimeout
    )


def states(changes: DataFrame) -> DataFrame:
    """(job_id, status, n_changes): after each batch the state of every job that changed.

    PENDING, RUNNING, then one final state; a change that would leave a final state, or go back, is not taken but
    counted. Changes of a batch are taken by seq. Update mode.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("PENDING", 0)
        rows = sorted((r for b in batches for r in zip(b["seq"], b["status"])), key=lambda r: r[0])
        for _, new in rows:
            n += 1
            if status not in TERMINAL and new in STATUS and STATUS.index(new) > STATUS.index(status):
                status = new
        state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_changes": [n]})

    kind = changes.schema["job_id"].dataType.simpleString()
    return changes.select("job_id", "seq", "status").groupBy("job_id").applyInPandasWithState(
        step, f"job_id {kind}, status string, n_changes long", "status string, n long", "update", GroupStateTimeout.NoTimeout
    )


def latest(changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, n): the value of greatest order so far, and the number of rows. Update mode; state is one row a key."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value), F.count(F.lit(1)).alias("n"))


def expiring(events: DataFrame, at: str, key: str, ttl: str) -> DataFrame:
    """(window_start, key, n) over windows of the length ttl; a window's state goes once the watermark has passed it.

    Rows later than ttl behind the newest are dropped, which is the operator's rule. Append mode.
    """
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", ttl)
    return timed.groupBy(F.window("__at", ttl).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def drain(df: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Runs a streaming query over all that is there and gives its output: every row that it put out, with `batch`."""
    spark = df.sparkSession
    folder = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is written again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = df.schema.add("batch", "long")
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def upsert_sink(merge: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that merges each batch into a table kept in numbered versions below folder.

    The version of batch n is made of that of the batch before, so that a batch that runs again gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/v={number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return write


def sequenced(lines: DataFrame, at: str) -> DataFrame:
    """lines with seq: their number within their job, from 0 on, by the column at."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(at)) - 1
    return lines.withColumn("seq", n.cast("long"))


def replay(numbered: DataFrame, after: int) -> DataFrame:
    """What one who has seen the first `after` lines of every job has not seen yet; the same lines go on as a stream of greater seq."""
    return numbered.where(F.col("seq") >= after)


class Watchdog(StreamingQueryListener):
    """Tells of the progress of the session's streams: tell(rows so far, rows a second, percent of total or None)."""

    def __init__(self, tell: Callable[[int, float, float | None], None], total: int | None = None):
        self.tell, self.total, self.rows = tell, total, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.tell(self.rows, p.processedRowsPerSecond, 100.0 * self.rows / self.total if self.total else None)

    def onQueryIdle(self, event) -> None:
        self.tell(self.rows, 0.0, 100.0 * self.rows / self.total if self.total else None)

    def onQueryTerminated(self, event) -> None:
        pass


def watched(df: DataFrame, total: int) -> DataFrame:
    """(n_done, percent) of a stream that has run over all that is there, by the progress it reported."""
    query = df.writeStream.format("noop").option("checkpointLocation", f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    done = sum(p.numInputRows for p in query.recentProgress)
    return df.sparkSession.createDataFrame([(done, 100.0 * done / total if total else 100.0)], "n_done long, percent double")

"""Streams over result and corpus arrivals.

Every sink is a checkpointed file table: progress and results survive a restart, and nothing is
gathered on the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from corpuseval.operators.runs import pending_items

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def corpus_stream(
    spark: SparkSession,
    root: str,
    schema: T.StructType | None = None,
    source: str = "parquet",
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New files below ``root``. ``binaryFile`` has a fixed schema; its content column is dropped."""
    reader = spark.readStream.format(source)
    if source == "binaryFile":
        reader = reader.schema(BINARY_FILE).option("recursiveFileLookup", "true")
    elif schema is not None:
        reader = reader.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    arrived = reader.load(root)
    return arrived.drop("content") if source == "binaryFile" else arrived


def progress_stream(sdf: DataFrame, keys: Sequence[str] = ("run_id", "status")) -> DataFrame:
    """Running counts per key; state holds one row per key."""
    return sdf.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def write_progress(counts: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Store the changed counts of every micro-batch under its batch id.

    A replayed batch overwrites its own folder, so a retry cannot count twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)


def read_progress(spark: SparkSession, target: str, keys: Sequence[str] = ("run_id", "status")) -> DataFrame:
    """Latest values per key from the stored changes."""
    changes = spark.read.parquet(target)
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row"))
    return newest.select(*keys, "_row.*")


def write_counts(
    sdf: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("run_id", "status"), every: int = 16
) -> DataStreamWriter:
    """Counts per key of an unbounded stream, without state and in a table of bounded size.

    Counts add up, so a micro-batch stores only its own: no state is held, late rows count like others, and a run that has
    ended costs nothing but its rows in the table. Batch b takes slot ``b % (2 * every)`` in place of the batch before in it.
    Every ``every`` batches the counts since the last snapshot are added to it and stored in the older of two snapshot slots.
    A replayed batch finds the snapshot before its own and all batches since then unchanged and stores the same rows anew.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, turn = batch.sparkSession, batch_id // every

        def stamped(counts: DataFrame) -> DataFrame:
            return counts.select(*keys, "n", F.lit(batch_id).cast("long").alias("upto"), F.lit(turn).cast("long").alias("turn"))

        counted = stamped(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        counted.write.mode("overwrite").parquet(f"{target}/changes/slot={batch_id % (2 * every)}")
        if batch_id % every == every - 1:
            stored = spark.read.schema(counted.schema)
            since = [f"{target}/changes/slot={b % (2 * every)}" for b in range(turn * every, batch_id + 1)]
            rows = stored.parquet(*since)
            if turn:
                rows = rows.unionByName(stored.parquet(f"{target}/snapshot/slot={(turn - 1) % 2}"))
            total = stamped(rows.groupBy(*keys).agg(F.sum("n").alias("n")))
            total.write.mode("overwrite").parquet(f"{target}/snapshot/slot={turn % 2}")

    return sdf.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)


def read_counts(spark: SparkSession, target: str, keys: Sequence[str] = ("run_id", "status")) -> DataFrame:
    """Counts per key: the older snapshot and the batches after it, all of which are still there.

    The newer snapshot may just be in the making, so it is not read, nor is the very first while it is the only one. What a
    reader sees of a batch in the making may be a part of it.
    """
    changes = spark.read.parquet(f"{target}/changes").drop("slot")
    try:
        snapshots = spark.read.schema(changes.schema).parquet(f"{target}/snapshot").drop("slot")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return changes.groupBy(*keys).agg(F.sum("n").alias("n"))
    older, newer, upto = snapshots.agg(F.min("turn"), F.max("turn"), F.min("upto")).first()
    if newer:
        changes = changes.filter(F.col("upto") > upto).unionByName(snapshots.filter(F.col("turn") == older))
    return changes.groupBy(*keys).agg(F.sum("n").alias("n"))


def append_stream(
    sdf: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str] = ("run_id", "item_id"),
    ts: str = "ts",
    lateness: str = "1 day",
) -> DataStreamWriter:
    """Append each result once: duplicates of a key within ``lateness`` are dropped.

    State is bounded by the watermark; the file sink commits a batch exactly once.
    """
    unique = (
        sdf.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, lateness)
        .dropDuplicatesWithinWatermark(list(keys))
    )
    return (
        unique.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )


def pending_stream(
    items: DataFrame, results_path: str, target: str, checkpoint: str, key: str = "item_id"
) -> DataStreamWriter:
    """Arriving items without a stored result, read anew for every micro-batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        results = batch.sparkSession.read.parquet(results_path)
        pending = pending_items(batch, results, key)
        pending.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)


def windowed_status(
    sdf: DataFrame,
    ts: str = "ts",
    size: str = "1 day",
    slide: str | None = None,
    session_gap: str | None = None,
    lateness: str = "1 hour",
    keys: Sequence[str] = ("status",),
    latency: str = "latency_ms",
) -> DataFrame:
    """Counts and latency per status in tumbling, sliding or session windows.

    Works on batch and streaming input; the watermark only matters for the latter. ``ts`` is cast
    because a watermark needs an instant, not a wall-clock timestamp.
    """
    timed = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    if session_gap:
        frame = F.session_window(ts, session_gap)
    elif slide:
        frame = F.window(ts, size, slide)
    else:
        frame = F.window(ts, size)
    grouped = timed.groupBy(frame.alias("frame"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(latency), 6).alias("mean_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
    )
    return grouped.select(
        F.col("frame.start").alias("window_start"),
        F.col("frame.end").alias("window_end"),
        *keys,
        "n",
        "mean_latency_ms",
        "max_latency_ms",
    )


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that has arrived, then stop; a restart continues from the checkpoint."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Rows that queries dropped behind their watermark, batch by batch.

    A query's own progress reports reach back 100 batches only; the listener hears of every batch. A replayed batch replaces
    its count, and batches without late rows leave no entry. A windowed aggregate combines the rows of a window and key in a
    task before it looks at the watermark, so there a count is one of such combined rows.

    Add it before the query starts: ``spark.streams.addListener(late := LateRows())``.
    """

    def __init__(self) -> None:
        self.counts: dict[str, dict[int, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        if dropped:
            self.counts.setdefault(str(progress.id), {})[progress.batchId] = dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def total(self, query: StreamingQuery, wait: float = 30.0) -> int:
        """Late rows of a query that has ended; reports arrive behind the query, so its end is awaited."""
        until = time.monotonic() + wait
        while str(query.id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return sum(self.counts.get(str(query.id), {}).values())

    def write(self, spark: SparkSession, query: StreamingQuery, target: str) -> None:
        """Store query_id, batch_id, late_rows next to the progress table; a batch stored before is stored anew."""
        rows = [(str(query.id), batch, n) for batch, n in self.counts.get(str(query.id), {}).items()]
        frame = spark.createDataFrame(rows, "query_id string, batch_id long, late_rows long")
        frame.write.mode("overwrite").parquet(f"{target}/query={query.id}")


def late_rows(query: StreamingQuery, listener: LateRows | None = None) -> int:
    """Rows the query dropped behind its watermark; without a listener those of its last 100 batches only."""
    if listener is not None:
        return listener.total(query)
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for report in query.recentProgress
        for operator in report["stateOperators"]
    )


def append_sessions(sessions: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Append every session of ``windowed_status(session_gap=...)`` once it is closed by the watermark."""
    return (
        sessions.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F, types as T

from conftest import rows
from corpuseval import streaming as st
from corpuseval.streaming import progress

SCHEMA = "run_id string, item_id long, status string, latency_ms double, ts timestamp_ntz"
START = datetime(2026, 1, 1)


def land(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def arrivals(spark, folder, **kwargs):
    return st.corpus_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, **kwargs)


def row(i, status="restored", minutes=0, run="r"):
    return (run, i, status, float(i), START + timedelta(minutes=minutes))


def test_progress_continues_after_a_restart(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    land(spark, source, [row(1), row(2), row(3, "no_mask")])
    for extra in ([], [row(4), row(5, "error")]):
        if extra:
            land(spark, source, extra)
        st.run_available(st.write_progress(st.progress_stream(arrivals(spark, source)), target, checkpoint))
    assert rows(st.read_progress(spark, target)) == [("r", "error", 1), ("r", "no_mask", 1), ("r", "restored", 3)]


def test_append_once_over_restarts(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in ([row(1), row(1), row(2)], [row(2, minutes=1), row(3, minutes=2)]):
        land(spark, source, part)
        st.run_available(st.append_stream(arrivals(spark, source), target, checkpoint))
    assert rows(spark.read.parquet(target), "item_id") == [(1,), (2,), (3,)]


def test_pending_reads_current_results(spark, tmp_path):
    source, results, target, checkpoint = (str(tmp_path / n) for n in ("in", "done", "out", "ck"))
    land(spark, source, [row(1), row(2), row(3)])
    spark.createDataFrame([(2,)], "item_id long").write.parquet(results)
    st.run_available(st.pending_stream(arrivals(spark, source), results, target, checkpoint))
    spark.createDataFrame([(4,)], "item_id long").write.mode("append").parquet(results)
    land(spark, source, [row(4), row(5)])
    st.run_available(st.pending_stream(arrivals(spark, source), results, target, checkpoint))
    assert rows(spark.read.parquet(target), "item_id") == [(1,), (3,), (5,)]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    dropped = 0
    for part in ([row(1, minutes=0), row(2, minutes=600)], [row(3, minutes=700), row(4, minutes=1)]):
        land(spark, source, part)
        windows = st.windowed_status(arrivals(spark, source), size="1 hour", lateness="10 minutes")
        writer = (
            windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .format("parquet").option("path", str(tmp_path / "out"))
        )
        dropped += st.late_rows(st.run_available(writer))
    assert dropped == 1
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert rows(closed.select(F.hour("window_start").alias("h"), "n")) == [(0, 1), (10, 1)]


def test_session_windows_match_the_batch(spark, tmp_path):
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "ck", "out"))
    data = [row(i, minutes=m) for i, m in enumerate([0, 3, 20, 22, 500])]
    land(spark, source, data)
    windows = st.windowed_status(arrivals(spark, source), session_gap="5 minutes", lateness="1 minute")
    st.run_available(
        windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out)
    )
    batch = st.windowed_status(spark.createDataFrame(data, SCHEMA), session_gap="5 minutes")
    assert rows(batch, "n") == [(1,), (2,), (2,)]
    assert rows(spark.read.parquet(out), "n") == [(2,), (2,)]  # the last session is still open


def test_binary_arrivals_have_no_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"x")
    stream = st.corpus_stream(spark, str(tmp_path / "in"), source="binaryFile")
    assert stream.isStreaming and "content" not in stream.columns


def test_late_rows_of_many_batches(spark, tmp_path):
    """112 micro-batches; every tenth brings one row far behind the watermark and one that is in time."""
    source = tmp_path / "in"
    source.mkdir()
    late = 0
    for k in range(112):
        lines = [{"run_id": "r", "item_id": f"i{k}", "ts": f"2024-01-01 {k // 10:02d}:{k % 10:02d}:00"}]
        if k and k % 10 == 0:
            lines.append({"run_id": "r", "item_id": f"late{k}", "ts": "2020-01-01 00:00:00"})
            late += 1
        path = source / f"{k:03d}.json"
        path.write_text("\n".join(json.dumps(x) for x in lines))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    listener = progress.LateRows()
    spark.streams.addListener(listener)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        rows_in = progress.corpus_stream(
            spark, str(source), T.StructType.fromDDL("run_id string, item_id string, ts timestamp"), source="json", files_per_trigger=1
        )
        writer = progress.append_stream(rows_in, str(tmp_path / "out"), str(tmp_path / "check"), lateness="1 minute")
        query = progress.run_available(writer)
        assert progress.late_rows(query, listener) == late
        assert spark.read.parquet(str(tmp_path / "out")).count() == 112
        listener.write(spark, query, str(tmp_path / "late"))
        stored = spark.read.parquet(str(tmp_path / "late"))
        assert stored.agg(F.sum("late_rows"), F.count_distinct("batch_id")).first()[:] == (late, late)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.streams.removeListener(listener)


def test_counts_of_many_batches_stay_bounded(spark, tmp_path):
    """50 micro-batches over four restarts, runs that end, late rows; folders and stored rows do not grow with the batches."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    os.makedirs(source)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    schema = T.StructType.fromDDL("run_id string, status string")
    want, stored = {}, []
    try:
        for first, last in ((0, 3), (3, 21), (21, 40), (40, 50)):
            for k in range(first, last):
                lines = [{"run_id": f"run{k // 20}", "status": "ok"}, {"run_id": "run0", "status": "late"}, {"status": "ok"}]
                for x in lines:
                    key = (x.get("run_id"), x["status"])
                    want[key] = want.get(key, 0) + 1
                path = os.path.join(source, f"{k:03d}.json")
                with open(path, "w") as f:
                    f.write("\n".join(json.dumps(x) for x in lines))
                os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
            arriving = st.corpus_stream(spark, source, schema, source="json", files_per_trigger=1)
            query = st.run_available(st.write_counts(arriving, target, checkpoint, every=4))
            assert not query.lastProgress["stateOperators"]
            got = {(r.run_id, r.status): r.n for r in st.read_counts(spark, target).collect()}
            assert got == want
            stored.append(len(os.listdir(f"{target}/changes")))
        assert stored == [3, 8, 8, 8] and len(os.listdir(f"{target}/snapshot")) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_counts_of_a_replayed_batch(spark, tmp_path):
    """A batch that comes again after its snapshot was stored adds nothing; an empty stream gives no rows."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    stores = []

    class Writer:
        outputMode = option = lambda self, *args: self

        def foreachBatch(self, store):
            stores.append(store)

    class Stream:
        writeStream = Writer()

    progress.write_counts(Stream(), target, source, every=2)
    batch = spark.createDataFrame([("r", "ok")], "run_id string, status string")
    stores[0](batch.limit(0), 0)
    assert rows(st.read_counts(spark, target)) == []
    for b in (1, 1, 2, 3, 3, 4, 5, 5, 5):
        stores[0](batch, b)
    assert rows(st.read_counts(spark, target)) == [("r", "ok", 5)]

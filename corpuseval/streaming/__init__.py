"""Incremental jobs on Structured Streaming."""
from corpuseval.streaming.progress import (
    append_stream,
    corpus_stream,
    LateRows,
    append_sessions,
    late_rows,
    pending_stream,
    progress_stream,
    read_counts,
    read_progress,
    run_available,
    windowed_status,
    write_counts,
    write_progress,
)

__all__ = [
    "append_stream",
    "corpus_stream",
    "LateRows",
    "append_sessions",
    "late_rows",
    "pending_stream",
    "progress_stream",
    "read_counts",
    "read_progress",
    "run_available",
    "windowed_status",
    "write_counts",
    "write_progress",
]

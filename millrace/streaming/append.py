"""Streams that append to a table, with a checkpoint.

The transform is stateless, so batch and stream give the same rows.  A restarted
query goes on from its checkpoint and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_append(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "delta",
    every: str | None = None,
    drain: bool = False,
) -> StreamingQuery:
    """Start appending ``rows`` to the table at ``path``.

    Runs for ever with back-to-back micro-batches, or one per ``every`` ("30 seconds"),
    or, with ``drain``, until what is there now has been read.
    """
    writer = (
        rows.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if drain:
        writer = writer.trigger(availableNow=True)
    elif every is not None:
        writer = writer.trigger(processingTime=every)
    return writer.start(path)


def drain_append(
    rows: DataFrame, path: str, checkpoint: str, fmt: str = "delta", timeout: float | None = None
) -> None:
    """Append what is there now and stop; raises if that fails.

    A topic takes as long as it takes; ``timeout`` seconds, if given, raise as well.
    """
    query = start_append(rows, path, checkpoint, fmt=fmt, drain=True)
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream still running after {timeout} s")
    finally:
        query.stop()

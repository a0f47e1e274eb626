"""Result rows as a stream: new files in, one row a key out, and silences of the sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_rows(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_of_key(rows: DataFrame, key: str = "run_key", time: str = "created_at", late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are remembered as long as late rows may come."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a folder; a restart goes on where the checkpoint stands."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def silences(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of activity by key: a new one begins after a silence of ``gap``."""
    session = F.session_window(time, gap)
    return events.withWatermark(time, gap).groupBy(key, session).agg(F.count("*").alias("n")).select(key, "session_window.start", "session_window.end", "n")


def stalled(events: DataFrame, key: str, time: str, quiet_ms: int) -> DataFrame:
    """key, status, n (events so far) and last (their latest time): a row "silent" as soon as a source has given nothing for
    ``quiet_ms`` of processing time, and a row "back" when it gives something again.

    A timer for each source fires while no data come at all; sessions (``silences``) end only when later data come.  To be
    started in update mode, with a trigger of its own.  The state is a few numbers a source; times may be null.
    """
    names = f"{key} string, status string, n long, last timestamp"

    def follow(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, silent = state.get if state.exists else (0, None, False)
        if state.hasTimedOut:
            state.update((n, last, True))
            yield pd.DataFrame({key: [group[0]], "status": ["silent"], "n": [n], "last": [last]})
            return
        for batch in batches:
            n += len(batch)
            late = batch["_at"].max()
            if not pd.isna(late):
                last = late.to_pydatetime() if last is None else max(last, late.to_pydatetime())
        state.update((n, last, False))
        state.setTimeoutDuration(quiet_ms)
        if silent:
            yield pd.DataFrame({key: [group[0]], "status": ["back"], "n": [n], "last": [last]})

    rows = events.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias("_at"))
    return rows.groupBy(key).applyInPandasWithState(follow, names, "n long, last timestamp, silent boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)

"""Admission and learning as continuous jobs, with the same rules as the batch operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id long, config_id string, source_key string, seen_at timestamp, size string"
ADMITTED = "config_id string, source_key string, event_id long"
#: Typed state needs this store; and with a time to live a job that stops when all is read would go on with empty triggers.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def deposits(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """Deposits as they arrive in a folder of JSON files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


class Admission(StatefulProcessor):
    """The temporal rule for one (config, path): its state is the time of its last accepted deposit."""

    def __init__(self, window_seconds: int, keep_seconds: int):
        self.window, self.keep = window_seconds * 1_000_000, keep_seconds * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long", ttlDurationMs=self.keep)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        if initialState.last is not None:
            self.last.update((initialState.last,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for t, event in sorted((r.t, r.event_id) for r in rows):
            if last is None or t - last >= self.window:
                last = t
                yield Row(config_id=key[0], source_key=key[1], event_id=event)
        if last != before:
            self.last.update((last,))

    def close(self) -> None:
        pass


def accepted(stream: DataFrame, window_seconds: int = 3_600, registry: DataFrame | None = None, keep_seconds: int | None = None) -> DataFrame:
    """Deposits that pass the temporal rule, for each (config, path) trigger by trigger in order of arrival, and within a trigger in order of their time.

    registry: config_id, source_key, last_seen_at, where another run (or the batch operator) left off; it is read once, when the job first starts. A deposit without a time is not
    admitted. A key's state is forgotten `keep_seconds` after it was last written (by the clock of the cluster; the window and a week by default, so that a feed may stand still for a week).
    """
    keep = window_seconds + 7 * 86_400 if keep_seconds is None else keep_seconds
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = stream.select("config_id", "source_key", "event_id", micros("seen_at").alias("t")).filter("t IS NOT NULL")
    start = None if registry is None else registry.select("config_id", "source_key", micros("last_seen_at").alias("last")).groupBy("config_id", "source_key")
    return rows.groupBy("config_id", "source_key").transformWithState(Admission(window_seconds, keep), ADMITTED, "append", "ProcessingTime", start)


@contextmanager
def _settings(spark: SparkSession):
    """SETTINGS for jobs started meanwhile, which keep them."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_once(stream: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet"):
    """Run over what is there now and stop; started again, it goes on from where it was."""
    with _settings(stream.sparkSession):
        return stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def new_log_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Learning-log rows that no run has read yet: the checkpoint remembers the files, so keys need no order."""
    return spark.readStream.schema(schema).json(folder)

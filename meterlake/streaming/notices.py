"""Notices that go out once.

A notice and the marker that it was sent are one row, written by one batch as a partition of its own: a batch that runs
again writes the same partition, and markers are the rows of earlier batches. What a crash between two steps loses is written
by the batch's next run, and what it had written is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.config import Config
from meterlake.functions import times
from meterlake.operators import notify
from meterlake.plans.engine import UsageEngine

#: ``day`` is the day that a notice is about; of a recap the first day of its week.
COLUMNS = "kind string, day date, text string, batch bigint"


class Outbox:
    """The notices below ``folder``, which one stream at a time writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path, self.cursor = spark, f"{folder}/notices", f"{folder}/delivered"

    def _fs(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def rows(self) -> DataFrame:
        fs, at = self._fs(self.path)
        return self.spark.read.schema(COLUMNS).parquet(self.path) if fs.exists(at) else self.spark.createDataFrame([], COLUMNS)

    def markers(self, before: int) -> dict[str, Column]:
        """The last day of each kind sent by batches before ``before``, as ``due`` takes them."""
        last = {r.kind: r.day for r in self.rows().filter(F.col("batch") < before).groupBy("kind").agg(F.max("day").alias("day")).collect()}  # three kinds
        return {kind: F.lit(day).cast("date") for kind, day in last.items()}

    def emit(self, context: DataFrame, config: Config, batch: int, onboarded: bool = True) -> DataFrame:
        """Write what is due in ``context`` (rows of ``day_context`` with minute) and wasn't sent by an earlier batch; returns it.

        Only the latest day of each kind is sent; nothing due writes an empty partition.
        """
        rows = notify.texts(notify.due(context, config, self.markers(batch), onboarded))
        day = F.when(F.col("kind") == "recap", F.date_sub("date", 7)).otherwise(F.col("date"))
        out = rows.select("kind", day.alias("day"), "text").groupBy("kind").agg(F.max("day").alias("day"), F.max_by("text", "day").alias("text"))
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.spark.read.schema("kind string, day date, text string").parquet(f"{self.path}/batch={batch}")

    def after(self, engine: UsageEngine, batch: int, now: datetime) -> DataFrame:
        """``emit`` for the local day and minute of ``now`` (UTC wall time), from an engine's days; for a stream's batches."""
        config = engine.config
        at = times.local_time(F.lit(now).cast("timestamp_ntz"), config.timezone)
        context = notify.day_context(engine.streak_days, config.week_starts_on).filter(F.col("date") == at.cast("date"))
        return self.emit(context.withColumn("minute", times.minute_of_day(at)), config, batch)

    def deliver(self, send: Callable[[str, date, str], None]) -> int:
        """Call ``send(kind, day, text)`` for notices of batches behind the last one delivered; returns how many.

        A crash after ``send`` and before the batch is noted sends it again; kind and day are the same then.
        """
        fs, at = self._fs(self.cursor)
        done = max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=-1) if fs.exists(at) else -1
        waiting = self.rows().filter(F.col("batch") > done).orderBy("batch", "kind").collect()  # three a batch at most
        for batch in sorted({r.batch for r in waiting}):
            for r in waiting:
                if r.batch == batch:
                    send(r.kind, r.day, r.text)
            fs.create(self._fs(f"{self.cursor}/{batch}")[1], True).close()
        return len(waiting)

"""A bronze table of lines that follows growing logs, and daily sums of an event stream.

Order matters to de-duplication, so the ledger is computed from the whole bronze table; the stream only
appends lines to it. Late lines count on their own day: no watermark drops them.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from meterlake.sources.logs import file_order_of, trimmed
from meterlake.streaming.tail import SCHEMA, tail

#: Of the table's columns and the offsets' form.
VERSION = 3


def append_lines(lines: DataFrame, table: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Append a stream of lines to a Parquet folder; once through what is there now, or every ``seconds``.

    The file sink commits each batch once, also after a restart. Without ``seconds`` the call returns when the
    files' sizes at its first batch are reached: Spark ends a Python source's available-now run after one batch,
    which ``maxBytesPerBatch`` may bound, so runs follow each other until then, newest files first. The query
    returned is the last run, ended.
    """
    writer = lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return run_until_read(writer, seconds)


def run_until_read(writer: DataStreamWriter, seconds: int | None = None) -> StreamingQuery:
    """Start a stream of ``tail``'s lines as ``append_lines`` says."""
    if seconds:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    goal = None
    while True:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        moved, reached = _reached(query)
        if goal is None:
            goal = {path: os.path.getsize(path) for path in reached if os.path.exists(path)}
        if not moved or all(reached.get(path, 0) >= size for path, size in goal.items()):
            return query


def _reached(query: StreamingQuery) -> tuple[bool, dict[str, int]]:
    """Whether an ended run read anything, and how far each file is read; empty for another source than ``tail``."""
    moved, reached = False, {}
    for progress in query.recentProgress:
        for source in json.loads(progress.json)["sources"]:
            end = source["endOffset"]
            if source["startOffset"] != end and isinstance(end, dict) and "files" in end:
                moved = True
                reached |= {path: at for path, (_, at, _) in json.loads(end["files"]).items()}
    return moved, reached


def follow(spark: SparkSession, logs: str, folder: str, seconds: int | None = None, **options) -> StreamingQuery:
    """Append what ``logs`` has to the table below ``folder``; both it and its checkpoint are named by ``VERSION``."""
    table, checkpoint = places(folder)
    return append_lines(tail(spark, logs, **options), table, checkpoint, seconds)


def places(folder: str) -> tuple[str, str]:
    """Table and checkpoint below ``folder``: a new layout of either begins anew beside the old one."""
    return f"{folder}/lines-v{VERSION}", f"{folder}/checkpoint-v{VERSION}"


def current_lines(spark: SparkSession, table: str, provisional: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The table's lines of each file's newest generation.

    ``provisional`` (of ``lines_now``) adds the unfinished last lines of now, which the table never has. ``only``
    (with a column path) keeps files that it names, so history of deleted files goes.
    """
    rows = spark.read.schema(SCHEMA).parquet(table)
    newest = rows.groupBy("path").agg(F.max("generation").alias("_g"))  # a row a file
    out = rows.join(newest, "path").filter("generation = _g").drop("_g")
    if provisional is not None:
        out = out.unionByName(provisional.filter("provisional"))
    return out.join(only.select("path").distinct(), "path", "left_semi") if only is not None else out


def as_lines(rows: DataFrame, tool: str, root_order: int = 0) -> DataFrame:
    """Lines of ``log_tail`` as the readers take them: a line's place is its first byte."""
    order = file_order_of(F.lit(root_order), F.col("rel"))
    return trimmed(rows.select(F.lit(tool).alias("tool"), order.alias("file_order"), "path", "rel", "mtime_ms", F.col("start").alias("line_no"), "line"))


def daily_sums(events: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Running daily sums of a stream of events (ts, total), for ``complete`` or ``update`` output.

    State is a row a local day.
    """
    day = F.convert_timezone(F.lit("UTC"), F.lit(timezone), F.col("ts")).cast("date")
    return events.groupBy(day.alias("date")).agg(F.sum("total").alias("total"), F.count("*").alias("messages"))

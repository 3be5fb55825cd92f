"""A ledger that follows growing logs.

Each batch of the stream of lines is parsed by the readers alone: what they know of a file (totals, model, tier, session,
first line) stands in a table with a row for each file, so earlier lines aren't read again. Raw events go to buckets by what makes two of
them one (message, Codex event, Gemini file). Only buckets that a batch touches are de-duplicated and priced again,
and their rows of the ledger are replaced:

* buckets that get events;
* buckets with events of a file whose facts changed: replaced or cut off (a new generation), deleted, hidden by a file of an earlier root,
  known by another project, or a fork whose copied beginning is now longer or shorter.

A batch may run twice: its events are a partition of their own, the ledger's buckets are overwritten, and the table of files is
written last, as a version named by the batch, from the version before that batch.

Below the folder: raw/bucket=/batch=, forks/part=/batch= (Codex events by file), ledger/bucket=, files/version=, reports/.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.config import Config
from meterlake.operators import dedup
from meterlake.plans.engine import UsageEngine, build_ledger
from meterlake.sources import claude, codex, gemini
from meterlake.sources.bronze import keep, remove, small
from meterlake.sources.logs import LINE_COLUMNS, RAW_COLUMNS, Root, file_order_of, malformed, trimmed
from meterlake.streaming import tail as tails
from meterlake.streaming.follow import VERSION, run_until_read

BUCKETS = 64
#: Sweeps without a batch take the versions between those of two batches.
_SWEEPS = 1 << 20
BROADCAST_ROWS = 200_000
_CODEX = codex.STATE.replace("file_order string, ", "", 1)
_GEMINI = gemini.STATE.replace("file_order string, ", "", 1)
_kind = lambda fields: "struct<" + fields.replace(" struct<", ":struct<").replace(" array<", ":array<").replace(" string", ":string") + ">"
#: One row for each file ever found. ``size`` is how far it was read; ``cut`` the last line that a fork copied; ``buckets`` those that have its events.
FILES = (
    "path string, tool string, file_order string, rel string, root_group string, root_order int, generation bigint, inode bigint, size bigint, mtime_ms bigint, lines bigint, malformed bigint, events bigint, "
    f"folder string, cwd string, codex {_kind(_CODEX)}, gemini {_kind(_GEMINI)}, cut bigint, buckets array<int>, status string, counts boolean"
)
_TYPES = {"raw": f"{RAW_COLUMNS}, generation bigint, bucket int, batch bigint", "forks": f"{RAW_COLUMNS}, generation bigint, part int, batch bigint"}


def _columns(schema: str) -> list[str]:
    return SparkSession.active().createDataFrame([], schema).columns


@dataclass(frozen=True)
class Report:
    """What a batch or sweep found. ``duplicates`` are raw events that don't count, replays of forks included."""

    version: int
    files: int
    appended: int
    new: int
    reparsed: int
    removed: int
    lines: int
    bytes: int
    malformed: int
    events: int
    duplicates: int
    buckets: int


@dataclass
class LedgerStream:
    """The tables below ``folder``, which one stream at a time may write.

    ``keep_deleted`` says whether events of deleted files stay. ``markers`` (of ``project_markers``) name Gemini's projects.
    """

    spark: SparkSession
    folder: str
    roots: list[Root]
    prices: DataFrame
    config: Config = field(default_factory=Config)
    keep_deleted: bool = True
    markers: DataFrame | None = None
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.folder = f"{self.folder}/ledger-v{VERSION}"

    # --- tables

    def _names(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Versions of the table of files whose writing was finished."""
        found = [int(n.split("=")[1]) for n in self._names(f"{self.folder}/files") if n.startswith("version=")]
        return sorted(v for v in found if "_SUCCESS" in self._names(f"{self.folder}/files/version={v}"))

    def files(self, version: int | None = None) -> DataFrame:
        """The table of files, its newest version or the one named; without any, empty."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/files/version={version}")

    def _read(self, name: str) -> DataFrame:
        if not self._names(f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], _TYPES[name])
        return self.spark.read.schema(_TYPES[name]).parquet(f"{self.folder}/{name}")

    def ledger(self) -> DataFrame:
        """The ledger now, as ``build_ledger`` gives it."""
        path = f"{self.folder}/ledger"
        if not any(n.startswith("bucket=") for n in self._names(path)):
            raise FileNotFoundError(f"no batch has written {path}")
        return self.spark.read.parquet(path).drop("bucket")

    def engine(self) -> UsageEngine:
        return UsageEngine(self.spark, self.ledger(), self.config)

    def reports(self) -> list[Report]:
        names = sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/reports") if n.endswith(".json"))
        rows = self.spark.read.json([f"{self.folder}/reports/{n}.json" for n in names]).collect() if names else []
        return sorted((Report(**r.asDict()) for r in rows), key=lambda r: r.version)

    # --- runs

    def lines(self, **options) -> DataFrame:
        """The stream of lines of all roots (``tail``'s options), with the columns of the readers and each line's bytes."""
        out = None
        for order, root in enumerate(self.roots):
            rows = tails.tail(self.spark, root.path, **options)
            own = rows.select(
                F.lit(root.tool).alias("tool"), file_order_of(F.lit(order), F.col("rel")).alias("file_order"), "path", "rel", "mtime_ms", F.col("start").alias("line_no"), "line",
                "generation", F.lit(root.group).alias("root_group"), F.lit(order).alias("root_order"), (F.octet_length("line") + 1).alias("bytes"),
            )
            own = own.filter(F.col("rel").rlike(r"(^|/)chats/")) if root.tool == "gemini" else own
            out = own if out is None else out.unionByName(own)
        return out

    def run(self, seconds: int | None = None, progressive: bool = False, **options) -> StreamingQuery:
        """Follow the logs: once through what is there now, or every ``seconds``.

        A progressive run takes 32 MB of the newest files first and then batches that grow fourfold; the ledger is right for what was read
        after each. Found order is by root, path and line, not by arrival, so the last ledger is that of a batch read.
        """
        writer = self.lines(progressive=str(progressive).lower(), **options).writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint")
        query = run_until_read(writer, seconds)
        if not seconds:
            self.sweep()
        return query

    def take(self, lines: DataFrame, batch: int) -> None:
        """A batch of the stream."""
        for v in self.versions():
            if v > batch * _SWEEPS:  # sweeps after a batch that runs again
                remove(self.spark, f"{self.folder}/files/version={v}")
        self._absorb(lines, batch * _SWEEPS)

    def sweep(self, everything: bool = False) -> Report:
        """Look for deleted and re-created files without new lines; with ``everything`` (new prices, zone) all buckets are computed again."""
        none = self.spark.createDataFrame([], f"{LINE_COLUMNS}, generation bigint, root_group string, root_order int, bytes int")
        return self._absorb(none, max(self.versions(), default=-1) + 1, everything)

    # --- a batch

    def _found(self) -> DataFrame:
        """Files that are there now; the listing that the stream's offsets come from."""
        rows = [(path, os.path.relpath(path, r.path), r.tool, order, r.group, s.st_ino, s.st_size, s.st_mtime_ns // 1_000_000) for order, r in enumerate(self.roots) for path, s in tails.stamps(r.path, ".jsonl")]
        return self.spark.createDataFrame(rows, "path string, found_rel string, found_tool string, found_order int, found_group string, found_inode bigint, found_size bigint, found_mtime bigint")

    def _parsed(self, lines: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Raw events of new lines, and per touched file its new state; states of files that a line's generation matches go on."""
        tools = {r.tool for r in lines.select("tool").distinct().collect()}
        touched = lines.groupBy("file_order").agg(F.max("generation").alias("generation"))
        own = lambda tool: lines.filter(F.col("tool") == tool)
        per_file = lines.groupBy("path", "tool", "file_order", "rel", "root_group", "root_order").agg(F.max("generation").alias("generation"), F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))
        after = per_file.join(malformed(lines, "path"), "path", "left")
        events, states = [], {"folder": "string", "cwd": "string", "codex": _kind(_CODEX), "gemini": _kind(_GEMINI)}
        pack = lambda df, name: df.select("file_order", F.struct(*[c for c in df.columns if c != "file_order"]).alias(name))
        if tools - {"claude"}:
            before = keep(before.join(small(touched, BROADCAST_ROWS), ["file_order", "generation"], "left_semi"))
        if "claude" in tools:
            events.append(claude.read(own("claude")))
            after = after.join(claude.first_folders(own("claude")), "file_order", "left")
        if "codex" in tools:
            found, state = codex.read_on(own("codex"), before.filter("codex is not null").select("file_order", "codex.*"))
            events.append(found)
            after = after.join(pack(state, "codex"), "file_order", "left")
        if "gemini" in tools:
            found, state = gemini.read_on(own("gemini"), before.filter("gemini is not null").select("file_order", "gemini.*"), self.markers)
            events.append(found)
            after = after.join(pack(state, "gemini"), "file_order", "left")
        after = after.withColumns({n: F.lit(None).cast(kind) for n, kind in states.items() if n not in after.columns})
        every = self.spark.createDataFrame([], RAW_COLUMNS)
        for more in events:
            every = every.unionByName(more)
        return keep(every.join(small(touched, BROADCAST_ROWS), "file_order")), keep(after)

    def _bucket(self) -> Column:
        """By what makes two events one; a Claude event without a message id goes by its file."""
        key = F.when(F.col("tool") == "claude", F.xxhash64(F.coalesce("msg_id", "path"))).when(F.col("tool") == "codex", F.xxhash64(*dedup.CODEX_KEY)).otherwise(F.xxhash64("file_order"))
        return F.pmod(key, F.lit(self.buckets)).cast("int").alias("bucket")

    def _append(self, events: DataFrame, name: str, place: Column, version: int) -> None:
        rows = events.select(*_columns(RAW_COLUMNS), "generation", place.alias({"raw": "bucket", "forks": "part"}[name]), F.lit(version).cast("bigint").alias("batch"))
        by = _columns(_TYPES[name])[-2:]
        rows.repartition(by[0]).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("file_order"), F.lit(self.buckets)).cast("int").alias("part")

    def _absorb(self, lines: DataFrame, version: int, everything: bool = False) -> Report:
        earlier = [v for v in self.versions() if v < version]
        before = self.files(max(earlier)) if earlier else self.spark.createDataFrame([], FILES)
        seen = Observation("lines")
        own = keep(trimmed(lines.observe(seen, F.count("*").alias("lines"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))))
        events, after = self._parsed(own, before)
        if seen.get["lines"]:
            self._append(events, "raw", self._bucket(), version)
            self._append(events.filter("tool = 'codex'"), "forks", self._part(), version)
        now = self._merged(before, after, events)
        now = self._with_cuts(now, before, after)
        dirty = self._dirty(before, now, events, everything)
        self._replace(now, dirty)
        now.write.mode("overwrite").parquet(f"{self.folder}/files/version={version}")
        report = self._reported(version, now, seen.get, len(dirty))
        for v in earlier[:-1]:  # the version before stays: this batch may run again
            remove(self.spark, f"{self.folder}/files/version={v}")
        return report

    def _merged(self, before: DataFrame, after: DataFrame, events: DataFrame) -> DataFrame:
        """The table of files after a batch: stored, touched and found ones joined by path, in full."""
        made = events.groupBy("file_order").agg(F.count("*").alias("events"), F.collect_set(self._bucket()).alias("buckets"))
        new = after.join(made, "file_order", "left").select("path", F.struct(*[c for c in after.columns if c != "path"], "events", "buckets").alias("n"))
        old = before.select("path", F.struct(*[c for c in before.columns if c != "path"]).alias("o"))
        rows = old.join(new, "path", "full").join(self._found(), "path", "full")
        o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
        same = o("generation").isNotNull() & (n("generation").isNull() | (n("generation") == o("generation")))
        going = lambda c: F.when(same, o(c))
        plus = lambda c: F.coalesce(going(c), F.lit(0)) + F.coalesce(n(c), F.lit(0))
        first = lambda c: F.coalesce(going(c), n(c))
        last = lambda c: F.coalesce(n(c), going(c))
        order = F.coalesce(o("root_order"), n("root_order"), "found_order")
        rel = F.coalesce(o("rel"), n("rel"), "found_rel")
        empty = F.expr("cast(array() as array<int>)")
        status = (
            F.when(F.col("found_inode").isNull(), "deleted").when(o("generation").isNull(), F.when(n("generation").isNull(), "waiting").otherwise("new"))
            .when(n("generation").isNull(), "unchanged").when(same, "appended").otherwise("reparsed")
        )
        values = {
            "tool": F.coalesce(o("tool"), n("tool"), "found_tool"), "file_order": file_order_of(order, rel), "rel": rel, "root_group": F.coalesce(o("root_group"), n("root_group"), "found_group"), "root_order": order,
            "generation": F.coalesce(n("generation"), o("generation")), "inode": F.coalesce("found_inode", o("inode")), "size": F.coalesce("found_size", o("size")), "mtime_ms": F.coalesce("found_mtime", o("mtime_ms")), "lines": plus("lines"), "malformed": plus("malformed"), "events": plus("events"),
            "folder": last("folder"), "cwd": first("cwd"), "codex": last("codex"), "gemini": last("gemini"), "cut": going("cut"),
            "buckets": F.array_sort(F.array_union(F.coalesce(going("buckets"), empty), F.coalesce(n("buckets"), empty))), "status": status,
        }
        rows = rows.select("path", *[v.alias(k) for k, v in values.items()])
        there = F.lit(True) if self.keep_deleted else F.col("status") != "deleted"
        ranked = F.min(F.when(there & F.col("generation").isNotNull(), F.col("root_order"))).alias("leader")
        leaders = rows.groupBy("root_group", "rel").agg(ranked, F.count("*").alias("k")).filter("k > 1").drop("k")
        rows = rows.join(small(leaders, BROADCAST_ROWS), ["root_group", "rel"], "left")
        rows = rows.withColumn("counts", there & F.coalesce(F.col("leader") == F.col("root_order"), F.lit(True)))
        return keep(rows.select(*_columns(FILES)))

    def _with_cuts(self, now: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        """``now`` with the last copied line of each fork that the batch may have changed: touched files, those that count anew or no more, and their children."""
        states = now.filter("tool = 'codex' and codex is not null and counts")
        facts = codex.file_facts(states.select("file_order", "codex.*"))
        was = before.filter("tool = 'codex'").select("file_order", F.col("counts").alias("was"))
        moved = now.filter("tool = 'codex'").join(was, "file_order", "left").filter("was is null or was <> counts").select("file_order", "codex.meta.session_id")
        touched = moved.unionByName(after.filter("tool = 'codex'").select("file_order", "codex.meta.session_id"))
        ids = touched.filter("session_id is not null").select(F.col("session_id").alias("parent_id")).distinct()
        children = facts.join(ids, "parent_id", "left_semi").select("file_order")
        family = keep(touched.select("file_order").unionByName(children).distinct().join(facts, "file_order"))
        if family.isEmpty():
            return now
        parents = facts.join(family.select(F.col("parent_id").alias("session_id")).filter("session_id is not null").distinct(), "session_id", "left_semi")
        needed = family.select("file_order").unionByName(parents.select("file_order")).distinct()
        needed = keep(needed.withColumn("part", self._part()).join(states.select("file_order", "path", "generation"), "file_order"))
        parts = [r.part for r in needed.select("part").distinct().collect()]  # at most ``buckets``
        forks = self._read("forks").filter(F.col("part").isin(parts)).join(small(needed.drop("part"), BROADCAST_ROWS), ["file_order", "path", "generation"], "left_semi")
        every = family.unionByName(parents.select(*family.columns)).dropDuplicates(["file_order"])
        gone = dedup.replayed(forks, every).join(family.select("file_order"), "file_order", "left_semi")
        cuts = family.select("file_order").join(gone.groupBy("file_order").agg(F.max("line_no").alias("upto")), "file_order", "left").withColumn("judged", F.lit(True))
        rows = now.join(small(cuts, BROADCAST_ROWS), "file_order", "left")
        return keep(rows.withColumn("cut", F.when(F.col("judged"), F.col("upto")).otherwise(F.col("cut"))).select(*now.columns))

    def _dirty(self, before: DataFrame, now: DataFrame, events: DataFrame, everything: bool) -> list[int]:
        """Buckets to compute again: at most ``buckets`` numbers."""
        if everything:
            return list(range(self.buckets))
        facts = ("generation", "cut", "cwd", "counts")
        old = before.select("path", F.struct(*facts).alias("was"), F.col("buckets").alias("had"))
        changed = now.select("path", F.struct(*facts).alias("is"), "buckets").join(old, "path").filter(~F.col("is").eqNullSafe(F.col("was")))
        touched = changed.select(F.explode(F.array_union("buckets", "had")).alias("bucket")).unionByName(events.select(self._bucket()))
        return sorted(r.bucket for r in touched.distinct().collect())

    def _replace(self, now: DataFrame, dirty: list[int]) -> None:
        """Compute the ledger's rows in the buckets ``dirty`` and overwrite these."""
        if not dirty:
            return
        named = claude.project_names()
        live = now.filter("counts and generation is not null").select("path", "generation", "cut", F.struct("tool", "folder", "cwd").alias("f"))
        names = live.select("path", "generation", "cut", "f.*").select("path", "generation", "cut", *[F.when(F.col("tool") == "claude", c).alias(f"own_{n}") for n, c in zip(("project", "label"), named, strict=True)])
        rows = self._read("raw").filter(F.col("bucket").isin(dirty)).join(small(names, BROADCAST_ROWS), ["path", "generation"]).filter("cut is null or line_no > cut")
        rows = rows.withColumns({"project": F.coalesce("own_project", "project"), "project_label": F.coalesce("own_label", "project_label")})
        rows = keep(rows.select(*_columns(RAW_COLUMNS), "bucket"))
        own = lambda tool: rows.filter(F.col("tool") == tool)
        out = build_ledger({t: own(t) for t in ("claude", "codex", "gemini")}, self.prices, self.config, ("bucket",))
        out = keep(out)
        out.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/ledger")
        full = {r.bucket for r in out.select("bucket").distinct().collect()}
        for b in set(dirty) - full:  # dynamic overwriting leaves what gets no rows
            remove(self.spark, f"{self.folder}/ledger/bucket={b}")

    def _reported(self, version: int, now: DataFrame, seen: dict, buckets: int) -> Report:
        kinds = {r.status: (r.n, r.events) for r in now.groupBy("status").agg(F.count("*").alias("n"), F.sum("events").alias("events")).collect()}
        of = lambda *names: sum(kinds.get(n, (0, 0))[0] for n in names)
        totals = now.agg(F.coalesce(F.sum("malformed"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("counts"), F.col("events"))), F.lit(0))).first()
        events = self.ledger().count() if any(n.startswith("bucket=") for n in self._names(f"{self.folder}/ledger")) else 0
        removed = of("deleted") if not self.keep_deleted else 0
        report = Report(version, of("new", "appended", "reparsed", "unchanged", "waiting"), of("appended"), of("new"), of("reparsed"), removed, seen["lines"], seen["bytes"], totals[0], events, totals[1] - events, buckets)
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/reports/{version}.json")
        stream = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        stream.write(bytearray(json.dumps(report.__dict__).encode()))
        stream.close()
        return report


def without_deleted(stream: LedgerStream) -> LedgerStream:
    """The same tables, from whose next sweep on events of deleted files go."""
    return replace(stream, folder=os.path.dirname(stream.folder), keep_deleted=False)

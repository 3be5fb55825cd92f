"""An engine with what it keeps between runs below one folder: settings, state, prices, the ledger's tables.

Settings and state are small JSON documents, replaced whole, so that a reader sees the old one or the new one. The ledger is a
``LedgerStream`` named by its folders of logs: with other folders another one begins. What its rows depend on besides
the logs (zone, tier, prices) is noted in the state once they are computed with it; a run that finds another note, or none
after a crash, computes all buckets again. An ephemeral engine keeps all this in memory and reads the logs anew.
"""

from __future__ import annotations

import zlib
from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.config import TOOLS, Config, Goal, Notifications, QuietHours
from meterlake.operators import goals, insights, pricing, state
from meterlake.plans.engine import UsageEngine, build_ledger
from meterlake.sources.logs import RAW_COLUMNS, Root, default_roots, standing
from meterlake.streaming.ledger import LedgerStream
from meterlake.streaming.notices import Outbox

# Names and defaults of the settings and the state. Other names in a document stay in it.
SETTINGS = {
    "dailyGoal": 0,
    "weeklyGoal": 0,
    "weekStartsOn": "monday",
    "restDays": [],
    "streakFreezes": True,
    "timezone": None,
    "tools": {tool: {"enabled": True, "customPaths": []} for tool in TOOLS},
    "notifications": {"goalReached": True, "streakAtRisk": False, "reminderTime": "20:00", "weeklyRecap": False, "quietHours": {"enabled": False, "start": "22:00", "end": "08:00"}},
    "keepDeletedHistory": True,
    "codexFastTier": None,
}
STATE = {"version": 1, "installedAt": None, "onboardingCompletedAt": None, "goalHistory": [], "celebratedDates": [], "unlocked": {}, "seenAchievements": []}


def goal_history(changes: list[dict]) -> tuple[Goal, ...]:
    """Goals of a state's changes by date; changes without a date or a daily goal are left out, of one date the last holds."""
    out: dict[date, Goal] = {}
    for c in changes:
        try:
            since = date.fromisoformat(c["effectiveFrom"])
            goal = Goal(since, int(c["daily"]), int(c["weekly"]))
        except (KeyError, TypeError, ValueError):
            continue
        if goal.daily > 0:
            out[since] = goal
    return tuple(out[d] for d in sorted(out))


class Home:
    """Use ``open`` or ``ephemeral``. One process at a time may write a folder."""

    def __init__(self, spark: SparkSession, folder: str | None, settings: dict, kept: dict, prices: DataFrame, env: dict[str, str], home: str):
        self.spark, self.folder, self.settings, self.state, self.prices, self.env, self.home = spark, folder, settings, kept, prices, env, home
        self._ledger: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, env: dict[str, str], home: str, now: datetime) -> Home:
        """The engine of ``folder`` (any file system of Spark's); a first opening notes ``now`` (UTC wall time), nothing is scanned yet.

        Absent or damaged documents count as the defaults. Prices are the snapshot ``prices.json``, else only those that are built in.
        """
        settings, kept = (state.read_json(spark, f"{folder}/{name}.json", defaults) for name, defaults in (("settings", SETTINGS), ("state", STATE)))
        out = cls(spark, folder, settings, kept, pricing.price_source(spark, None, f"{folder}/prices.json")[0], env, home)
        if not kept["installedAt"]:
            out._note(installedAt=now.isoformat(timespec="milliseconds") + "Z")
        return out

    @classmethod
    def ephemeral(cls, spark: SparkSession, env: dict[str, str], home: str, prices: DataFrame | None = None, settings: dict | None = None) -> Home:
        """An engine that writes no settings, state or ledger (tables of the session in its shared folder, as all jobs have)."""
        prices = spark.createDataFrame([], pricing.PRICE_COLUMNS) if prices is None else prices
        return cls(spark, None, state.merge(SETTINGS, settings or {}), dict(STATE), prices, env, home)

    # --- settings and state

    def _note(self, **values) -> None:
        self.state = self.state | values
        if self.folder:
            state.write_json(self.spark, f"{self.folder}/state.json", self.state)

    def update(self, patch: dict) -> None:
        """Merge ``patch`` into the settings; a zone that isn't known is an error."""
        merged = state.merge(self.settings, patch)
        if merged["timezone"]:
            ZoneInfo(merged["timezone"])
        self.settings = merged
        if self.folder:
            state.write_json(self.spark, f"{self.folder}/settings.json", merged)

    def set_goals(self, since: date, daily: int, weekly: int = 0) -> None:
        """Goals from a date on, in the settings and as a change in the state; the first ones end the onboarding."""
        history = goals.set_goal(goal_history(self.state["goalHistory"]), since, daily, weekly)
        changes = [{"effectiveFrom": g.effective_from.isoformat(), "daily": g.daily, "weekly": g.weekly} for g in history]
        self._note(goalHistory=changes, onboardingCompletedAt=self.state["onboardingCompletedAt"] or since.isoformat())
        self.update({"dailyGoal": daily, "weeklyGoal": weekly or 5 * daily})

    def acknowledge(self, day: date) -> None:
        """Note that a day's reached goal was celebrated."""
        self._note(celebratedDates=state.acknowledge(self.state["celebratedDates"], day.isoformat()))

    def mark_seen(self, *ids: str) -> None:
        self._note(seenAchievements=sorted({*self.state["seenAchievements"], *ids}))

    def roots(self) -> list[Root]:
        """Folders of the tools that are on; folders needn't exist."""
        tools = self.settings["tools"]
        off = [t for t in TOOLS if not tools[t]["enabled"]]
        return standing(self.spark, default_roots(self.env, self.home, {t: tools[t]["customPaths"] for t in TOOLS}, off))

    def config(self, now: datetime | None = None) -> Config:
        """The settings as a configuration, with the local date of ``now`` (UTC wall time)."""
        s, n = self.settings, self.settings["notifications"]
        zone = s["timezone"] or "UTC"
        today = now.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).date() if now else None
        q = n["quietHours"]
        notices = Notifications(n["goalReached"], n["streakAtRisk"], n["reminderTime"], n["weeklyRecap"], QuietHours(q["enabled"], q["start"], q["end"]))
        return Config(zone, s["weekStartsOn"], tuple(s["restDays"]), s["streakFreezes"], goal_history(self.state["goalHistory"]), today, bool(s["codexFastTier"]), notices)

    # --- the ledger

    def stream(self) -> LedgerStream:
        """The stream of the folders that count now."""
        roots = self.roots()
        name = zlib.crc32(repr([(r.tool, r.path, r.group) for r in roots]).encode())
        return LedgerStream(self.spark, f"{self.folder}/usage-{name:08x}", roots, self.prices, self.config(), self.settings["keepDeletedHistory"])

    def _depends_on(self, stream: LedgerStream) -> list:
        rows = self.prices.select(F.xxhash64(*sorted(self.prices.columns)).alias("h")).agg(F.coalesce(F.bit_xor("h"), F.lit(0)), F.count("*")).first()
        return [stream.folder, stream.config.timezone, stream.config.codex_default_fast, *rows]

    def refresh(self, progressive: bool = False) -> None:
        """Read what the logs have got since the last time."""
        if not self.folder:
            self._ledger = UsageEngine.from_logs(self.spark, self.roots(), self.prices, self.config()).ledger
            return
        stream = self.stream()
        noted = self._depends_on(stream)
        if stream.versions() and self.state.get("ledgerOf") != noted:
            stream.sweep(everything=True)
        stream.run(progressive=progressive)
        if self.state.get("ledgerOf") != noted:
            self._note(ledgerOf=noted)

    def ledger(self) -> DataFrame:
        """The ledger of the last refresh; empty before the first, and without usage."""
        if self.folder:
            try:
                return self.stream().ledger()
            except FileNotFoundError:
                pass
        if self._ledger is not None:
            return self._ledger
        none = self.spark.createDataFrame([], RAW_COLUMNS)
        return build_ledger(dict.fromkeys(TOOLS, none), self.prices, self.config())

    def engine(self, now: datetime | None = None) -> UsageEngine:
        return UsageEngine(self.spark, self.ledger(), self.config(now))

    # --- what happens once

    def achievements(self, engine: UsageEngine) -> DataFrame:
        """Achievements with the unlock dates that stay; ``is_new`` until ``mark_seen``."""
        return engine.achievements(self._unlocked(), tuple(self.state["seenAchievements"]))

    def _unlocked(self) -> DataFrame:
        rows = [(k, date.fromisoformat(v)) for k, v in self.state["unlocked"].items()]
        return self.spark.createDataFrame(rows, "id string, unlocked_at date")

    def sync_unlocks(self, engine: UsageEngine) -> dict[str, date]:
        """Note achievements (of sixteen) unlocked since the last call, and return them."""
        fresh = {r.id: r.unlocked_at for r in insights.newly_unlocked(self.achievements(engine), self._unlocked()).collect()}
        if fresh:
            self._note(unlocked=self.state["unlocked"] | {k: v.isoformat() for k, v in fresh.items()})
        return fresh

    def celebration(self, engine: UsageEngine) -> DataFrame:
        """A row if today's goal is met, goals were set, and ``acknowledge`` wasn't called for today."""
        today = engine.streak_days.filter("date = today")
        return state.celebration(today, engine.streak(), tuple(self.state["celebratedDates"]), self.state["onboardingCompletedAt"] is not None)

    def outbox(self) -> Outbox:
        """Notices and their markers; an ephemeral engine sends none."""
        if not self.folder:
            raise ValueError("an ephemeral engine has no outbox")
        return Outbox(self.spark, self.folder)

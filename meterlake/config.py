"""Settings of a usage engine; every function takes what it needs from here, nothing is read from the clock."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

#: Tools in their fixed order; ties between tools go by it.
TOOLS = ("claude", "codex", "gemini")
TOOL_NAMES = {"claude": "Claude Code", "codex": "Codex CLI", "gemini": "Gemini CLI"}
#: What stands for a missing model.
NO_MODEL = "(no model)"


@dataclass(frozen=True)
class Goal:
    """Daily and weekly goal in effect from a date on; the first holds for earlier dates too."""

    effective_from: date
    daily: int
    weekly: int


@dataclass(frozen=True)
class QuietHours:
    enabled: bool = False
    start: str = "22:00"
    end: str = "08:00"


@dataclass(frozen=True)
class Notifications:
    goal_reached: bool = True
    streak_at_risk: bool = False
    reminder_time: str = "20:00"
    weekly_recap: bool = False
    quiet_hours: QuietHours = field(default_factory=QuietHours)


@dataclass(frozen=True)
class Config:
    timezone: str = "UTC"
    week_starts_on: str = "monday"
    rest_days: tuple[int, ...] = ()  # 0 is Monday
    streak_freezes: bool = False
    goals: tuple[Goal, ...] = ()
    today: date | None = None  # None: the last day with usage
    codex_default_fast: bool = False
    notifications: Notifications = field(default_factory=Notifications)

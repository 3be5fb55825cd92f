"""Settings, state and ledger between openings of an engine, and an engine that keeps nothing."""

import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from test_ledger_stream import claude_line, codex_count, codex_meta, write

from meterlake.operators import pricing, state
from meterlake.sources.logs import Root, standing
from meterlake.streaming import home
from meterlake.streaming.home import Home

NOW = datetime(2026, 3, 2, 23, 30)


@pytest.fixture
def quick(spark):
    few = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in few}
    for k, v in few.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sums(engine):
    return {(r.date, r.tool): (r.total, round(r.cost, 9)) for r in engine.ledger.groupBy("date", "tool").agg(F.sum("total").alias("total"), F.sum("cost").alias("cost")).collect()}


def files_below(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


def test_an_engine_goes_on_where_it_was(spark, tmp_path, quick):
    user, kept = str(tmp_path / "user"), f"file://{tmp_path}/kept"
    a, b = f"{user}/.claude/projects/-home-u-web-app/a.jsonl", f"{user}/.codex/sessions/2026/b.jsonl"
    write(a, claude_line(1, 1, 500), claude_line(2, 2, 600))
    write(b, codex_meta("S"), codex_count(5, 100, 10))
    first = Home.open(spark, kept, {}, user, NOW)
    assert first.engine(NOW).ledger.count() == 0  # nothing was scanned yet
    first.refresh()
    first.set_goals(date(2026, 3, 1), 1_000)
    engine = first.engine(NOW)
    assert sums(engine)[date(2026, 3, 2), "claude"][0] == 1114
    assert first.sync_unlocks(engine) == {k: date(2026, 3, 2) for k in first.state["unlocked"]} and first.state["unlocked"]
    assert first.celebration(engine).first().tokens == 1224
    first.acknowledge(date(2026, 3, 2))

    again = Home.open(spark, kept, {}, user, datetime(2026, 3, 9))
    assert again.state == first.state and again.settings == first.settings and again.state["installedAt"] == "2026-03-02T23:30:00.000Z"
    engine = again.engine(NOW)
    assert engine.config.goals[0].daily == 1_000 and again.sync_unlocks(engine) == {} and again.celebration(engine).isEmpty()
    assert again.achievements(engine).filter("is_new").count() == len(again.state["unlocked"])
    again.mark_seen(*again.state["unlocked"])
    assert again.achievements(engine).filter("is_new").isEmpty()

    # another zone and other prices: rows without new lines are computed again; each note is made once
    before = sums(again.engine())
    again.update({"timezone": "Pacific/Auckland"})
    pricing.write_snapshot(spark.createDataFrame([("claude-opus-4-6", 1.0, 2.0, *[None] * 8)], pricing.PRICE_COLUMNS), f"{kept}/prices.json", "test", "2026-03-01")
    third = Home.open(spark, kept, {}, user, NOW)
    assert sums(third.engine()) == before
    third.refresh()
    after = sums(third.engine())
    assert {d for d, _ in after} == {date(2026, 3, 2)} and after[date(2026, 3, 2), "claude"] == (1114, 7 * 2 + 1100 * 2.0)
    assert third.config(NOW).today == date(2026, 3, 3)
    versions = third.stream().versions()
    noted = third.state["ledgerOf"]
    write(a, claude_line(3, 3, 100))
    third.refresh()
    assert third.state["ledgerOf"] == noted and third.stream().versions() != versions and sums(third.engine())[date(2026, 3, 2), "claude"][0] == 1221

    # a tool that is off
    third.update({"tools": {"codex": {"enabled": False}}})
    third.refresh()
    assert {t for _, t in sums(third.engine())} == {"claude"}
    with pytest.raises(Exception, match="No time zone"):
        third.update({"timezone": "Nowhere/At_All"})
    assert third.settings["timezone"] == "Pacific/Auckland"


def test_an_ephemeral_engine_writes_nothing(spark, tmp_path, quick):
    user = str(tmp_path / "user")
    write(f"{user}/.claude/projects/-p/a.jsonl", claude_line(1, 1, 500), claude_line(2, 2, 600))
    before = files_below(tmp_path)
    one = Home.ephemeral(spark, {}, user, settings={"timezone": "Pacific/Auckland"})
    one.set_goals(date(2026, 3, 1), 700)
    assert one.engine().ledger.count() == 0
    one.refresh()
    engine = one.engine(NOW)
    assert engine.ledger.count() == 2 and one.sync_unlocks(engine) and one.sync_unlocks(engine) == {}
    assert files_below(tmp_path) == before
    with pytest.raises(ValueError, match="ephemeral"):
        one.outbox()
    assert home.STATE["goalHistory"] == [] and home.STATE["unlocked"] == {} and home.SETTINGS["dailyGoal"] == 0


def test_documents(spark, tmp_path):
    path = f"file://{tmp_path}/s.json"
    assert state.read_json(spark, path, {"a": {"b": 1}}) == {"a": {"b": 1}}
    for value in ({"a": {"c": "é\n"}}, {"a": {"b": 2}, "theme": "dark"}):
        state.write_json(spark, path, value)
        assert state.read_json(spark, path, {"a": {"b": 1}}) == state.merge({"a": {"b": 1}}, value)
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["s.json"]
    for i, bad in enumerate(("{", "[1]", "")):
        (tmp_path / f"bad{i}.json").write_text(bad)
        assert state.read_json(spark, f"{tmp_path}/bad{i}.json", {"a": 1}) == {"a": 1}


def test_goal_changes_of_a_state():
    rows = [{"effectiveFrom": "2026-02-01", "daily": 5, "weekly": 9}, {"effectiveFrom": "soon", "daily": 5, "weekly": 9}, {"daily": 4}, {"effectiveFrom": "2026-01-01", "daily": 3, "weekly": 6}]
    rows += [{"effectiveFrom": "2026-03-01", "daily": 0, "weekly": 0}, {"effectiveFrom": "2026-02-01", "daily": 7, "weekly": 8}, None]
    assert [(g.effective_from.month, g.daily, g.weekly) for g in home.goal_history(json.loads(json.dumps(rows)))] == [(1, 3, 6), (2, 7, 8)]


def test_folders_that_stand_in_for_others(spark, tmp_path):
    parts = [Root("codex", f"{tmp_path}/sessions", "c"), Root("codex", f"{tmp_path}/archived", "c"), Root("codex", str(tmp_path), "c", (f"{tmp_path}/sessions", f"{tmp_path}/archived"))]
    assert standing(spark, parts) == parts
    os.makedirs(parts[1].path)
    assert standing(spark, parts) == parts[:2]

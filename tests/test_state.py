from datetime import date

from meterlake.operators import state


def test_settings_merge_and_survive_bad_files(tmp_path):
    base = {"goals": {"daily": 5, "weekly": 30}, "rest": [5]}
    assert state.merge(base, {"goals": {"daily": 9}, "rest": [6]}) == {"goals": {"daily": 9, "weekly": 30}, "rest": [6]}
    assert base["goals"]["daily"] == 5
    path = str(tmp_path / "state.json")
    assert state.load(path, base) == base
    state.save(path, {"goals": {"weekly": 40}})
    assert state.load(path, base)["goals"] == {"daily": 5, "weekly": 40}
    for bad in ("{", "[1]", ""):
        with open(path, "w") as f:
            f.write(bad)
        assert state.load(path, base) == base


def test_acknowledged_dates_are_bounded():
    dates: list[str] = []
    for i in range(200):
        dates = state.acknowledge(dates, f"d{i}")
    assert len(dates) == state.KEEP_ACKNOWLEDGED and dates[-1] == "d199"
    assert state.acknowledge(dates, "d150")[-1] == "d150" and len(state.acknowledge(dates, "d150")) == state.KEEP_ACKNOWLEDGED


def test_unlock_dates_stay(spark):
    kind = "id string, unlocked_at date"
    stored = spark.createDataFrame([("a", date(2026, 1, 5)), ("b", date(2026, 1, 1))], kind)
    now = spark.createDataFrame([("a", date(2026, 1, 9)), ("c", date(2026, 2, 1)), ("d", None), ("b", None)], kind)
    got = {r.id: r.unlocked_at for r in state.merge_unlocks(stored, now).collect()}
    assert got == {"a": date(2026, 1, 5), "b": date(2026, 1, 1), "c": date(2026, 2, 1)}


def test_days_against_another_count(spark):
    kind = "date date, total bigint, cost double"
    ours = spark.createDataFrame([(date(2026, 1, 1), 10, 1.0), (date(2026, 1, 2), 5, 2.0), (date(2026, 1, 3), 5, 2.0)], kind)
    theirs = spark.createDataFrame([(date(2026, 1, 1), 10, 1.005), (date(2026, 1, 2), 6, 2.5), (date(2026, 1, 4), 1, 0.0)], kind)
    got = {r.date.day: (r.tokens_equal, r.cost_near) for r in state.compare_days(ours, theirs).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)}


def test_a_celebration_comes_once(spark):
    today = spark.createDataFrame([(date(2026, 1, 2), 120, True)], "today date, total bigint, met boolean")
    streak = spark.createDataFrame([(3, 3)], "current bigint, longest bigint")
    assert state.celebration(today, streak).first().new_record
    assert state.celebration(today, streak, celebrated=("2026-01-02",)).count() == 0
    assert state.celebration(today, streak, onboarded=False).count() == 0

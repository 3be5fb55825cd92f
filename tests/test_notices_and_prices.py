"""Notices that go out once, instants of local minutes, price snapshots; runs and smoothing against plain versions."""

import json
import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.config import Config, Notifications
from meterlake.functions import times
from meterlake.operators import notify, pricing, trail
from meterlake.streaming.notices import Outbox

RATES = [("a", 1e-6, 2e-6, None, 1e-7, None, None, None, None, None, None), ('odd "name"\\x', 0.5, 0.25, 0.1, None, 3e-6, None, 4.0, None, 272_000, 2.0), ("z/é", 0.0, 1.0, None, None, None, None, None, 5.0, None, None)]


def context(spark, *rows):
    kinds = "date date, total bigint, goal bigint, met boolean, run int, rest boolean, remaining bigint, minute int, last_tokens bigint, last_met_days bigint"
    return spark.createDataFrame([(d, total, 100, total >= 100, 3, False, max(0, 100 - total), minute, 700, 4) for d, total, minute in rows], kinds)


def test_each_notice_goes_out_once(spark, tmp_path):
    box = Outbox(spark, str(tmp_path))
    config = Config(notifications=Notifications(streak_at_risk=True, weekly_recap=True))
    monday, tuesday = date(2026, 3, 2), date(2026, 3, 3)
    kinds = lambda df: sorted((r.kind, r.day) for r in df.collect())
    morning = context(spark, (monday, 20, 10 * 60))
    assert kinds(box.emit(morning, config, 0)) == [("recap", date(2026, 2, 23))]
    late = context(spark, (monday, 120, 21 * 60))
    assert kinds(box.emit(late, config, 1)) == [("goal", monday)]
    assert kinds(box.emit(late, config, 1)) == [("goal", monday)]  # the batch runs again after a crash: the same notice, not a second
    assert kinds(box.emit(late, config, 2)) == []
    assert kinds(box.emit(context(spark, (tuesday, 20, 21 * 60)), config, 3)) == [("at_risk", tuesday)]
    assert kinds(box.emit(context(spark, (tuesday, 150, 22 * 60)), config, 4)) == [("goal", tuesday)]
    sent = []
    assert box.deliver(lambda *x: sent.append(x[:2])) == 4 and box.deliver(lambda *x: sent.append(x[:2])) == 0
    assert sent == [("recap", date(2026, 2, 23)), ("goal", monday), ("at_risk", tuesday), ("goal", tuesday)]

    def fails(kind, day, text):
        raise OSError

    box.emit(context(spark, (date(2026, 3, 4), 150, 600)), config, 5)
    with pytest.raises(OSError):
        box.deliver(fails)
    assert box.deliver(lambda *x: sent.append(x[:2])) == 1 and sent[-1] == ("goal", date(2026, 3, 4))  # what wasn't delivered waits


@pytest.mark.parametrize(
    "zone, day, minute, first, shifted",
    [
        ("America/New_York", date(2026, 3, 8), 150, "2026-03-08 07:00", "2026-03-08 07:30"),  # 02:30 is left out
        ("America/New_York", date(2026, 3, 8), 120, "2026-03-08 07:00", "2026-03-08 07:00"),
        ("America/New_York", date(2026, 3, 8), 179, "2026-03-08 07:00", "2026-03-08 07:59"),
        ("America/New_York", date(2026, 3, 8), 119, "2026-03-08 06:59", "2026-03-08 06:59"),
        ("America/New_York", date(2026, 3, 8), 180, "2026-03-08 07:00", "2026-03-08 07:00"),
        ("America/New_York", date(2026, 11, 1), 90, "2026-11-01 05:30", "2026-11-01 05:30"),  # 01:30 comes twice
        ("America/Sao_Paulo", date(2018, 11, 4), 0, "2018-11-04 03:00", "2018-11-04 03:00"),  # no midnight
        ("America/Sao_Paulo", date(2018, 11, 4), 45, "2018-11-04 03:00", "2018-11-04 03:45"),
        ("Australia/Lord_Howe", date(2026, 10, 4), 135, "2026-10-03 15:30", "2026-10-03 15:45"),  # half an hour
        ("Australia/Lord_Howe", date(2026, 4, 5), 105, "2026-04-04 14:45", "2026-04-04 14:45"),
        ("Asia/Kolkata", date(2026, 3, 8), 150, "2026-03-07 21:00", "2026-03-07 21:00"),
    ],
)
def test_instants_of_local_minutes(spark, zone, day, minute, first, shifted):
    row = spark.createDataFrame([(day, minute)], "d date, m int").select(*[times.instant_of_minute(F.col("d"), F.col("m"), zone, s).alias(str(s)) for s in (False, True)]).first()
    assert [str(t)[:16] for t in row] == [first, shifted]


def test_time_until_a_reminder(spark):
    config = Config(timezone="America/New_York", notifications=Notifications(streak_at_risk=True, reminder_time="02:30"))
    rows = spark.createDataFrame([(datetime(2026, 3, 8, 6, 0), False), (datetime(2026, 3, 8, 6, 0), True), (datetime(2026, 3, 8, 12, 0), False)], "t timestamp_ntz, sent boolean")
    assert [r[0] for r in rows.select(notify.ms_until_reminder(config, F.col("t"), F.col("sent"))).collect()] == [3_600_000, None, None]


def test_price_snapshots(spark, tmp_path):
    prices = spark.createDataFrame(RATES, pricing.PRICE_COLUMNS)
    path = str(tmp_path / "snapshot")
    pricing.write_snapshot(prices, path, 'a "source"', "2026-01-01")
    assert sorted(map(str, pricing.read_snapshot(spark, path).collect())) == sorted(map(str, prices.collect()))
    text = spark.read.text(path, wholetext=True).first()[0]
    assert text.startswith('{"source":"a \\"source\\"","license":"","fetchedAt":"2026-01-01","models":{"a":[1.0E-6,2.0E-6,null,1.0E-7,null,null,null,null,null,null],') and "272000," in text
    listed = {f"m{i}": {"input_cost_per_token": 1e-6, "output_cost_per_token": i * 1e-6, "cache_read_input_token_cost": 1e-7} for i in range(3)}
    user = tmp_path / "user.json"
    user.write_text(json.dumps(listed))
    from_file = pricing.read_price_file(spark, str(user), 3)
    pricing.write_snapshot(from_file, str(tmp_path / "again"), "s", "t")
    assert sorted(map(str, pricing.read_snapshot(spark, str(tmp_path / "again")).collect())) == sorted(map(str, from_file.collect()))
    assert pricing.price_source(spark, str(user), path, least=3)[1] == str(user)
    assert pricing.price_source(spark, str(user), path)[1] == path  # too few models
    assert pricing.price_source(spark, str(tmp_path / "none.json"), path)[1] == path
    (tmp_path / "bad.json").write_text("{")
    rows, source = pricing.price_source(spark, None, str(tmp_path / "bad.json"))
    assert rows.count() == 0 and source == ""


def roles_of(spark, kinds, days=None, reach=0.0, **options):
    rows = [(i, {"L": "lit", "B": "bridge", ".": "dark", "T": "today"}[k], (days or [1] * len(kinds))[i], int(k == "L"), reach if k == "T" else 1.0) for i, k in enumerate(kinds)]
    got = trail.run_roles(spark.createDataFrame(rows, "pos int, kind string, days bigint, lit_days bigint, reach double"), **options).orderBy("pos").collect()
    return "".join({"today": "T", "gap": ".", "filament": "f", "past": "p", "current": "c", "bridge": "b"}[r.role] for r in got), [(r.run, r.run_days) for r in got if r.run is not None], [r.pos for r in got if r.current]


def test_runs_and_roles(spark):
    assert roles_of(spark, "LLL.LT") == ("ppp.cT", [(0, 3), (0, 3), (0, 3), (4, 1)], [4])
    assert roles_of(spark, "LL.LBLB.T") == ("ff.pbpb.T", [(0, 2), (0, 2), (3, 3), (3, 3), (3, 3), (6, 1)], [])  # a bridge behind a run is one by itself
    assert roles_of(spark, "BBLBBT") == ("bbcbbT", [(2, 3), (2, 3), (2, 3)], [2, 3, 4])  # open: today can still extend it
    assert roles_of(spark, "L..T", reach=1.2) == ("f..T", [(0, 1), (3, 1)], [3])
    assert roles_of(spark, ".L.L..LT", bridge_gaps=1)[0] == ".fff..cT"
    assert roles_of(spark, ".L.L..LT", bridge_gaps=2)[0] == ".fffffcT"
    assert roles_of(spark, "L.LT", days=[7, 7, 7, 1])[0] == "p.cT"
    assert roles_of(spark, "T", reach=2.0) == ("T", [(0, 1)], [0]) and roles_of(spark, "BBT")[0] == "bbT"


def test_smoothing_ends_at_masked_points(spark):
    values = [1.0, 5.0, 2.0, 9.0, 9.0, 0.0, 4.0, 4.0, 8.0, 1.0]
    masks = [True, True, False, True, True, True, None, True, True, True]
    rows = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(values, masks, strict=True))], "pos int, v double, m boolean")
    for sigma in (0.2, 0.7, 1.5, 4.0):
        reach, want = math.ceil(2.5 * sigma), []
        for i, v in enumerate(values):
            if sigma < 0.3 or not masks[i]:
                want.append(v)
                continue
            near = [j for j in range(max(0, i - reach), min(len(values), i + reach + 1)) if all(masks[min(i, j) : max(i, j) + 1])]
            weights = [math.exp(-((i - j) ** 2) / (2 * sigma**2)) for j in near]
            want.append(sum(w * values[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
        got = [r.smooth for r in trail.smoothed(rows, sigma, "v", F.col("m")).orderBy("pos").collect()]
        assert got == pytest.approx(want)
    assert [r.smooth for r in trail.smoothed(rows.limit(2), 2.0, "v").orderBy("pos").collect()] == values[:2]


def test_trail_ranges(spark):
    kinds = "date date, today date, total bigint, goal bigint, met boolean, rest boolean, frozen boolean, input bigint, cache_read bigint, cache_write bigint, claude bigint, codex bigint, gemini bigint"
    day = lambda n: date(2026, 3, n)
    rows = [(day(n), day(6), n * 10, 0 if n < 3 else 30, n >= 3, n == 2, n == 4, n * 4, n * 4, n * 2, n * 10, 0, 0) for n in range(1, 7)]
    streaks = spark.createDataFrame(rows, kinds)
    got = {r.date.day: (r.goal, r.goal_met, r.frozen, r.freeze, r.cache_share) for r in trail.trail_days(streaks, 5).collect()}
    assert got == {1: (30, False, False, False, 0.4), 2: (30, False, True, False, 0.4), 3: (30, True, False, False, 0.4), 4: (30, True, True, True, 0.4), 5: (30, True, False, False, 0.4)}
    history, head = trail.trail_range(streaks, F.lit(day(2)), F.lit(day(4)))
    assert sorted(r.date.day for r in history.collect()) == [2, 3] and [(r.date, r.tokens, r.claude_share) for r in head.collect()] == [(day(4), 40, 1.0)]
    assert [(r.date.day, r.goal) for r in history.orderBy("date").collect()] == [(2, 30), (3, 30)]  # the day without a goal has today's here too
    history, head = trail.trail_range(streaks, F.lit(day(2)), F.lit(day(20)))
    assert sorted(r.date.day for r in history.collect()) == [2, 3, 4, 5] and head.first().date == day(6)



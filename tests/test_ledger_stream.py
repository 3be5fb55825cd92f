"""The ledger that follows growing logs against a ledger built anew from all lines, after each batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from meterlake.operators.pricing import PRICE_COLUMNS
from meterlake.plans.engine import build_ledger, raw_events
from meterlake.sources import codex, gemini
from meterlake.sources.logs import Root
from meterlake.streaming import tail
from meterlake.streaming.follow import as_lines
from meterlake.streaming.ledger import LedgerStream, without_deleted

COLUMNS = ["ts", "date", "tool", "model", "project", "session", "input", "output", "cache_write", "cache_read", "reasoning", "total", "cost"]


def claude_line(second, msg, out, cwd="/home/u/web-app", **more):
    row = {"timestamp": f"2026-03-02T08:00:{second:02d}.000Z", "sessionId": "s1", "requestId": f"q{msg}", "cwd": cwd, "message": {"id": f"m{msg}", "model": "claude-opus-4-6", "usage": {"input_tokens": 7, "output_tokens": out}}}
    return json.dumps(row | more, separators=(",", ":"))


def codex_meta(session, second=0, parent=None, cwd="/home/u/tool"):
    return json.dumps({"timestamp": f"2026-03-02T09:00:{second:02d}.000Z", "type": "session_meta", "payload": {"id": session, "cwd": cwd, **({"forked_from_id": parent} if parent else {})}})


def codex_context(model):
    return json.dumps({"timestamp": "2026-03-02T09:00:00.000Z", "type": "turn_context", "payload": {"model": model}})


def codex_tier(tier):
    return json.dumps({"timestamp": "2026-03-02T09:00:00.000Z", "type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"service_tier": tier}}})


def codex_count(second, given, out, minute=0):
    total = {"input_tokens": given, "cached_input_tokens": given // 3, "output_tokens": out, "total_tokens": given + out}
    return json.dumps({"timestamp": f"2026-03-02T09:{minute:02d}:{second:02d}.000Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total}}})


def gemini_line(second, msg, out, **more):
    return json.dumps({"type": "gemini", "id": msg, "timestamp": f"2026-03-02T10:00:{second:02d}.000Z", "tokens": {"input": 11, "output": out, "cached": 2}} | more)


def write(path, *lines, end="\n", mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


@pytest.fixture
def place(spark, tmp_path):
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}  # few rows: compiling would take longer
    before = {k: spark.conf.get(k) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    roots = [Root("claude", f"{tmp_path}/claude", "claude:c"), Root("codex", f"{tmp_path}/codex/sessions", "codex:x"), Root("codex", f"{tmp_path}/codex/archived_sessions", "codex:x"), Root("gemini", f"{tmp_path}/gemini", "gemini:g")]
    for r in roots:
        os.makedirs(r.path)
    prices = spark.createDataFrame([], PRICE_COLUMNS)
    yield tmp_path, LedgerStream(spark, f"{tmp_path}/out", roots, prices, buckets=8)
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(ledger):
    return sorted(tuple(r) for r in ledger.select(*[F.col(c).cast("string") if c in ("ts", "date") else F.round(c, 9) if c == "cost" else F.col(c) for c in COLUMNS]).na.fill("-").collect())


def rebuilt(spark, stream, without=()):
    """The ledger of all lines that are there now."""
    lines = None
    for order, root in enumerate(stream.roots):
        rows = as_lines(tail.lines_now(spark, root.path).filter("not provisional"), root.tool, order)
        lines = rows if lines is None else lines.unionByName(rows)
    lines = lines.filter(~F.col("path").isin(*without)) if without else lines
    return rows_of(build_ledger(raw_events(lines), stream.prices, stream.config))


def test_each_batch_equals_a_ledger_built_anew(spark, place):
    where, stream = place
    a, b = f"{where}/claude/-home-u-web-app/a.jsonl", f"{where}/claude/-home-u-web-app/b.jsonl"
    parent, child = f"{where}/codex/sessions/2026/p.jsonl", f"{where}/codex/sessions/2026/a-child.jsonl"
    chat = f"{where}/gemini/proj/chats/c.jsonl"
    write(a, claude_line(1, 1, 5, cwd="/elsewhere"), claude_line(2, 1, 9, cwd="/elsewhere"), claude_line(3, 2, 4, cwd="/elsewhere"))
    write(parent, codex_meta("P"), codex_context("gpt-5.4"), codex_count(5, 100, 10), codex_count(6, 250, 30))
    write(chat, json.dumps({"sessionId": "G1", "model": "gemini-3-pro"}), gemini_line(1, "x", 5), gemini_line(2, "y", 6))
    stream.run()
    assert rows_of(stream.ledger()) == rebuilt(spark, stream)
    first = stream.reports()[0]
    assert (first.files, first.new, first.appended, first.lines, first.duplicates, first.events) == (3, 3, 0, 10, 1, 6)

    # totals, model and session go on from what the lines before said; a fork starts with its parent's events; a copy of a message is worth more
    write(parent, codex_tier("priority"), codex_count(7, 400, 45), "{ damaged \"type\": \"event_msg\"")
    write(child, codex_meta("C", 30, parent="P"), codex_count(5, 100, 10), codex_count(6, 250, 30), codex_context("gpt-5.5"), codex_count(40, 300, 50))
    write(chat, gemini_line(3, "x", 50), gemini_line(4, "z", 1))
    write(b, claude_line(9, 2, 44), claude_line(10, 3, 1))
    stream.run()
    assert rows_of(stream.ledger()) == rebuilt(spark, stream)
    report = max((r for r in stream.reports() if r.lines), key=lambda r: r.version)
    assert (report.files, report.new, report.appended, report.reparsed, report.malformed) == (5, 2, 2, 0, 1)

    # the folder's own name turns up; a file is replaced; a restarted process goes on
    write(a, claude_line(20, 9, 2))
    write(f"{where}/new", json.dumps({"sessionId": "G2", "model": "gemini-3-flash"}), gemini_line(5, "x", 3), gemini_line(6, "w", 3), gemini_line(6, "w", 7), gemini_line(7, "v", 3), gemini_line(8, "u", 3))
    os.replace(f"{where}/new", chat)
    write(child, codex_count(41, 420, 55), end="")  # waits for its newline
    again = LedgerStream(spark, f"{where}/out", stream.roots, stream.prices, buckets=8)
    again.run()
    assert rows_of(again.ledger()) == rebuilt(spark, again)
    assert {r.project for r in again.ledger().filter("tool = 'claude'").collect()} == {"web-app"}
    report = max((r for r in again.reports() if r.lines), key=lambda r: r.version)
    assert (report.new, report.appended, report.reparsed) == (0, 1, 1)

    # deleted files stay, or go by setting; archived ones count once
    os.makedirs(f"{where}/codex/archived_sessions/2026")
    os.rename(parent, f"{where}/codex/archived_sessions/2026/p.jsonl")
    os.remove(b)
    kept = rows_of(again.ledger())
    again.sweep()
    assert rows_of(again.ledger()) == kept
    write(f"{where}/codex/sessions/2026/a-child.jsonl", "")
    again.run()
    gone = without_deleted(again)
    report = gone.sweep()
    assert rows_of(gone.ledger()) == rebuilt(spark, gone) and report.removed == 2
    assert gone.engine().daily.count() == 1


def test_a_batch_may_run_twice(spark, place):
    where, stream = place
    write(f"{where}/claude/-home-u-web-app/a.jsonl", claude_line(1, 1, 5), claude_line(2, 1, 9))
    lines = lambda: as_lines(tail.lines_now(spark, f"{where}/claude"), "claude").selectExpr("*", "0L as generation", "'claude:c' as root_group", "0 as root_order", "octet_length(line) as bytes")
    stream.take(lines(), 0)
    want, files = rows_of(stream.ledger()), sorted(map(str, stream.files().collect()))
    stream.sweep()
    stream.take(lines(), 0)
    assert rows_of(stream.ledger()) == want and stream._read("raw").count() == 2
    assert sorted(map(str, stream.files().collect())) == files and stream.versions() == [0]


def test_readers_go_on_from_their_state(spark):
    """Three parts of a file, each parsed alone after the one before, give the events of the whole."""
    def lines(tool, texts, since=0):
        rows = [(tool, "0000\x01f", "/f", "p/chats/f.jsonl", 0, since + i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "tool string, file_order string, path string, rel string, mtime_ms bigint, line_no bigint, line string")

    texts = [codex_meta("P", cwd="/w/x"), codex_count(1, 50, 5), codex_context("gpt-5.5"), "plain", codex_tier("fast"), codex_count(2, 90, 9), codex_count(2, 90, 9), codex_context("gpt-5.4"), codex_count(3, 95, 10), codex_meta("Q"), codex_count(4, 20, 2)]
    whole, facts = codex.read(lines("codex", texts))
    state, got = spark.createDataFrame([], codex.STATE), []
    for lo, hi in ((0, 1), (1, 6), (6, 11)):
        events, state = codex.read_on(lines("codex", texts[lo:hi], lo), state)
        got += events.collect()
    assert got == whole.orderBy("line_no").collect() and len(got) == 3
    assert codex.file_facts(state).collect() == facts.collect()
    texts = [json.dumps({"sessionId": "A"}), gemini_line(1, "a", 1, model="gemini-3"), gemini_line(2, "b", 2), json.dumps({"session_id": "B", "model": "gemini-4"}), gemini_line(3, "c", 3)]
    whole = gemini.read(lines("gemini", texts)).orderBy("line_no").collect()
    state, got = spark.createDataFrame([], gemini.STATE), []
    for lo, hi in ((0, 2), (2, 4), (4, 5)):
        events, state = gemini.read_on(lines("gemini", texts[lo:hi], lo), state)
        got += events.collect()
    assert got == whole and [(r.session, r.model) for r in got] == [("A", "gemini-3"), ("A", "gemini-3"), ("B", "gemini-4")]


def test_batches_grow_fourfold(tmp_path):
    """17 GB of files (sizes only) in seven steps, the newest first; every byte once."""
    stream = tail._Stream({"path": str(tmp_path), "progressive": "true"})
    mb, sizes = 1 << 20, []
    total = 17 << 30
    while sum(sizes) < total:
        assert stream.budget() == 32 * mb * 4 ** len(sizes)
        sizes.append(min(int(stream.budget()), total - sum(sizes)))
        stream.known = {"f": [1, sum(sizes), 0]}
    assert len(sizes) in (6, 7)


def test_partial_ledgers_of_a_first_scan(spark, place):
    where, stream = place
    for i, name in enumerate(("old", "mid", "new")):
        path = f"{where}/claude/-home-u-web-app/{name}.jsonl"
        write(path, *(claude_line(i * 10 + j, i * 10 + j, 5) for j in range(4)), claude_line(50, 99, 3 + i))
        os.utime(path, (i, i))
    stream.run(progressive=True, maxBytesPerBatch="600")
    steps = [r for r in stream.reports() if r.lines]
    assert len(steps) > 1 and [r.events for r in steps] == sorted(r.events for r in steps)
    assert rows_of(stream.ledger()) == rebuilt(spark, stream) and steps[-1].duplicates == 2

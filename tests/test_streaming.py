"""Growing logs: appended lines, unfinished ones, files that are replaced; the stream's table against a batch read."""

import json
import os

from pyspark.sql import functions as F

from meterlake.streaming import follow, tail


def line(i, text="x"):
    return json.dumps({"i": i, "text": text})


def write(path, *lines, end="\n", mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


def once(spark, logs, folder, **options):
    query = follow.follow(spark, str(logs), str(folder), **options)
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((r.rel, r.generation, json.loads(r.line)["i"]) for r in follow.current_lines(spark, follow.places(str(folder))[0]).collect())


def test_the_table_follows_the_files(spark, tmp_path):
    logs, where = tmp_path / "logs", tmp_path / "bronze"
    a, b = str(logs / "p/a.jsonl"), str(logs / "p/deep/b.jsonl")
    write(a, line(1), "", line(2))
    write(b, line(10), line(11), end="")  # the last line waits for its newline
    write(str(logs / "p/c.txt"), line(99))
    assert once(spark, logs, where) == [("p/a.jsonl", 0, 1), ("p/a.jsonl", 0, 2), ("p/deep/b.jsonl", 0, 10)]
    write(a, line(3))
    write(b, "", line(12))
    rows = [("p/a.jsonl", 0, i) for i in (1, 2, 3)] + [("p/deep/b.jsonl", 0, i) for i in (10, 11, 12)]
    assert once(spark, logs, where) == rows
    assert once(spark, logs, where) == rows  # nothing new
    batch = tail.lines_now(spark, str(logs)).collect()
    assert sorted((r.rel, r.generation, json.loads(r.line)["i"]) for r in batch) == rows and not any(r.provisional for r in batch)
    write(a, line(7), mode="w")  # cut off and written anew
    assert once(spark, logs, where) == [("p/a.jsonl", 1, 7), *rows[3:]]
    os.remove(b)
    assert once(spark, logs, where) == [("p/a.jsonl", 1, 7), *rows[3:]]  # what a deleted file had stays
    write(a, line(8), end="")
    now = tail.lines_now(spark, str(logs))
    current = follow.current_lines(spark, follow.places(str(where))[0], provisional=now, only=now)
    assert sorted((json.loads(r.line)["i"], r.provisional) for r in current.collect()) == [(7, False), (8, True)]  # or goes, and unfinished lines show


def read_all(stream, start, end):
    return [row for p in stream.partitions(start, end) for row in stream.read(p)]


def test_pieces_share_out_every_line_once(tmp_path):
    path = str(tmp_path / "a.jsonl")
    write(path, *(line(i, "é" * (i % 7) * 10) for i in range(60)), end="")
    size = os.path.getsize(path)
    for piece in (1, 3, 40, 41, 1000, size, 10 * size):
        batch = tail._Batch({"path": str(tmp_path), "pieceBytes": str(piece)})
        rows = [r for p in batch.partitions() for r in batch.read(p)]
        assert [json.loads(r[4])["i"] for r in rows] == list(range(60)) and [r[5] for r in rows] == [False] * 59 + [True]
        stream = tail._Stream({"path": str(tmp_path), "pieceBytes": str(piece)})
        assert [json.loads(r[4])["i"] for r in read_all(stream, stream.initialOffset(), stream.latestOffset())] == list(range(59))


def test_lines_longer_than_a_batch(tmp_path):
    write(str(tmp_path / "a.jsonl"), line(1, "é" * 5000), line(2), line(3), end="")
    stream = tail._Stream({"path": str(tmp_path), "maxBytesPerBatch": "100"})
    start, seen = stream.initialOffset(), []
    while (end := stream.latestOffset()) != start:
        seen.append([json.loads(r[4])["i"] for r in read_all(stream, start, end)])
        start = end
    assert seen == [[1], [2]]


def test_a_failed_batch_reads_the_same_again_after_a_crash(tmp_path):
    path = str(tmp_path / "a.jsonl")
    write(path, line(1), line(2))
    stream = tail._Stream({"path": str(tmp_path), "maxBytesPerBatch": "10"})
    start = stream.initialOffset()
    end = stream.latestOffset()
    rows = read_all(stream, start, end)
    again = tail._Stream({"path": str(tmp_path), "maxBytesPerBatch": "10"})  # a new process plans the last batch first
    assert read_all(again, start, end) == rows and len(rows) == 1
    write(path, line(3))
    after = again.latestOffset()
    assert [json.loads(r[4])["i"] for r in read_all(again, end, after)] == [2]
    os.rename(path, str(tmp_path / "b.txt"))
    write(path, line(9))
    assert not read_all(again, end, after)  # its bytes are gone; the new file is the next generation
    last = again.latestOffset()
    assert [(r[2], json.loads(r[4])["i"]) for r in read_all(again, after, last)] == [(1, 9)]


def test_newest_files_come_first(tmp_path):
    for i, name in enumerate(("old", "new", "mid")):
        write(str(tmp_path / f"{name}.jsonl"), line(i))
        os.utime(tmp_path / f"{name}.jsonl", (0, {"old": 10, "mid": 20, "new": 30}[name]))
    stream = tail._Stream({"path": str(tmp_path)})
    assert [p.rel for p in stream.partitions(stream.initialOffset(), stream.latestOffset())] == ["new.jsonl", "mid.jsonl", "old.jsonl"]
    bounded = tail._Stream({"path": str(tmp_path), "maxBytesPerBatch": "1"})
    assert [p.rel for p in bounded.partitions(bounded.initialOffset(), bounded.latestOffset()) if p.end > p.start] == ["new.jsonl"]


def test_one_call_reads_more_than_a_batch(spark, tmp_path):
    for name in ("a", "b", "c"):
        write(str(tmp_path / f"logs/{name}.jsonl"), *(line(i, "x" * 50) for i in range(3)))
    write(str(tmp_path / "logs/c.jsonl"), line(9), end="")  # waits for its newline, and isn't waited for
    rows = once(spark, tmp_path / "logs", tmp_path / "bronze", maxBytesPerBatch="200")
    assert rows == [(f"{name}.jsonl", 0, i) for name in "abc" for i in range(3)]


def test_provisional_lines_and_files(spark, tmp_path):
    write(str(tmp_path / "a.jsonl"), line(1), line(2), end="")
    rows = tail.lines_now(spark, str(tmp_path))
    assert [r.provisional for r in rows.orderBy("start").collect()] == [False, True]
    lines = follow.as_lines(rows, "claude").orderBy("file_order", "line_no").collect()
    assert [json.loads(x.line)["i"] for x in lines] == [1, 2]


def test_running_daily_sums(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2026-03-08 07:30:00' as ts, 5L as total union all select timestamp_ntz'2026-03-08 08:30:00', 7L union all select timestamp_ntz'2026-03-01 12:00:00', 1L")
    rows.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = follow.daily_sums(events, "America/Los_Angeles").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    query.processAllAvailable()
    query.stop()
    got = {str(r.date): (r.total, r.messages) for r in spark.table("sums").collect()}
    assert got == {"2026-03-01": (1, 1), "2026-03-07": (5, 1), "2026-03-08": (7, 1)}
    assert spark.table("sums").select(F.sum("total")).first()[0] == 13

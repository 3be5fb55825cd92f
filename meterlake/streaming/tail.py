"""A stream of lines from files that grow.

Spark's own file streams read a file once. This source remembers for each file its inode and how far it
was read; each batch has the whole lines that were added since. A file that was replaced or cut off is
read anew as its next generation, and rows carry the generation so that a table can drop the older one.
The last line, while it lacks its newline, waits.

The driver only looks at sizes and for the last newline of files that grew. Executors read the lines, in pieces
of bounded size, those of the newest files first. The offset is a JSON map with an entry for each file. Files must be
readable where tasks run (a folder that all nodes mount).
"""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, rel string, generation long, start long, line string, provisional boolean, mtime_ms long"
#: A task reads the lines that begin in so many bytes of a file.
PIECE_BYTES = 32 << 20
_STEP = 1 << 16


class LogTail(DataSource):
    """Options: path, suffix (``.jsonl``), maxBytesPerBatch (all that is there), progressive, pieceBytes; as a batch it reads all lines, unfinished ones too.

    ``progressive`` lets batches grow: the first has maxBytesPerBatch (32 MB), each later one three times what was read so far and as much again.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def found_files(root: str, suffix: str) -> list[str]:
    out = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(suffix)]
    return sorted(out)


def stamps(root: str, suffix: str) -> list[tuple[str, os.stat_result]]:
    """Files and their facts now; those that vanish meanwhile are left out."""
    out = []
    for path in found_files(root, suffix):
        with contextlib.suppress(FileNotFoundError):
            out.append((path, os.stat(path)))
    return out


def last_line_end(path: str, start: int, end: int) -> int:
    """Where the last whole line in [start, end) ends; ``start`` if none does."""
    with open(path, "rb") as f:
        while end > start:
            at = max(start, end - _STEP)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return start


def first_line_end(path: str, start: int) -> int:
    """Where the line at ``start`` ends; ``start`` if it isn't finished."""
    at = start
    with open(path, "rb") as f:
        f.seek(start)
        while data := f.read(_STEP):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
    return start


class Piece(InputPartition):
    """The lines of a file that begin in [start, end); ``begin`` is a line's start at or before it, ``inode`` the file's."""

    def __init__(self, path: str, rel: str, generation: int, begin: int, start: int, end: int, inode: int):
        self.path, self.rel, self.generation, self.begin, self.start, self.end, self.inode = path, rel, generation, begin, start, end, inode


def pieces(path: str, rel: str, generation: int, begin: int, end: int, inode: int, size: int) -> list[Piece]:
    return [Piece(path, rel, generation, begin, at, min(at + size, end), inode) for at in range(begin, end, size)]


def read_piece(p: Piece, unfinished: bool = False) -> Iterator[tuple]:
    """Rows of the lines that begin in a piece; of a file that is no longer the one planned, none."""
    try:
        f = open(p.path, "rb")  # noqa: SIM115
    except FileNotFoundError:
        return
    with f:
        facts = os.fstat(f.fileno())
        if facts.st_ino != p.inode:
            return
        at = p.start
        if at > p.begin:  # a line that begins before the piece is its neighbour's
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(at)
        while at < p.end:
            line = f.readline()
            whole = line.endswith(b"\n")
            if not line or not (whole or unfinished):
                return
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if text.strip():
                yield (p.path, p.rel, p.generation, at, text, not whole, facts.st_mtime_ns // 1_000_000)
            at += len(line)


class _Stream(DataSourceStreamReader):
    """Offsets are {path: [inode, end of the lines read, generation]}.

    Spark plans a query's last batch again before it asks for a new offset, so ``partitions`` tells a reader that
    begins anew how far its files were read.
    """

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.grows = options.get("progressive", "false").lower() == "true"
        self.most = int(options.get("maxBytesPerBatch", PIECE_BYTES if self.grows else 0))
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def budget(self) -> float:
        """Bytes of the next batch. Growing ones are four times the one before: sizes so far sum to a third of the next, less the first."""
        if not self.grows:
            return self.most or float("inf")
        return self.most + 3 * sum(at for _, at, _ in self.known.values())

    def latestOffset(self) -> dict:
        found, left = [], self.budget()
        for path, stat in stamps(self.root, self.suffix):
            inode, at, generation = self.known.get(path, [stat.st_ino, 0, 0])
            if inode != stat.st_ino or stat.st_size < at:
                inode, at, generation = stat.st_ino, 0, generation + 1
            found.append((-stat.st_mtime_ns, path, inode, at, generation, stat.st_size))
        after = dict(self.known)  # history of deleted files stays
        for _, path, inode, at, generation, size in sorted(found):
            end = at
            if size > at and left > 0:
                end = last_line_end(path, at, int(min(size, at + left)))
                if end == at and at + left < size:  # a line longer than the rest of the batch
                    end = first_line_end(path, at)
                left -= end - at
            after[path] = [inode, end, generation]
        self.known = after
        return {"files": json.dumps(after, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        first, last = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or last
        ages = {path: stat.st_mtime_ns for path, stat in stamps(self.root, self.suffix)}
        out = []
        for path, (inode, upto, generation) in last.items():
            was = first.get(path, [inode, 0, 0])
            begin = was[1] if was[2] == generation else 0
            age = -ages.get(path, 0)
            out += [(age, path, p.start, p) for p in pieces(path, os.path.relpath(path, self.root), generation, begin, upto, inode, self.piece)]
        return [p for *_, p in sorted(out, key=lambda x: x[:3])] or [Piece("", "", 0, 0, 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_piece(partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))

    def partitions(self) -> list[Piece]:
        out = []
        for path, stat in stamps(self.root, self.suffix):
            out += pieces(path, os.path.relpath(path, self.root), 0, 0, stat.st_size, stat.st_ino, self.piece)
        return out or [Piece("", "", 0, 0, 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_piece(partition, unfinished=True)


def tail(spark: SparkSession, path: str, suffix: str = ".jsonl", **options) -> DataFrame:
    """The stream of whole lines added to files below ``path``."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("suffix", suffix).options(**options).load()


def lines_now(spark: SparkSession, path: str, suffix: str = ".jsonl", **options) -> DataFrame:
    """All lines now, unfinished last ones marked provisional."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("path", path).option("suffix", suffix).options(**options).load()

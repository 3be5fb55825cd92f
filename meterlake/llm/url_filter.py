"""URL filters: all glob rules run at once over a URL as one bit-parallel Shift-And automaton.

Every glob becomes a chain of states, all chains lie side by side in one bit string of several
64-bit words. A step over a character shifts the whole string by a bit, keeps the bits whose
state accepts the character, and keeps bits that loop (``*``). numpy takes the step for all URLs of
a batch at once, longest first, so that a step touches only URLs that still have characters.

URLs are brought to one form first: no user, port or dot at the host's end, no repeated slashes, lower case.
Nothing is shuffled; the automaton (bounded by the rule list) travels with the task, and the number of URLs
that run at once falls with its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import LOWER_TABLE, codes, runs, tidy

#: (action, host and path); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Globs over ``.host/path`` in canonical form that block a URL which no rule fits, unless a caller gives a list.
GLOBS = (
    # hosts of spam, gambling, pills, adult and pirated things
    "*spam**", "*bets**", "*casino**", "*poker**", "*jackpot**", "*pills**", "*viagra**", "*xxx**", "*porn**", "*warez**", "*torrent**", "*keygen**",
    # hosts that serve advertisements, count clicks or shorten addresses
    "*.ads.*/**", "*.adserver.*/**", "*.doubleclick.*/**", "*.tracker.*/**", "*.click.*/**", "*.bit.ly/**", "*.t.co/**", "*.tinyurl.com/**",
    # pages of a site's machinery
    "**/wp-login.php", "**/wp-admin/**", "**/xmlrpc.php", "**/cgi-bin/**", "**/login", "**/signin", "**/cart/**", "**/checkout/**",
    # files that aren't pages
    "**.exe", "**.msi", "**.dmg", "**.apk", "**.iso", "**.zip", "**.rar",
)
#: Words of the automatons' states that run at once.
STATE_WORDS = 1 << 20


def read_globs(spark: SparkSession, path: str) -> list[str]:
    """Globs of a text file, one a line; blank lines and those that begin with ``#`` are left out. The list is broadcast with tasks, so over ``MAX_GLOBS`` are an error."""
    lines = spark.read.text(path).select(F.btrim("value").alias("g")).filter("g <> '' and not startswith(g, '#')").limit(MAX_GLOBS + 1).collect()
    if len(lines) > MAX_GLOBS:
        raise ValueError(f"over {MAX_GLOBS} globs")
    return [r.g for r in lines]


MAX_GLOBS = 50_000


class GlobAutomaton:
    """Globs over whole strings: ``**`` any run, ``*`` a run without ``/``, ``?`` one character but ``/``, ``\\`` quotes."""

    def __init__(self, globs: list[str]):
        parsed = [self._parse(g) for g in globs]
        alphabet = sorted({"/"} | {t for tokens, _ in parsed for t in tokens if t})
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        slash, n_classes = alphabet.index("/") + 1, len(alphabet) + 1
        n_bits = max(sum(len(tokens) + 1 for tokens, _ in parsed), 1)
        accept = np.zeros((n_classes, n_bits), bool)
        loop = np.zeros((n_classes, n_bits), bool)
        start, self.ends, at = np.zeros(n_bits, bool), [], 0
        for tokens, stars in parsed:
            start[at] = True
            for s, token in enumerate(tokens, 1):
                if token:
                    accept[alphabet.index(token) + 1, at + s] = True
                else:
                    accept[:, at + s], accept[slash, at + s] = True, False
            for s, star in enumerate(stars):
                if star:
                    loop[:, at + s] = True
                    loop[slash, at + s] = star == 2
            at += len(tokens) + 1
            self.ends.append(at - 1)
        self.accept, self.loop, self.start = self._pack(accept), self._pack(loop), self._pack(start[None])[0]

    @staticmethod
    def _parse(glob: str) -> tuple[list[str], list[int]]:
        """Tokens ('' is ``?``), and for each state 0 none, 1 ``*``, 2 ``**``."""
        tokens, stars, i = [], [0], 0
        while i < len(glob):
            if glob[i] == "*":
                wide = glob[i : i + 2] == "**"
                stars[-1] = max(stars[-1], 1 + wide)
                i += 1 + wide
                continue
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
                tokens.append(glob[i])
            else:
                tokens.append("" if glob[i] == "?" else glob[i])
            stars.append(0)
            i += 1
        return tokens, stars

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        """Rows of bits as uint64 words, the first bit lowest."""
        wide = np.zeros((bits.shape[0], -(-bits.shape[1] // 64) * 64), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def match(self, strings: list[str]) -> np.ndarray:
        """A row for each string, a column for each glob: whether the glob fits the whole string."""
        out = np.zeros((len(strings), len(self.ends)), bool)
        lengths = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-lengths, kind="stable")
        most = max(STATE_WORDS // len(self.start), 1)
        for lo, hi in runs(lengths[order], 2_000_000):
            for at in range(lo, hi, most):
                part = order[at : min(at + most, hi)]
                out[part] = self._run([strings[i] for i in part], lengths[part])
        return out

    def _run(self, strings: list[str], lengths: np.ndarray) -> np.ndarray:
        flat, offsets = codes(strings)
        at = np.searchsorted(self.alphabet, flat)
        near = self.alphabet[np.minimum(at, len(self.alphabet) - 1)]
        kinds = np.where(near == flat, at + 1, 0)
        state = np.tile(self.start, (len(strings), 1))
        one, top = np.uint64(1), np.uint64(63)
        active = len(strings)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            while active and lengths[active - 1] <= t:
                active -= 1
            now, kind = state[:active], kinds[offsets[:active] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:active] = (moved & self.accept[kind]) | (now & self.loop[kind])
        ends = np.array(self.ends, np.int64)
        return (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & one == one


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER_TABLE), path


def canonical(host: str, path: str) -> str:
    """``.host/path`` without user, port, dots at the host's end and repeated slashes; A-Z lower-cased."""
    bare = _PORT.sub("", host[host.rfind("@") + 1 :]).rstrip(".")
    return "." + bare + _SLASHES.sub("/", path).translate(LOWER_TABLE)


_PORT, _SLASHES = re.compile(r":[0-9]*\Z"), re.compile("/+")


def _quote(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(rule: str) -> list[str]:
    """Globs over ``.host/path`` for a rule: its host and all subdomains, paths that start with the rule's."""
    host, slash, path = rule.partition("/")
    if slash:
        return [f"*.{_quote(host)}/{_quote(path)}**"]
    return [f"*.{_quote(host)}", f"*.{_quote(host)}/**"]


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """A row for each row of ``pages``: the id, host, path, rule and verdict (allow or block).

    The longest rule that fits host and path decides; of rules of one length the first. Where none fits, a
    URL that one of ``globs`` fits in canonical form is blocked and any other allowed. A null url, or one without
    ``://``, has an empty host and path, which fit no rule; so it is allowed unless a glob fits ``.``. A url without
    a path has the empty path, which a rule with ``/`` doesn't fit. Null ids and repeated rows pass
    through; no other column is read, so names can't clash; an empty table gives no rows.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    compiled, owner = [], []
    for k, (_, rule) in enumerate(ranked):
        for g in rule_globs(rule):
            compiled.append(g)
            owner.append(k)
    by_rule, by_glob = GlobAutomaton(compiled), GlobAutomaton(list(globs))
    names, acts = [r for _, r in ranked], [a for a, _ in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = by_rule.match([f".{h}{p}" for h, p in parts])
            spam = by_glob.match([canonical(h, p) for h, p in parts]).any(axis=1)
            rule, verdict = [], []
            for hit, bad in zip(fits, spam, strict=True):
                k = owner[int(hit.argmax())] if hit.any() else None
                rule.append(None if k is None else names[k])
                verdict.append(("block" if bad else "allow") if k is None else acts[k])
            hosts, paths = zip(*parts, strict=True) if parts else ((), ())
            text = pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, text), pa.array(paths, text), pa.array(rule, text), pa.array(verdict, text)], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(tidy(judge), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")

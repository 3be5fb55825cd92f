"""Byte-level BPE: a segment tree over the ranks of adjacent pairs drives the merges.

A leaf holds the rank and place of the pair that begins there; the root is the leftmost pair of the
lowest rank. A merge sets three leaves and their paths anew (logarithmic), until the root is empty.

numpy keeps the trees of many pre-tokens side by side and takes a step of all at once.

Texts are cut into chunks (a space and what is not white space, or white space) that merges never
cross, so results are kept by chunk in a bounded table during a task. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meterlake.llm.common import text_runs, tidy

#: White space as Unicode's White_Space property has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_SAFE_CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: The fixed pattern of the vocabulary's pre-tokeniser.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+", regex.V0)
_NONE = 1 << 62
_PLACE = (1 << 40) - 1
#: Chunks kept at once; beyond, the table starts anew.
CACHE_CHUNKS = 200_000
#: Texts are handled in parts of about so many characters.
PART_CHARS = 1 << 19
#: Trees side by side have so many leaves together.
TREE_CELLS = 1 << 15


def _byte_chars() -> list[str]:
    """The printable stand-in for each byte, by the rule of byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class _Spellings:
    """Byte strings by id, joined for many ids at once."""

    def __init__(self, spelled: list[bytes]):
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids' byte strings one after the other, and where each begins (and the end)."""
        lengths = self.lengths[ids]
        at = np.concatenate([[0], np.cumsum(lengths)])
        return memoryview(self.flat[np.arange(at[-1]) + np.repeat(self.starts[ids] - at[:-1], lengths)]), at


class BytePairEncoder:
    """Encodes and decodes with a tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, packed: bytes):
        spec = json.loads(zlib.decompress(packed))
        vocab, chars = spec["vocab"], _byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        self.pair: dict[int, int] = {}  # rank and merged id in one number
        for rank, (a, b) in enumerate(spec["merges"]):
            self.pair.setdefault(vocab[a] << 24 | vocab[b], rank << 24 | vocab[a + b])
        self.bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.special = {t: i for t, i in spec["added"].items() if t}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        keys = sorted(self.pair)
        self.pair_keys = np.array(keys, np.int64)
        packed_pairs = np.array([self.pair[k] for k in keys], np.int64)
        self.pair_ranks = packed_pairs >> 24
        self.merged = np.zeros(len(spec["merges"]), np.int64)
        self.merged[self.pair_ranks] = packed_pairs & 0xFFFFFF
        self.byte_table = np.array(self.byte_ids, np.int64)
        size = max(self.bytes) + 1
        #: Ids are kept in 16 bits where they fit.
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.decimals = _Spellings([b"%d," % i for i in range(size)])
        self.spellings = _Spellings([self.bytes.get(i, b"") for i in range(size)])
        self.kept: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges of one pre-token."""
        n = len(ids)
        if n < 2:
            return ids
        pair, size = self.pair, 1 << (n - 2).bit_length()
        tree, result = [_NONE] * (2 * size), {}

        def leaf(i: int, j: int) -> int:
            found = pair.get(ids[i] << 24 | ids[j]) if j < n else None
            if found is None:
                return _NONE
            result[found >> 24] = found & 0xFFFFFF
            return found >> 24 << 40 | i

        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best

        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        while tree[1] != _NONE:
            i = tree[1] & _PLACE
            j = after[i]
            ids[i], alive[j] = result[tree[1] >> 40], False
            after[i] = after[j]
            before[after[j]] = i
            if j < n - 1:
                put(j, _NONE)
            put(i, leaf(i, after[i]))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, shifted to leave room for a place; _NONE for those that don't merge (or of a negative id)."""
        keys = a << 24 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys.take(at) == keys) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_ranks.take(at) << 40, _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` of many pre-tokens, ids as bytes of ``kind``: those of one tree size take each step together."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > 65:
                out[k] = np.array(self.merge([self.byte_ids[b] for b in piece]), self.kind).tobytes()
            else:
                by_size.setdefault(1 << (len(piece) - 2).bit_length() if len(piece) > 1 else 1, []).append(k)
        for size, own in by_size.items():
            step = max(TREE_CELLS // size, 1)
            for start in range(0, len(own), step):
                part = own[start : start + step]
                for k, ids in zip(part, self._merge_trees([pieces[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _merge_trees(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Trees of ``size`` leaves side by side; every array is flat, ``wide`` and ``deep`` are where a row's items and nodes begin."""
        n, width = len(pieces), size + 2
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        alive = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[alive] = self.byte_table[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((n, 2 * size), _NONE, np.int64)
        leaves = self._ranked(ids[:, :size], ids[:, 1 : size + 1])
        tree[:, size:] = np.where(leaves == _NONE, _NONE, leaves | np.arange(size))
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, width + 1), n)
        before = np.tile(np.arange(-1, width - 1), n)
        ids, tree, alive = ids.ravel(), tree.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * size] != _NONE)
        while len(rows):
            wide, deep, m = rows * width, rows * (2 * size), len(rows)
            root = tree.take(deep + 1)
            i = root & _PLACE
            a = wide + i
            j = after.take(a)
            k = after.take(wide + j)
            p = before.take(a)
            left = np.maximum(p, 0)
            new = self.merged.take(root >> 40)
            ids[a], alive[wide + j], after[a], before[wide + k] = new, False, k, i
            found = self._ranked(np.concatenate([new, np.where(p >= 0, ids.take(wide + left), -1)]), np.concatenate([ids.take(wide + k), new]))
            found[:m] |= np.where(found[:m] == _NONE, 0, i)
            found[m:] |= np.where(found[m:] == _NONE, 0, left)
            tree[np.where(j < size, deep + size + j, deep)] = _NONE
            tree[deep + size + i] = found[:m]
            tree[np.where(p >= 0, deep + size + left, deep)] = found[m:]
            nodes = np.concatenate([size + np.minimum(j, size - 1), size + i, size + left])
            base = np.concatenate([deep, deep, deep])
            level = size
            while level > 1:
                level >>= 1
                nodes >>= 1
                two = base + 2 * nodes
                tree[base + nodes] = np.minimum(tree.take(two), tree.take(two + 1))
            rows = rows[tree.take(deep + 1) != _NONE]
        flat, ends = ids[alive].astype(self.kind).tobytes(), np.cumsum(alive.reshape(n, width).sum(axis=1)) * self.kind.itemsize
        return [flat[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as bytes of ``kind``."""
        kept = self.kept
        new = {c for c in chunks if c not in kept}
        if new:
            if len(kept) + len(new) > CACHE_CHUNKS:
                self.forget()
                new = set(chunks)
            cut = {c: _PIECE.findall(c) for c in new if not (c.isascii() and (c[1:].isalpha() and c[0] == " " or c.isalpha()))}
            fresh = list({p for ps in cut.values() for p in ps if p not in kept} | (new - cut.keys()))
            for p, ids in zip(fresh, self.merge_many([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True):
                kept[p] = ids
            for c, ps in cut.items():
                if len(ps) > 1:
                    kept[c] = b"".join([kept[p] for p in ps])
            out = [kept[c] for c in chunks]
            for long in [c for c in (*new, *fresh) if len(c) > 64]:
                kept.pop(long, None)
            return out
        return [kept[c] for c in chunks]

    def forget(self) -> None:
        """Drop what is kept; tasks do so at their end, as a worker outlives them."""
        self.kept.clear()

    def parts(self, texts: list[str], added: bool = True) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
        """Parts of the texts in order: numbers of texts, the parts' ids, where each part's begin and the end.

        With ``added``, added tokens inside a text become their own ids, else they are bytes like any others.
        """
        numbers: list[int] = []
        waiting: list[list[str] | bytes] = []
        size = 0

        def flush() -> tuple[list[int], np.ndarray, list[int]]:
            found = iter(self.lookup([c for w in waiting if not isinstance(w, bytes) for c in w]))
            joined = [w if isinstance(w, bytes) else b"".join(itertools.islice(found, len(w))) for w in waiting]
            ends = [0, *itertools.accumulate(len(x) // self.kind.itemsize for x in joined)]
            return numbers[:], np.frombuffer(b"".join(joined), self.kind), ends

        for k, text in enumerate(texts):
            for odd, run in enumerate(self.split.split(text) if self.split and added else [text]):
                if odd % 2:
                    numbers.append(k)
                    waiting.append(np.array([self.special[run]], self.kind).tobytes())
                    continue
                start = 0
                while start < len(run):
                    end = len(run)
                    if end - start > PART_CHARS and (m := _SAFE_CUT.search(run, start + PART_CHARS)):
                        end = m.start()
                    numbers.append(k)
                    waiting.append(_CHUNK.findall(run[start:end]))
                    size += end - start
                    start = end
                    if size >= PART_CHARS:
                        yield flush()
                        numbers.clear()
                        waiting.clear()
                        size = 0
        yield flush()

    def encode(self, texts: list[str], added: bool = True) -> list[np.ndarray]:
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, flat, ends in self.parts(texts, added):
            for k, lo, hi in zip(numbers, ends[:-1], ends[1:], strict=True):
                ids[k].append(flat[lo:hi])
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, self.kind), *x]) for x in ids]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded text."""
        state = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        for numbers, flat, ends in self.parts(texts):
            decimals, at = self.decimals.join(flat)
            decoded, to = self.spellings.join(flat)
            for k, lo, hi in zip(numbers, ends[:-1], ends[1:], strict=True):
                if hi > lo:
                    mine = state[k]
                    if mine[0]:
                        mine[1].update(b",")
                    mine[0] += hi - lo
                    mine[1].update(decimals[at[lo] : at[hi] - 1])
                    mine[2].update(decoded[to[lo] : to[hi]])
        return [(n, ids.hexdigest(), text.hexdigest()) for n, ids, text in state]


def pack_tokenizer(path: str) -> bytes:
    """What tasks need of a tokenizer file; read on the driver, so executors needn't have the file.

    Added tokens that take in spaces or stand for whole words only are an error.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens with lstrip, rstrip or single_word aren't supported")
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return zlib.compress(json.dumps({"vocab": spec["model"]["vocab"], "merges": merges, "added": {t["content"]: t["id"] for t in spec["added_tokens"]}}).encode(), 6)


_ENCODERS: dict[bytes, BytePairEncoder] = {}


def encoder(packed: bytes) -> BytePairEncoder:
    """This worker's encoder; it outlives a task."""
    key = hashlib.sha256(packed).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BytePairEncoder(packed)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty; an empty one has no ids. Added tokens in a text become their own ids. Long
    texts are handled in parts cut where no merge reaches; null ids and repeated rows pass through,
    other columns aren't read, an empty table gives no rows.
    """
    packed = pack_tokenizer(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(packed)
        for batch in batches:
            rows = [row for _, texts in text_runs(batch.column(1), PART_CHARS) for row in bpe.digests([text or "" for text in texts])]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the array of token ids.

    A null or empty text has none; null ids and repeated rows pass through, other columns aren't read, an
    empty table gives no rows.
    """
    packed = pack_tokenizer(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(packed)
        for batch in batches:
            ids = [x.astype(np.int32) for x in bpe.encode([text or "" for text in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])
        bpe.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text that the ids stand for (null ids: empty); unknown ids are an error."""
    packed = pack_tokenizer(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(packed).bytes
        for batch in batches:
            texts = [b"".join([table[i] for i in ids.as_py() or []]).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, text string")

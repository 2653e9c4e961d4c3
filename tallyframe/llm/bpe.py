"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbours into a token of the vocabulary, so two bytes that stand side by side in no
token are never joined: the boundary between them is certain before any merging. Texts are cut into the
pre-tokens of the vocabulary's pattern and these at their certain boundaries; each fragment is merged on
its own and the ids are concatenated. Most pre-tokens recur, so a bounded table of finished ones does
most of the work: two generations, of which the older goes when the younger is full, so that what is in
use stays.

The vocabulary file is read and compiled once, on the driver; a task loads plain tables.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._shared import release, rows_of, share, shared, sized

#: The pre-token pattern of this public vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What it means for a text of ASCII characters without the separators 0x1C to 0x1F, which the faster reader takes for blanks.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NEVER = 1 << 60
_NONE = np.iinfo(np.int32).max
_SHIFT = 24
#: Fragments up to 64 bytes are merged side by side with others of about their length.
_LENGTHS = ((0, 1), (1, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, 64))


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others take the code points from 256 on in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """One vocabulary file as plain tables.

    ``tokens``: bytes by id. ``byte_ids``: the id of each byte. ``rank``: by ``left << 24 | right`` of two ids, the
    rank of their merge; ``made``: by rank, the id that it gives. ``inside``: whether two bytes stand side by side in
    a token; all other pairs are certain boundaries. ``special``: texts that become one id wherever they occur.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in chain(ids.items(), ((s.encode(), i) for s, i in self.special.items())):
            self.tokens[i] = t
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.rank, self.made = {}, []
        for r, m in enumerate(model["merges"]):
            a, b = map(to_bytes, m.split(" ") if isinstance(m, str) else m)
            self.rank[ids[a] << _SHIFT | ids[b]] = r
            self.made.append(ids[a + b])
        self.inside = np.zeros((256, 256), dtype=bool)
        for t in ids:
            for a, b in zip(t, t[1:]):
                self.inside[a, b] = True
        self._compile()

    def _compile(self) -> None:
        """Arrays for merging many fragments at a time: pairs in order with their ranks, and the ranks of all byte pairs."""
        self.keys = np.array(sorted(self.rank), dtype=np.int64)
        self.key_ranks = np.array([self.rank[k] for k in self.keys.tolist()] + [_NONE], dtype=np.int32)
        self.made_ids = np.array(self.made, dtype=np.int32)
        self.bytes_as_ids = np.array(self.byte_ids, dtype=np.int32)
        self.byte_ranks = self._ranks(np.repeat(self.bytes_as_ids, 256), np.tile(self.bytes_as_ids, 256))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        return self.key_ranks[np.where(found, at, len(self.keys))]

    def merge(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment as little-endian unsigned 32-bit integers.

        Fragments of similar length are merged side by side, a merge in each of them a round: that of least rank, the
        leftmost of equal ones. Long fragments, of which there are few, go by a heap.
        """
        out: list[bytes] = [b""] * len(fragments)
        sizes = np.array([len(x) for x in fragments], dtype=np.int64)
        for low, high in _LENGTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(some):
                ids, left = self._merge_equal([fragments[i] for i in some.tolist()], sizes[some], high)
                for i, row, n in zip(some.tolist(), ids, left.tolist(), strict=True):
                    out[i] = row[:n].tobytes()
        for i in np.flatnonzero(sizes > _LENGTHS[-1][1]).tolist():
            out[i] = np.array(self._merge_long([self.byte_ids[b] for b in fragments[i]]), dtype="<u4").tobytes()
        return out

    def _merge_equal(self, fragments: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in fragments]), dtype=np.uint8).reshape(-1, width)
        ids = self.bytes_as_ids[raw]
        done, count = np.empty(ids.shape, dtype="<u4"), np.empty(len(ids), dtype=np.int64)
        place, columns = np.arange(len(ids)), np.arange(width)
        # the last column, never a pair, makes room for the shift
        ranks = np.full(ids.shape, _NONE, dtype=np.int32)
        ranks[:, :-1] = self.byte_ranks[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        ranks[columns >= sizes[:, None] - 1] = _NONE
        left = sizes.copy()
        while len(ids):
            at = ranks.argmin(axis=1)
            row = np.arange(len(ids))
            least = ranks[row, at]
            live = least < _NONE
            if not live.all():
                end = ~live
                done[place[end]], count[place[end]] = ids[end], left[end]
                ids, ranks, left, place, at, least = ids[live], ranks[live], left[live], place[live], at[live], least[live]
                row = row[: len(ids)]
                if not len(ids):
                    break
            # what stands behind the pair moves up by one
            behind = columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(columns[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ids[row, at] = self.made_ids[least]
            left -= 1
            for first, some in ((at - 1, at > 0), (at, at < left - 1)):
                k = np.flatnonzero(some)
                f = first[k]
                ranks[k, f] = self._ranks(ids[k, f], ids[k, f + 1])
        return done, count

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between neighbours, so that long runs stay cheap."""
        n, get = len(ids), self.rank.get
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << _SHIFT | ids[i + 1], _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], live[j] = self.made[rank], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(ids[x] << _SHIFT | ids[y], _NEVER)) < _NEVER:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, keep in zip(ids, live, strict=True) if keep]

    def fragments(self, pieces: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The pre-tokens cut at their certain boundaries, one after the other, and how many parts each has."""
        data = b"".join(pieces)
        arr = np.frombuffer(data, dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        cut = np.zeros(len(arr) + 1, dtype=bool)
        cut[1:-1] = ~self.inside[arr[:-1], arr[1:]]
        cut[0] = cut[ends] = True
        edges = np.flatnonzero(cut)
        counts = np.diff(np.searchsorted(edges, np.concatenate(([0], ends))))
        edges = edges.tolist()
        return [data[a:z] for a, z in zip(edges, edges[1:])], counts.tolist()

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; invalid UTF-8 is replaced."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts with a table of finished pre-tokens, ``table_size`` a generation."""

    def __init__(self, vocabulary: Vocabulary, table_size: int = 150_000):
        import regex

        self.vocabulary, self.table_size = vocabulary, table_size
        self.general, self.ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # special tokens are cut out first, so no pre-token is spelled like one
        self.always = {x: i.to_bytes(4, "little") for x, i in vocabulary.special.items()}
        self.young: dict[str, bytes] = dict(self.always)
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() and not _SEPARATORS.search(text) else self.general(text)

    def _learn(self, pieces: list[str]) -> None:
        """Put pre-tokens that the young generation lacks into it."""
        new = []
        for p in pieces:
            if (ids := self.old.get(p)) is None:
                new.append(p)
            else:
                self.young[p] = ids
        if new:
            parts, counts = self.vocabulary.fragments([p.encode() for p in new])
            ids, at = self.vocabulary.merge(parts), 0
            for p, n in zip(new, counts, strict=True):
                self.young[p] = ids[at] if n == 1 else b"".join(ids[at : at + n])
                at += n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        flat: list[str] = []
        edges = [0]
        for text in texts:
            if self.special and self.special.search(text):
                for i, x in enumerate(self.special.split(text)):
                    flat += [x] if i % 2 else self.pieces(x)
            else:
                flat += self.pieces(text)
            edges.append(len(flat))
        if len(self.young) > self.table_size:
            self.young, self.old = dict(self.always), self.young
        table = self.young
        ids = list(map(table.get, flat))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            self._learn(list(dict.fromkeys([flat[i] for i in gaps])))
            for i in gaps:
                ids[i] = table[flat[i]]
        return [b"".join(ids[a:z]) for a, z in zip(edges, edges[1:])]


def read_vocabulary(spark, path: str) -> Vocabulary:
    """The compiled vocabulary file; its path may be on the driver (an installed package) or any Spark store."""
    import os

    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return Vocabulary(f.read())
    return Vocabulary(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode())


def _kernel(vocabulary, read: bool, write: bool):
    """(key, text) -> (key, ids) if ``read``, and decoded if ``write``; without ``read`` the second column holds ids."""

    def run(batches):
        own = shared(vocabulary)
        encoder = Encoder(own) if read else None
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or ""), 500_000):
                ids = encoder.encode([r[1] or "" for r in part]) if read else [r[1] for r in part]
                columns = {"key": pa.array([r[0] for r in part], pa.binary()), "ids": pa.array(ids, pa.binary())}
                if write:
                    columns["decoded"] = pa.array([own.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        release()

    return run


def _apply(rows: DataFrame, value, vocabulary_path: str, doc_id: str, read: bool, write: bool) -> DataFrame:
    spark = rows.sparkSession
    vocabulary = share(spark, read_vocabulary(spark, vocabulary_path))
    kind = rows.schema[doc_id].dataType
    schema = "key binary, ids binary" + (", decoded string" if write else "")
    out = rows.select(F.col(doc_id).cast("string").cast("binary").alias("key"), value).mapInArrow(_kernel(vocabulary, read, write), schema)
    return out.select(F.col("key").cast("string").cast(kind).alias(doc_id), "ids", *(["decoded"] if write else []))


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary) for every row: the ids as little-endian unsigned 32-bit integers.

    The vocabulary, a file of fixed size, is broadcast. Special tokens that occur in a text become their
    ids. A null or empty text has no ids, a null id stays null, an empty table gives no rows. Repeated rows give
    equal rows; other columns are ignored. A long text is encoded whole, in memory that grows with its length.
    """
    return _apply(docs, F.col(text), vocabulary_path, doc_id, True, False)


def decode(encoded: DataFrame, vocabulary_path: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded): the text of the ids, invalid UTF-8 replaced, special tokens kept. Null ids are none."""
    return _apply(encoded, F.coalesce("ids", F.lit(b"")).alias("ids"), vocabulary_path, doc_id, False, True)


def round_trip(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) in one pass: what ``decode`` gives for the ids of ``encode``, cases as there."""
    return _apply(docs, F.col(text), vocabulary_path, doc_id, True, True)

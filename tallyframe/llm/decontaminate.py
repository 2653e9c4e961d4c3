"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n`` consecutive words
of an item; an item of fewer words, but not none, is one window. Training token windows are hashed in
numpy and looked up among the hashes of the test windows; hits are verified on the words themselves.

The test set is a normalised text and a few arrays beside it, ``WINDOW_BYTES`` a window, and is measured before
anything is broadcast. Up to ``max_bytes`` it is one broadcast; a larger one is dealt into blocks of that size
on average, whole items each, every block is broadcast in turn against all documents, and the hits of the blocks
are merged per document in a shuffle. Every window is looked for either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyframe.llm._shared import materialize, rows_of, share, shared, sized

#: Maps A-Z to a-z and every ASCII byte that is no word character to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MULT = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What a window takes in the arrays: its hash, where its text begins and ends, its item.
WINDOW_BYTES = 20
#: Stands between two texts; no word character, so no window reaches over it.
_GAP = b" | "
_STEP = 1 << 19


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def normalised(text: bytes | None) -> bytes:
    """The words with one space between them."""
    return b" ".join(words_of(text or b""))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of everything between the spaces of ``text``.

    A hash is a polynomial in the word's bytes, taken from sums over half a MB at a time (a longer word whole), so memory
    beside the three arrays does not grow with the text.
    """
    hashes, firsts, lasts, at = [], [], [], 0
    size = min(len(text), _STEP) + 1
    up, down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    while at <= len(text):
        end = len(text) if len(text) - at <= _STEP else text.rfind(b" ", at, at + _STEP)
        if end < 0:
            end = text.find(b" ", at + _STEP)
            end = len(text) if end < 0 else end
        part = np.frombuffer(text, np.uint8, end - at, at)
        if len(part) >= len(up):
            up, down = _powers(_BASE, len(part) + 1), _powers(pow(_BASE, -1, 1 << 64), len(part) + 1)
        space = np.flatnonzero(part == 32)
        first, last = np.append(0, space + 1), np.append(space, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes.append((sums[last] - sums[first]) * down[first])
        firsts.append(first + at)
        lasts.append(last + at)
        at = end + 1
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(_MULT) + (words[j : len(words) - size + 1 + j] ^ np.uint64(0x5DEECE66D))
    return out


class TestWindows:
    """The windows of some items: their text, and for each length the sorted hashes with place and item."""

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        texts = [(item, x) for item, t in items if (x := normalised(t))]
        self.items, self.text = [i for i, _ in texts], _GAP.join(x for _, x in texts)
        words, first, last = word_hashes(self.text)
        counts = np.array([x.count(b" ") + 1 for _, x in texts], dtype=np.int64)
        begin = np.cumsum(counts + 1) - counts - 1
        size = np.minimum(counts, n)
        self.tables = {}
        for k in sorted(set(size.tolist())):
            own = np.flatnonzero(size == k)
            many = counts[own] - k + 1
            owner = np.repeat(own, many)
            at = np.repeat(begin[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hashes = window_hashes(words, k)[at]
            order = np.argsort(hashes, kind="stable")
            at, wide = at[order], np.uint32 if len(self.text) < 1 << 32 else np.uint64
            self.tables[k] = (hashes[order], first[at].astype(wide), last[at + k - 1].astype(wide), owner[order].astype(np.uint32))

    def find(self, text: bytes, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, list]]:
        """(word, length, items) of every occurrence in ``text``, whose words are given as ``word_hashes`` gives them."""
        found, known = [], {}
        for size, (hashes, begin, end, owner) in self.tables.items():
            if len(words) < size:
                continue
            own = window_hashes(words, size)
            at = np.searchsorted(hashes, own)
            for i in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == own).tolist():
                here = text[first[i] : last[i + size - 1]]
                if (size, here) not in known:
                    lo, hi = int(at[i]), int(np.searchsorted(hashes, own[i], side="right"))
                    same = [int(owner[j]) for j in range(lo, hi) if self.text[begin[j] : end[j]] == here]
                    known[size, here] = [self.items[o] for o in sorted(set(same))]
                if items := known[size, here]:
                    found.append((i, size, items))
        return found


def _scan(windows):
    """Arrow kernel (key, doc_id, text as bytes) -> the columns of ``find_hits``; half a MB of text at a time."""

    def run(batches):
        tests = shared(windows)
        for batch in batches:
            for part in sized(rows_of(batch, 3), lambda r: len(r[2] or b""), _STEP):
                texts = [normalised(r[2]) for r in part]
                counts = [t.count(b" ") + 1 if t else 0 for t in texts]
                text = _GAP.join(texts)
                # a text takes a place at least, and the mark after it one
                first = np.append(0, np.cumsum(np.maximum(counts, 1) + 1))
                hits: list[list] = [[] for _ in part]
                for start, size, items in tests.find(text, *word_hashes(text)):
                    k = int(np.searchsorted(first, start, side="right")) - 1
                    hits[k].append((start - int(first[k]), size, items))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.binary()),
                        pa.array([r[1] for r in part], batch.schema.field(1).type),
                        pa.array(counts, pa.int64()),
                        pa.array([[h[0] for h in x] for x in hits], pa.list_(pa.int32())),
                        pa.array([[h[1] for h in x] for x in hits], pa.list_(pa.int32())),
                        pa.array([sorted({i for h in x for i in h[2]}) for x in hits], pa.list_(pa.string() if tests.items and isinstance(tests.items[0], str) else pa.int64())),
                    ],
                    names=["key", "doc_id", "n_words", "starts", "lengths", "items"],
                )

    return run


def _whole_or_text(df: DataFrame, name: str):
    """The id column: whole numbers as long, anything else as text."""
    whole = isinstance(df.schema[name].dataType, IntegralType)
    return F.col(name).cast("long" if whole else "string"), "long" if whole else "string"


def find_hits(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", n: int = 13, max_bytes: int = 64_000_000,
) -> DataFrame:
    """One row per row of ``docs``: key (hash of id and text), doc_id, n_words, the occurrences and the items.

    Null texts have no words. Items with a null id or text are no items; repeated items count once. Ids are whole numbers or
    text. Very long texts are read whole, half a MB of words at a time; without documents or items there are no hits.
    """
    spark = docs.sparkSession
    item, item_type = _whole_or_text(benchmark, item_id)
    own_id, id_type = _whole_or_text(docs, doc_id)
    known = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    items = known.select(item.alias("item"), F.col(item_text).alias("text")).distinct()
    need = items.agg(F.sum(F.octet_length("text") + WINDOW_BYTES * F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    blocks = max(1, -(-need // max_bytes))
    key = F.unhex(F.md5(F.concat_ws("\0", F.col(doc_id).cast("string"), F.col(text))))
    rows = docs.select(key.alias("key"), own_id.alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema = f"key binary, doc_id {id_type}, n_words long, starts array<int>, lengths array<int>, items array<{item_type}>"
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else items
        windows = share(spark, TestWindows([(r[0], r[1].encode()) for r in own.collect()], n))
        hits = rows.mapInArrow(_scan(windows), schema)
        out = hits if out is None else out.unionByName(hits)
    if blocks == 1:
        return out
    merged = out.groupBy("key", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("lengths")).alias("lengths"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )
    return merged.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def _covered(hits: DataFrame) -> DataFrame:
    """Adds n_hit: how many words lie in at least one occurrence."""
    ends = F.expr(
        "aggregate(array_sort(arrays_zip(starts, lengths)), struct(0 AS upto, 0 AS n), "
        "(acc, x) -> struct(greatest(acc.upto, x.starts + x.lengths) AS upto, "
        "acc.n + greatest(0, x.starts + x.lengths - greatest(acc.upto, x.starts)) AS n), acc -> acc.n)"
    )
    return hits.withColumn("n_hit", ends.cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> DataFrame:
    """key, doc_id, n_words, n_hit, items and ``contaminated`` (n_hit words are ``percent`` of all, and some)."""
    return _covered(find_hits(docs, benchmark, **options)).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    )


def _cut(text: bytes, starts: list[int], lengths: list[int]) -> bytes:
    """``text`` without the words in the given runs; one space stands where a run was."""
    import re

    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    out, upto = [], 0
    for a, n in sorted(zip(starts, lengths, strict=True)):
        first, last = spans[a][0], spans[a + n - 1][1]
        if first > upto:
            out.append(text[upto:first])
        upto = max(upto, last)
    return b" ".join([*(x.strip(b" ") for x in out), text[upto:].lstrip(b" ")])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of all texts.

    The columns stay as they are. Rows with a null text are kept; a row with a null id is judged by its
    text. Repeated rows share their fate.
    """
    found = materialize(contamination(docs, benchmark, doc_id=doc_id, text=text, **options), "hits")
    key = F.unhex(F.md5(F.concat_ws("\0", F.col(doc_id).cast("string"), F.col(text))))
    if remove == "documents":
        bad = found.where("contaminated").select(F.col("key").alias("__key")).distinct()
        return docs.withColumn("__k", key).join(bad, F.col("__k") == F.col("__key"), "left_anti").drop("__k")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    cut = found.where("n_hit > 0").select(F.col("key").alias("__key"), F.col("starts").alias("__a"), F.col("lengths").alias("__n")).dropDuplicates(["__key"])

    @F.pandas_udf("binary")
    def cleaned(value: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or a is None else _cut(bytes(v), list(a), list(n)) for v, a, n in zip(value, starts, lengths, strict=True)], dtype=object)

    joined = docs.withColumn("__k", key).join(cut, F.col("__k") == F.col("__key"), "left")
    hit = F.col("__a").isNotNull()  # only texts with hits go to Python
    cut_text = cleaned(F.when(hit, F.col(text).cast("binary")), "__a", "__n")
    clean = F.when(hit, F.decode(cut_text, "UTF-8")).otherwise(F.col(text))
    return joined.withColumn("__clean", clean).select(
        *(F.col("__clean").alias(c) if c == text else F.col(c) for c in docs.columns)
    )

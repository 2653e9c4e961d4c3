"""Substring dedup by difference-cover anchors.

A word that lies in a window of ``n`` words which also starts in a document with a smaller id goes. Windows are not
looked up at every position. A difference cover D modulo a period p holds, for every r, two members that differ by r;
so for two occurrences of a window, wherever they start, some offset t < p puts both on a position of D modulo p. Runs
of n - p + 1 words are hashed at those positions only (three in seven for windows of 13): these anchors lie inside the
window, so equal windows share an aligned anchor.

1. Anchors go by hash to buckets; an anchor that two documents hold marks the up to p windows around it.
2. Marked places are extended: 128-bit hashes of the whole windows there go to buckets, where every window of a
   document that is not the smallest holding it is found.
3. Runs of found windows go back to their documents and are cut out.

Buckets travel as packed columns, a row for each bucket and map batch. A batch settles among its own documents what
they share, and sends a window for its smallest document only and an anchor for two documents; a passage that a third
of all documents hold costs its bucket two entries a batch.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from tallyframe.llm._shared import materialize, release, rows_of, sized

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Text that a kernel takes at once, and text whose anchors make one bucket.
BATCH_BYTES, BUCKET_BYTES = 4_000_000, 8_000_000
#: Measured size up to which runs are broadcast to the documents; larger ones are joined in a shuffle.
BROADCAST_BYTES = 32_000_000
_PACKED = "bucket int, known boolean, h binary, g binary, doc binary, row binary, pos binary"
_FOUND = "bucket int, row binary, pos binary"
_RUNS = "row long, starts array<int>, ends array<int>"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def cover_for(n: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors at least as long as itself, and its cover."""
    period = max(p for p in COVERS if p <= (n + 1) // 2)
    return period, COVERS[period]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of all words, one document after the other."""
    import xxhash

    seen: dict[bytes, int] = {}
    n = sum(map(len, words))
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in chain.from_iterable(words)), np.int64, n)
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in seen), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[ids, 0], both[ids, 1]


def _rolled(words: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that start at ``at``."""
    out = np.full(len(at), seed, np.uint64)
    for j in range(size):
        out = _mix(out * _MULT + words[at + j])
    return out


def _batch(bucket: np.ndarray, columns: list[np.ndarray | None], known: bool | None) -> pa.RecordBatch:
    """A row for each bucket, with the bytes of its part of every column; None stands for an empty one."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    bounds = np.append(first, len(bucket))
    packed = []
    for c in columns:
        data = b"" if c is None else c[order].tobytes()
        ends = (bounds * (0 if c is None else c.itemsize)).astype(np.int32)
        packed.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
    flags = [] if known is None else [pa.array(np.full(len(first), known))]
    names = ["bucket", "row", "pos"] if known is None else [c.split()[0] for c in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *flags, *packed], names=names)


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def _extremes(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest document that holds the same hash, for every entry."""
    order = np.lexsort((doc, g, h))
    a, b, d = h[order], g[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order] = d[start][group]
    high[order] = d[np.append(start[1:], len(a)) - 1][group]
    return low, high


def _entries(rows, n: int, places):
    """Document, row, word position and the place among all words of what ``places`` names, with the word hashes."""
    words = [(r[2] or b"").split() for r in rows]
    h, g = _word_hashes(words)
    upto, at, pos, owner = 0, [], [], []
    for k, (r, w) in enumerate(zip(rows, words, strict=True)):
        own = places(len(w), *r[3:])
        pos.append(own)
        at.append(own + upto)
        owner.append(np.full(len(own), k))
        upto += len(w)
    owner = np.concatenate(owner)
    ids = np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2)
    return h, g, np.concatenate(at), np.concatenate(pos).astype(np.uint32), ids[owner, 0], ids[owner, 1]


def _row_bucket(row: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(row.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _send(buckets: int, query: np.ndarray, known: np.ndarray, h, g, doc, row, pos):
    """Entries to look up, by hash, and entries already known to be found, by row."""
    same = bool((doc == row).all())
    if query.any():
        q = lambda x: None if x is None else x[query]
        yield _batch((h[query] >> np.uint64(11)).astype(np.int64) % buckets, [q(h), q(g), q(doc), None if same else q(row), q(pos)], False)
    if known.any():
        yield _batch(_row_bucket(row[known], buckets), [None, None, None, row[known], pos[known]], True)


def _anchors(n: int, buckets: int):
    """Arrow kernel (doc, row, text) -> anchors at cover positions, as ``_PACKED``."""
    period, cover = cover_for(n)
    size = n - period + 1

    def places(count):
        if count < n:
            return np.zeros(0, np.int64)
        at = np.arange(count - size + 1)
        return at[np.isin(at % period, cover)]

    def run(batches):
        for batch in batches:
            for part in sized(rows_of(batch, 3), lambda r: len(r[2] or b""), BATCH_BYTES):
                words, _, at, pos, doc, row = _entries(part, n, places)
                if not len(at):
                    continue
                h = _rolled(words, at, size, 1)
                low, high = _extremes(h, np.zeros(len(h), np.uint8), doc)
                shared = low < high
                # the smallest and the largest document speak for the batch
                yield from _send(buckets, ~shared | (doc == low) | (doc == high), shared, h, None, doc, row, pos)
        release()

    return run


def _windows(n: int, buckets: int):
    """Arrow kernel (doc, row, text, starts, ends) -> whole windows at the marked places, as ``_PACKED``."""

    def places(count, starts, ends):
        marked = [np.arange(a, min(b, count - n + 1)) for a, b in zip(starts, ends, strict=True) if a <= count - n]
        return np.concatenate(marked) if marked else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            for part in sized(rows_of(batch, 5), lambda r: len(r[2] or b""), BATCH_BYTES):
                one, two, at, pos, doc, row = _entries(part, n, places)
                if not len(at):
                    continue
                h, g = _rolled(one, at, n, 2), _rolled(two, at, n, 3)
                low, _ = _extremes(h, g, doc)
                yield from _send(buckets, doc == low, doc > low, h, g, doc, row, pos)
        release()

    return run


def _settle(anchors: bool, buckets: int):
    """A bucket's entries -> rows and positions of those that another (anchors) or a smaller (windows) document holds."""

    def run(table: pa.Table) -> pa.Table:
        asked, known = table.filter(pc.invert(table["known"])), table.filter(table["known"])
        doc, pos = _joined(asked["doc"], np.int64), _joined(asked["pos"], np.uint32)
        # rows stand only where they differ from the documents
        row = np.frombuffer(b"".join(r or d for r, d in zip(asked["row"].to_pylist(), asked["doc"].to_pylist(), strict=True)), np.int64)
        h = _joined(asked["h"], np.uint64)
        g = np.zeros(len(h), np.uint8) if anchors else _joined(asked["g"], np.uint64)
        low, high = _extremes(h, g, doc) if len(h) else (doc, doc)
        hit = low < (high if anchors else doc)
        row = np.concatenate([row[hit], _joined(known["row"], np.int64)])
        pos = np.concatenate([pos[hit], _joined(known["pos"], np.uint32)])
        return pa.Table.from_batches([_batch(_row_bucket(row, buckets), [row, pos], None)])

    return run


def _runs(before: int, after: int):
    """A bucket's (row, position) entries -> for every row the disjoint runs [position - before, position + after)."""

    def run(table: pa.Table) -> pa.Table:
        row, pos = _joined(table["row"], np.int64), _joined(table["pos"], np.uint32).astype(np.int64)
        order = np.lexsort((pos, row))
        row, pos = row[order], pos[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (pos[1:] - before > pos[:-1] + after)
        start = np.flatnonzero(first)
        last = np.append(start[1:], len(row)) - 1
        lead = np.flatnonzero(np.diff(row[start], prepend=row[start[:1]] - 1)) if len(start) else start
        bounds = pa.array(np.append(lead, len(start)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (np.maximum(pos[start] - before, 0), pos[last] + after)]
        return pa.table({"row": pa.array(row[start[lead]]), "starts": lists[0], "ends": lists[1]})

    return run


def _sized_runs(sent: DataFrame, anchors: bool, buckets: int, before: int, after: int, tag: str) -> DataFrame:
    """Settle the buckets and gather runs by row; marked for broadcast where their measured size allows it."""
    found = sent.groupBy("bucket").applyInArrow(_settle(anchors, buckets), _FOUND)
    runs = materialize(found.groupBy("bucket").applyInArrow(_runs(before, after), _RUNS), tag)
    size = runs.agg(F.sum(F.size("starts") * 8 + 32)).first()[0] or 0
    return F.broadcast(runs) if size <= BROADCAST_BYTES else runs


def _cut(at_text: int):
    """Arrow kernel (row as struct, starts, ends) -> the row, n_words, n_removed, kept_text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                counts, gone, kept_texts = [], [], []
                texts = pc.struct_field(part.column(0), [at_text]).cast(pa.binary())
                for text, starts, ends in zip(texts.to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words, upto, kept = (text or b"").split(), 0, []
                    for a, b in zip(starts or (), ends or (), strict=True):
                        kept += words[upto:a]
                        upto = b
                    kept += words[upto:]
                    counts.append(len(words))
                    gone.append(len(words) - len(kept))
                    kept_texts.append(b" ".join(kept))
                new = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_texts, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], names=["own", "n_words", "n_removed", "kept"])
        release()

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 13) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, the words that stay joined by one space.

    Words are what ASCII blanks part, unchanged. A word goes if a window of ``n`` words over it also starts in a row
    with a smaller id; windows are judged on the input. Null and empty texts have no words and an empty kept_text, texts
    of fewer than ``n`` words stay whole. Rows with equal ids never remove each other's words, whether their texts are
    the same or not. Rows with a null id stay whole and remove nothing. A text of any length is one row, cut in whole.
    Columns of ``docs`` named like the three new ones are replaced; all others stay. An empty table gives no rows. Ids
    must be integers; others raise ValueError.
    """
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} must be an integer column")
    carried = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    source = docs.select(F.struct(*carried).alias("own"), F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    facts = source.where("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("t"), F.octet_length("text").alias("bytes"))
    each = facts.groupBy("doc").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.sum("bytes").alias("bytes"))
    total, clash = each.agg(F.sum("bytes"), F.max(F.col("low") < F.col("high"))).first()
    if clash:  # one id with different texts: rows get numbers of their own
        source = materialize(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        source = source.withColumn("row", F.col("doc"))
    some = source.where("doc IS NOT NULL")
    buckets = 1 + (total or 0) // BUCKET_BYTES
    period, _ = cover_for(n)

    sent = some.select("doc", "row", "text").mapInArrow(_anchors(n, buckets), _PACKED)
    marked = _sized_runs(sent, True, buckets, period - 1, 1, "marked")
    sent = some.join(marked, "row").select("doc", "row", "text", "starts", "ends").mapInArrow(_windows(n, buckets), _PACKED)
    gone = _sized_runs(sent, False, buckets, 0, n, "removed")

    none = F.lit(None).cast("array<int>")
    rows = some.join(gone, "row", "left").select("own", "starts", "ends")
    rows = rows.union(source.where("doc IS NULL").select("own", none.alias("starts"), none.alias("ends")))
    schema = StructType().add("own", docs.select(*carried).schema).add("n_words", LongType()).add("n_removed", LongType()).add("kept", BinaryType())
    out = rows.mapInArrow(_cut(carried.index(text)), schema)
    return out.select("own.*", "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_text"))

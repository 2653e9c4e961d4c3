"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms; a term that occurs tf times is entered once for each power of two up
to tf, so the signature also bounds tf from above. Signatures of documents of similar size lie side by side in blocks,
cut into slices: slice b of a block is a bitmap over its documents of bit b. The AND of a term's slices names the
documents that may hold the term: all that do, and by chance some more. Summing, for an item's terms, the weight times
the greatest value that the bounded tf can give therefore never falls below a document's score.

1. One pass over the texts writes the blocks and counts documents, terms, and the document frequencies of the items'
   terms.
2. Each item's ``k`` documents of highest bound are scored exactly on their texts; the ``k``-th of these scores is a
   floor under the item's final ``k``-th.
3. All documents whose bound reaches the floor are scored exactly; nothing else can be among the ``k`` best.

Items are held as one broadcast of at most ``max_terms`` term entries; more items are searched block after block. Index
and bounds grow with the documents and never leave the executors; for each item and task only ``k`` documents, and in
step 3 those not excluded, are passed on.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm._shared import materialize, release, rows_of, share, shared, sized
from tallyframe.llm.decontaminate import words_of

#: Bits set for an entry, bits of signature for an entry at least, cells of a block, rows of a block at most.
HASHES, BITS_PER_ENTRY, BLOCK_CELLS, BLOCK_ROWS = 8, 24, 1 << 23, 1024
SCALE = 1_000_000_000
#: Documents to score up to which their ids are broadcast.
BROADCAST_IDS = 500_000
_INDEX = "doc binary, length binary, rows int, slices binary, held array<long>, documents long, terms long"
_BOUNDS = "item int, docs array<long>, bounds array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _bits(hashes: np.ndarray, levels: np.ndarray | int, size: int) -> np.ndarray:
    """The bit numbers of entries (a term's hash at a level), a row of ``HASHES`` each."""
    h = _mix(hashes + (np.atleast_1d(levels).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    step = _mix(h) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)).astype(np.int64)


def _hashes(terms) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64)


class _Block:
    """Documents whose signatures have ``size`` bits, until the block is full."""

    def __init__(self, size: int):
        self.size, self.room = size, max(8, min(BLOCK_ROWS, BLOCK_CELLS // size))
        self.docs, self.lengths, self.rows = [], [], []

    def add(self, doc: int, length: int, bits: np.ndarray) -> bool:
        self.docs.append(doc)
        self.lengths.append(length)
        self.rows.append(bits)
        return len(self.rows) == self.room

    def packed(self) -> tuple[bytes, bytes, int, bytes]:
        n = len(self.rows)
        cells = np.zeros((self.size, -(-n // 8) * 8), np.uint8)
        for j, bits in enumerate(self.rows):
            cells[bits, j] = 1
        out = np.array(self.docs, np.int64).tobytes(), np.array(self.lengths, np.int64).tobytes(), n, np.packbits(cells, axis=1).tobytes()
        self.docs, self.lengths, self.rows = [], [], []
        return out


def _index(asked, build: bool):
    """Arrow kernel (doc, text) -> blocks, and a last row a task with the counts."""

    def run(batches):
        vocabulary = shared(asked)
        held = np.zeros(len(vocabulary), np.int64)
        documents = terms = 0
        open_: dict[int, _Block] = {}
        full = []

        def out(rows, counts=None):
            parts = list(zip(*rows, strict=True)) if rows else [(None,)] * 4
            n = len(parts[0])
            last = counts or ([None] * n, [None] * n, [None] * n)
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            names = [c.split()[0] for c in _INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*parts, *last], kinds, strict=True)], names=names)

        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 1_000_000):
                for doc, text in part:
                    words = words_of(text or b"")
                    if not words:
                        continue
                    tf = Counter(words)
                    documents += 1
                    terms += len(words)
                    for t in vocabulary.keys() & tf.keys():
                        held[vocabulary[t]] += 1
                    if not build or doc is None:
                        continue
                    times = np.fromiter(tf.values(), np.int64, len(tf))
                    levels = np.frexp(times.astype(np.float64))[1]  # 1 for once, 2 for two or three times, and so on
                    hashes = np.repeat(_hashes(tf), levels)
                    level = np.arange(len(hashes)) - np.repeat(np.cumsum(levels) - levels, levels)
                    size = 1 << max(6, (BITS_PER_ENTRY * len(hashes) - 1).bit_length())
                    block = open_.setdefault(size, _Block(size))
                    if block.add(doc, len(words), np.unique(_bits(hashes, level, size))):
                        full.append(block.packed())
                if full:
                    yield out(full)
                    full = []
        for block in open_.values():
            if block.rows:
                yield out([block.packed()])
        yield out([], ([held.tolist()], [documents], [terms]))
        release()

    return run


def value(tf, m):
    """A term's share of a score before its weight, for whole numbers or arrays of them."""
    return (SCALE * tf) // (1000 * tf + 20 * m)


def _bounds_of(row, plan) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a block, and for every item (row) a bound on each of their scores."""
    docs, lengths = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64)
    n = row[2]
    slices = np.frombuffer(row[3], np.uint8).reshape(-1, -(-n // 8))
    m = 50 + (50 * lengths * plan["documents"]) // plan["terms"]
    out = np.zeros((len(plan["items"]), n), np.int64)
    hashes, size = plan["hashes"], len(slices)
    top = int(lengths.max()).bit_length()
    for at in range(0, len(hashes), 512):
        own = hashes[at : at + 512]
        best = np.zeros((len(own), n), np.int64)
        alive, may = np.arange(len(own)), None
        for level in range(top):
            bitmap = np.bitwise_and.reduce(slices[_bits(own[alive], level, size)], axis=1)
            may = bitmap if may is None else may & bitmap
            some = may.any(axis=1)
            alive, may = alive[some], may[some]
            if not len(alive):
                break
            on = np.unpackbits(may, axis=1, count=n).astype(bool)
            best[alive] = np.where(on, value(np.minimum((2 << level) - 1, lengths), m), best[alive])
        for i, (terms, weights) in enumerate(plan["items"]):
            mine = (terms >= at) & (terms < at + 512)
            if mine.any():
                out[i] += weights[mine] @ best[terms[mine] - at]
    return docs, out


def _best_bounds(asked, k: int):
    """Arrow kernel over blocks -> each item's ``k`` documents of highest bound in this task."""

    def run(batches):
        plan = shared(asked)
        items = range(len(plan["items"]))
        docs, bounds = [np.zeros(0, np.int64)] * len(items), [np.zeros(0, np.int64)] * len(items)
        for batch in batches:
            for row in rows_of(batch, 4, 8):
                own, out = _bounds_of(row, plan)
                for i in items:
                    some = np.flatnonzero(out[i] > (bounds[i].min() if len(bounds[i]) == k else 0))
                    if len(some):
                        d, b = np.append(docs[i], own[some]), np.append(bounds[i], out[i][some])
                        keep = np.argpartition(-b, k - 1)[:k] if len(b) > k else slice(None)
                        docs[i], bounds[i] = d[keep], b[keep]
        kept = [i for i in items if len(docs[i])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.int32()), pa.array([docs[i] for i in kept], pa.list_(pa.int64())), pa.array([bounds[i] for i in kept], pa.list_(pa.int64()))],
            names=["item", "docs", "bounds"],
        )

    return run


def _not_excluded(asked, floors):
    """Arrow kernel over blocks -> for each item the documents whose bound reaches its floor."""

    def run(batches):
        plan, floor = shared(asked), shared(floors)
        for batch in batches:
            for row in rows_of(batch, 4, 8):
                docs, out = _bounds_of(row, plan)
                some = [(i, docs[(out[i] > 0) & (out[i] >= floor.get(i, 1))]) for i in range(len(out))]
                some = [x for x in some if len(x[1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in some], pa.int32()), pa.array([d for _, d in some], pa.list_(pa.int64()))], names=["item", "docs"]
                )

    return run


def _exact(asked):
    """Arrow kernel (doc, text, items) -> (item, doc, score) of the scores above 0."""

    def run(batches):
        plan = shared(asked)
        for batch in batches:
            found = []
            for doc, text, items in rows_of(batch, 3):
                tf = Counter(words_of(text or b""))
                n = sum(tf.values())
                m = 50 + (50 * n * plan["documents"]) // plan["terms"]
                for i in items:
                    score = sum(w * value(tf[t], m) for t, w in plan["texts"][i] if t in tf)
                    if score > 0:
                        found.append((i, doc, score))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "doc", "score"])
        release()

    return run


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(rows: DataFrame, wanted: DataFrame, asked) -> DataFrame:
    """Exact scores of the (doc, item) pairs of ``wanted``; every row of a document that occurs twice is scored."""
    by_doc = materialize(wanted.groupBy("doc").agg(F.collect_set("item").alias("items")), "wanted")  # items of the block at most
    by_doc = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_IDS else by_doc
    return materialize(rows.join(by_doc, "doc").select("doc", "text", "items").mapInArrow(_exact(asked), "item int, doc long, score long"), "scores")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_terms: int = 200_000
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0, equal scores by ascending id.

    Terms, weights and scores are those of the contract of ``op12``: terms of ASCII letters, digits and all other
    characters beyond ASCII, A-Z lower-cased; a rare term's weight is the logarithm of its rarity, and each occurrence
    adds less, less so in long texts. Null and empty texts have no terms and are no documents. Rows with a null id count
    in the statistics and are not ranked. Rows that repeat an id are ranked each on its own text. Items with a null id
    are skipped, items without terms get no rows, repeated rows of an item count once. Texts of any length are taken
    whole. Other columns play no part. Empty tables give no rows. Document ids must be integers; others raise ValueError.
    """
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} must be an integer column")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    asked = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")).distinct()
    asked = asked.withColumn("size", F.octet_length(F.coalesce("text", F.lit(b""))))
    blocks = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // (2 * max_terms)))  # a term and its blank take two bytes at least
    kind = items.schema[item_id].dataType
    index, out = None, None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else asked
        own = sorted(((r[0], set(words_of(bytes(r[1] or b"")))) for r in own.collect()), key=lambda x: (str(x[0]), sorted(x[1])))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(x[1] for x in own))))}
        counted = materialize(rows.mapInArrow(_index(share(spark, vocabulary), index is None), _INDEX), "signatures")
        index = counted.where("slices IS NOT NULL").select("doc", "length", "rows", "slices") if index is None else index
        last = counted.where("held IS NOT NULL")
        documents, terms = last.agg(F.sum("documents"), F.sum("terms")).first()
        held = dict(map(tuple, last.select(F.posexplode("held").alias("t", "n")).groupBy("t").agg(F.sum("n")).collect()))
        if not documents:
            found = spark.createDataFrame([], "item int, doc long, score long, rank int")
        else:
            weigh = lambda t: math.floor(1000 * math.log((2 * documents + 2) / (2 * held[vocabulary[t]] + 1)))
            texts = [[(t, weigh(t)) for t in sorted(x[1]) if held[vocabulary[t]]] for x in own]
            numbers = [(np.array([vocabulary[t] for t, _ in x], np.int64), np.array([w for _, w in x], np.int64)) for x in texts]
            plan = {"documents": documents, "terms": terms, "texts": texts, "items": numbers, "hashes": _hashes(vocabulary)}
            plan = share(spark, plan)
            seeds = index.mapInArrow(_best_bounds(plan, k), _BOUNDS).select("item", F.explode(F.arrays_zip("docs", "bounds")).alias("x"))
            seeds = _best(seeds.select("item", F.col("x.docs").alias("doc"), F.col("x.bounds").alias("score")), k)
            floors = _best(_scored(rows, seeds.select("doc", "item"), plan), k).where(F.col("rank") == k).select("item", "score")
            floors = share(spark, dict(map(tuple, floors.collect())))
            left = index.mapInArrow(_not_excluded(plan, floors), "item int, docs array<long>").select("item", F.explode("docs").alias("doc"))
            found = _best(_scored(rows, left, plan), k)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(own)], f"item int, item_id {kind.simpleString()}")
        part = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out

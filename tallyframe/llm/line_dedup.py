"""Line dedup on built-in functions only.

Line keys are hashed to 128 bits, range-partitioned by (hash, salt) and sorted by document (largest
first) and position. One streaming pass marks where a document first enters a run of equal hashes, so
that document counts and the surviving document follow from sums and maxima. What goes back to the
documents is a run-length compressed keep bitmap, never text.

The salt is a hash of the document, so a key that a third of all documents hold is spread over many
range partitions; runs of one key lie next to each other and shrink to a row each before the second
shuffle. Whether a key goes is settled on the runs, of which a key has ``SALTS`` at most, and comes back
to the line entries by (hash, salt), so that no task meets all entries of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm._shared import BLANKS, ascii_lower, materialize

SALTS = 1024
_KEY = ["h1", "h2"]
_RUN = [*_KEY, "salt"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_entries(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """One row (h1, h2, salt, doc, version, pos) for each line whose key has ``min_chars`` code points."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(text).alias("version"),
        F.posexplode(F.split(ascii_lower(F.col(text)), "\n", -1)).alias("pos", "line"),
    )
    key = F.trim(F.col("line"), F.lit(BLANKS))
    return (
        rows.select("doc", "version", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(7), "key").alias("h2"),
            F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"),
            "doc",
            "version",
            "pos",
        )
    )


def first_occurrences(entries: DataFrame) -> DataFrame:
    """Range-partition by hash, secondary-sort by document and position, flag each document's entry to a run."""
    order = [F.col("doc").desc(), F.col("pos"), F.col("version")]
    dealt = entries.repartitionByRange(*_RUN).sortWithinPartitions(*_RUN, *order)
    before = F.lag("doc").over(Window.partitionBy(*_RUN).orderBy(*order))
    return dealt.withColumn("enters", (before.isNull() | (before != F.col("doc"))).cast("int"))


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Keep bitmaps of the documents that lose a line.

    A line's key is the line stripped of ASCII blanks, A-Z lower-cased. Keys of ``min_chars`` code
    points found in ``min_docs`` documents lose all their lines except in the largest document id.
    Returns (doc, version, n_dropped, gaps): ``gaps`` is the bitmap as runs of dropped lines
    (start, length), ``version`` a hash of the text, so that rows which share an id but differ in text
    do not mix; such rows count as one document. Documents without dropped lines have no row. Rows
    with a null id or text never lose a line. Equal repeated rows give one bitmap. An empty table
    gives no rows; other columns are ignored.
    """
    entries = materialize(first_occurrences(line_entries(docs, doc_id, text, min_chars)), "lines")
    runs = entries.groupBy(*_RUN).agg(F.sum("enters").alias("n_docs"), F.max("doc").alias("top"))
    keys = (
        runs.groupBy(*_KEY)
        .agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))
        .where(F.col("n_docs") >= min_docs)
        .select(*_KEY, "top")
    )
    shared = runs.select(*_RUN).join(keys, _KEY)
    dropped = entries.join(shared, _RUN).where(F.col("doc") < F.col("top"))
    at = dropped.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.expr("filter(at, (p, i) -> i = 0 OR at[i - 1] <> p - 1)")
    ends = F.expr("filter(at, (p, i) -> i = size(at) - 1 OR at[i + 1] <> p + 1)")
    gaps = F.zip_with(
        starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))
    )
    return at.select("doc", "version", F.size("at").cast("long").alias("n_dropped"), gaps.alias("gaps"))


def _kept_runs() -> Column:
    """(start, stop) of the lines between the gaps, in order."""
    gap = lambda k: F.get("__gaps", k)
    return F.transform(
        F.sequence(F.lit(0), F.size("__gaps")),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(gap(k - 1)["start"] + gap(k - 1)["length"]).alias("start"),
            F.when(k == F.size("__gaps"), F.size("__lines")).otherwise(gap(k)["start"]).alias("stop"),
        ),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, which replace columns of these names; all others stay.

    A null text counts as one empty line. The bitmaps are the build side of a shuffled hash join: they
    are small next to the texts and spread by document.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    names = [F.col(c) for c in docs.columns if c not in added]
    bits = bitmaps.select(
        F.col("doc").alias("__doc"), F.col("version").alias("__v"), F.col("n_dropped").alias("__n"), F.col("gaps").alias("__gaps")
    )
    joined = (
        docs.drop(*(c for c in added if c not in (doc_id, text)))
        .withColumn("__version", F.xxhash64(text))
        .join(bits.hint("shuffle_hash"), (F.col(doc_id) == F.col("__doc")) & (F.col("__version") == F.col("__v")), "left")
        .withColumn("__lines", lines_of(F.col(text)))
    )
    kept = F.transform(_kept_runs(), lambda r: F.slice("__lines", r["start"] + 1, r["stop"] - r["start"]))
    kept_text = F.when(F.col("__gaps").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(F.flatten(kept), "\n")
    )
    return joined.select(
        *names,
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_dropped"),
        kept_text.alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text after dropping lines that many documents share."""
    return apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_chars, min_docs), doc_id, text)

"""Quality rules: word and line counts, and compression bands.

Texts that repeat themselves compress too well and noise does not compress at all. Zstandard ratios
(compressed by raw bytes) of the whole text and of its fixed chunks are held against limits that depend on
the length, since short texts never compress well.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._shared import rows_of, sized

CHUNK = 4096
LEVEL = 3
#: (bytes up to, least ratio, greatest ratio); outside the band a text is rejected.
BANDS = (
    (256, 0.35, 1.05),
    (1024, 0.30, 0.88),
    (4096, 0.25, 0.72),
    (1 << 62, 0.20, 0.68),
)
#: At least this share of the chunks must lie in the band of their length.
CHUNK_SHARE = 0.5
_OUT = (
    "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, chunk_low double, chunk_high double, n_chunks long, n_chunks_out long, base_failed boolean, kept boolean"
)
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8


def _band(size: int) -> tuple[float, float]:
    return next((lo, hi) for upto, lo, hi in BANDS if size <= upto)


def compression(text: bytes, packer) -> tuple[float, float, float, int, int]:
    """Ratio of the whole text, least and greatest ratio of its chunks, chunks, chunks out of their band.

    An empty text has the ratio 1 and no chunks. A last chunk under half a chunk joins the one before.
    """
    if not text:
        return 1.0, 1.0, 1.0, 0, 0
    whole = len(packer.compress(text)) / len(text)
    cuts = list(range(0, len(text), CHUNK))
    if len(cuts) > 1 and len(text) - cuts[-1] < CHUNK // 2:
        cuts.pop()
    if len(cuts) == 1:
        lo, hi = _band(len(text))
        return whole, whole, whole, 1, int(not lo <= whole <= hi)
    ratios, out = [], 0
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        ratios.append(r := len(packer.compress(text[a:b])) / (b - a))
        lo, hi = _band(b - a)
        out += not lo <= r <= hi
    return whole, min(ratios), max(ratios), len(ratios), out


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text, how many words lie in an 8-word window that the text holds twice or more.

    Windows get exact ids by joining neighbours three times (1, 2, 4, 8 words); text numbers are part of
    the first id, so that windows are compared within their text only.
    """
    counts = np.array([len(w) for w in words], dtype=np.int64)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(words)), counts)
    if total < _WINDOW:
        return np.zeros(len(words), dtype=np.int64)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in chain.from_iterable(words)), np.int64, total)
    ids = ids * len(words) + doc
    for width in (1, 2, 4):
        _, ids = np.unique(ids, return_inverse=True)
        ids = ids[:-width].astype(np.int64) * (total + 1) + ids[width:]
    same = doc[: len(ids)] == doc[_WINDOW - 1 :]
    at = np.flatnonzero(same)
    _, inverse, n = np.unique(ids[at], return_inverse=True, return_counts=True)
    marks = np.zeros(total + 1, dtype=np.int64)
    twice = at[n[inverse] > 1]
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + _WINDOW, -1)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=len(words))


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def _run(batches):
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    for batch in batches:
        for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 1_000_000):
            texts = [r[1] or b"" for r in part]
            words = [t.split() for t in texts]
            n_words = np.array([len(w) for w in words], dtype=np.int64)
            chars = pc.utf8_length(pa.array([b"".join(w) for w in words], pa.binary()).cast(pa.string()))
            symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]
            repeats = repeat_words(words)
            packed = [compression(t, packer) for t in texts]
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            kept = []
            for t, bad, (ratio, _, _, n, out) in zip(texts, failed.tolist(), packed, strict=True):
                lo, hi = _band(len(t))
                kept.append(not bad and lo <= ratio <= hi and out <= (1 - CHUNK_SHARE) * n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.string()),
                    pa.array(n_words),
                    chars.cast(pa.int64()),
                    pa.array(symbols, pa.int64()),
                    pa.array([dup_lines(t) for t in texts], pa.int64()),
                    pa.array(repeats.astype(np.int64)),
                    *(pa.array([p[i] for p in packed], pa.float64()) for i in range(3)),
                    *(pa.array([p[i] for p in packed], pa.int64()) for i in (3, 4)),
                    pa.array(failed),
                    pa.array(kept, pa.bool_()),
                ],
                names=[c.split()[0] for c in _OUT.split(", ")],
            )


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, compression ratios and the verdict for every row.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. ``kept``:
    not base_failed, the whole text's ratio in its band, and half of its chunks at least in theirs. A null
    text has no words and fails; each row is judged on its own and whole, however long, so repeated rows get equal verdicts, an
    empty table gives none. Ids of any type, null ones too, stay; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("binary")).mapInArrow(_run, _OUT)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))

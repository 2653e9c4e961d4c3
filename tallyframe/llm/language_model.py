"""LM scoring: two causal self-attention levels over subword ids, with counts of the whole training corpus.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, and one end. The base score adds
log10((c + 1) / (N + V + 1)) over the tokens, from counts of all training documents. For the model every word is
spelled in the ids of a byte-level vocabulary (with the blank before it), the end is an id of its own.

- The first level runs over the words of a text: it attends to the first ids of the words before and predicts the first
  id of the next word, or the end. Windows overlap by half and score each token once.
- The second level runs over the ids of one word: from those so far it predicts the next one, or that the word is over.
  What it gives depends on the word alone, so it is computed once for each distinct training word, and for the words
  that no training text has where they come up.

A word ``w`` with first id ``f`` has the probability P1(f | words before) * (c(w) + T(f) * P2(w)) / (c(f) + T(f)): its share of
the corpus among the words that begin like it, backed off to its spelling by as much as new words come up after ``f``;
T(f) counts the distinct training words that begin with ``f``. Both levels sum to 1 over all ids, so words sum to 1.

Everything that is gathered follows the input. Words are counted over all training documents. The first level is trained on
every word of every training document, in consecutive passages of at most ``PASSAGE`` words, the second on every
distinct training word (its job is the words that counts do not know). Passages and words are dealt to
``ROUNDS`` rounds and to tasks by hashes and sorted there; in each round tasks train from the common weights on their own
part, and the results are averaged by their size, first in groups on the executors, then once more. Each passage
and each word is gone through once, whatever the size of the input.

Frequent words (``FREQUENT``, a fixed bound) are looked up in a broadcast table while texts are scored; the others
are joined with the counts in a shuffle, for both scores. The table's size changes no score.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm._shared import materialize, release, rows_of, share, shared, sized
from tallyframe.llm.attention import STRIDE, Adam, Classes, Model, initial, pack, unpack

FREQUENT = 100_000
#: Words of a training passage at most, many windows of the model; longer texts go on in the next passage.
PASSAGE = 512
#: Learning rate of each round.
RATES = (0.03, 0.015, 0.005)
ROUNDS = len(RATES)
TOKENS_A_TASK = 500_000
BATCH = 4_096
#: Distinct words that a task holds before it sends them on or starts anew.
TABLE = 200_000
_END_WORD = b"\n"  # no word holds a line end
_ODD_BLANK = re.compile(r"[^\S ]")


class Speller:
    """Words to ids of the public vocabulary; a word's ids depend on the word alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.begins = np.zeros(self.end + 1, dtype=bool)
        for token, i in ranks.items():
            self.begins[i] = token[:1] == b" "
        self.begins[self.end] = True

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of all words: word i has ids[first[i]:first[i + 1]]. Words that hold another kind of blank are spelled alone."""
        text = " " + b" ".join(words).decode() if words else ""
        if not _ODD_BLANK.search(text):
            ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(words):
                return ids, np.append(first, len(ids))
        parts = [self.encoding.encode_ordinary(" " + w.decode()) for w in words]
        return np.array([i for p in parts for i in p], dtype=np.int32), np.cumsum([0, *(len(p) for p in parts)])


class SpellerSource:
    """What travels to the executors: the ranks; the encoder itself is built there, once for each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.args = (ranks, pattern)

    def build(self) -> Speller:
        return Speller(*self.args)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file (one base64 token and its rank a line); a fixed, small file."""
    import base64
    import os

    if os.path.exists(path):
        with open(path, "rb") as f:
            data = f.read()
    else:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _joined(column: pa.Array, by: bytes) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), by)[0].as_py() if len(column) else b""


def _listed(words: pa.Array) -> list[bytes]:
    """Words as Python values, through one string; no word holds a blank, so that it can be cut there again."""
    return _joined(words, b" ").split(b" ") if len(words) else []


def _split(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(the number of words of each text, the words of all texts as places in a list, the list: each word once)"""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts).lower() + b"\n", np.uint8)
    word = (data != 32) & (data - np.uint8(9) > 4)
    edges = np.flatnonzero(np.diff(word, prepend=False))
    begin, offsets = edges[::2], np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    n = np.diff(np.searchsorted(begin, np.cumsum([0, *(len(t or b"") + 1 for t in texts)])))
    return n, words.indices.to_numpy(), _listed(words.dictionary)


def _id_type(size: int) -> str:
    """How ids travel: two bytes where all fit."""
    return "<u2" if size <= 1 << 16 else "<i4"


_READ = "word binary, n long, key long, ids binary"


def _read(speller):
    """(place, text) -> rows of counted words (word, n), and of passages (n, key, ids as bytes): the id before, then its own.

    Passages cover every text; the end counts once a text, under the word of one line end.
    """

    def run(batches):
        own = shared(speller).build()
        kind = _id_type(len(own.begins))
        table: dict[bytes, int] = {}
        first_ids, counts, texts = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

        def counted():
            words = list(table)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield rows(word=pa.array(part, pa.binary()), n=pa.array(counts[i : i + 50_000]))

        def rows(**columns):
            size = len(columns["n"])
            types = {"word": pa.binary(), "n": pa.int64(), "key": pa.int64(), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in types.items()], names=list(types))

        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 1_000_000):
                if len(table) > TABLE:
                    yield from counted()
                    table, first_ids, counts = {}, first_ids[:0], counts[:0]
                texts += len(part)
                n, flat, met = _split([r[1] for r in part])
                at = np.fromiter(map(table.get, met, repeat(-1)), np.int64, len(met))
                if len(gaps := np.flatnonzero(at < 0)):
                    new = [met[i] for i in gaps.tolist()]
                    at[gaps] = np.arange(len(table), len(table) + len(new))
                    table.update(zip(new, at[gaps].tolist(), strict=True))
                    ids, first = own.spell(new)
                    first_ids = np.concatenate((first_ids, ids[first[:-1]]))
                    counts = np.concatenate((counts, np.zeros(len(new), np.int64)))
                counts[at] += np.bincount(flat, minlength=len(met))
                ids, edges = first_ids[at].astype(kind)[flat], np.cumsum([0, *n])
                keys, out = [], []
                for (place, _), a, z in zip(part, edges.tolist(), edges[1:].tolist(), strict=False):
                    whole = np.concatenate(([own.end], ids[a:z], [own.end])).astype(kind)
                    for i in range(0, len(whole) - 1, PASSAGE):
                        keys.append((place * 0x9E3779B1 + i) & (1 << 62) - 1)
                        out.append(whole[i : i + PASSAGE + 1])
                yield rows(
                    n=pa.array([len(x) - 1 for x in out], pa.int64()), key=pa.array(keys, pa.int64()), ids=pa.array([x.tobytes() for x in out], pa.binary())
                )
        yield from counted()
        if texts:
            yield rows(word=pa.array([_END_WORD], pa.binary()), n=pa.array([texts], pa.int64()))
        release()

    return run


def _bytes(ids: np.ndarray, size: np.ndarray, kind: str) -> pa.Array:
    """A column of ids as bytes; row i has the next ``size[i]`` of them."""
    data = ids.astype(kind)
    offsets = (np.cumsum([0, *size]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of a column of ids as bytes: row i has ids[first[i]:first[i + 1]]."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(_joined(column, b""), dtype=kind).astype(np.int32), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def _spell(speller):
    """(word, n) -> (word, n, ids as bytes); the end has none."""

    def run(batches):
        own = shared(speller).build()
        for batch in batches:
            words = _listed(batch.column(0))
            some = np.array([w != _END_WORD for w in words], dtype=bool)
            ids, first = own.spell([w for w in words if w != _END_WORD])
            size = np.zeros(len(words), np.int64)
            size[some] = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(ids, size, _id_type(len(own.begins)))], names=["word", "n", "ids"])

    return run


def _count_ids(size: int):
    """(n, ids as bytes) of words -> by id: first (how often words begin with it), kinds (distinct words that do), read and follows (in distinct words)."""

    def run(batches):
        end = size - 1
        first_n, kinds, read, follows = (np.zeros(size, np.int64) for _ in range(4))
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            ids, first = _ids(batch.column(1), _id_type(size))
            word = first[1:] > first[:-1]
            first_n[end] += n[~word].sum()
            begin = ids[first[:-1][word]]
            np.add.at(first_n, begin, n[word])
            kinds += np.bincount(begin, minlength=size)
            read += np.bincount(ids, minlength=size)
            follows += np.bincount(ids, minlength=size) - np.bincount(begin, minlength=size)
            follows[end] += len(begin)
        some = np.flatnonzero(first_n + read + follows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in (first_n, kinds, read, follows))], names=["id", "first", "kinds", "read", "follows"]
        )

    return run


def _passage_steps(batches, kind):
    """(inputs, targets, text numbers) of some whole passages a time."""
    parts = (np.frombuffer(b, dtype=kind).astype(np.int32) for batch in batches for (b,) in rows_of(batch, 1))
    for some in sized(parts, lambda p: len(p) - 1, BATCH):
        x, y = np.concatenate([p[:-1] for p in some]), np.concatenate([p[1:] for p in some])
        yield x, y, np.repeat(np.arange(len(some)), [len(p) - 1 for p in some])


def _word_arrays(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The second level's inputs and targets: each id of a word gives the next one, the last one the word's end."""
    targets = np.empty_like(ids)
    targets[:-1] = ids[1:]
    targets[first[1:] - 1] = end
    return ids, targets, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _word_steps(batches, kind, end):
    """Inputs, targets and word numbers of some whole words a time; the column ``room`` says how much of a step each takes."""
    ids, size, room = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            more, first = _ids(batch.column(0), kind)
            ids, size = np.concatenate((ids, more)), np.concatenate((size, np.diff(first)))
            room = np.concatenate((room, batch.column(1).to_numpy(zero_copy_only=False)))
        first, total, at = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(room))), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(total, total[at] + BATCH, "right")) - 1)
            if to == len(size) and batch is not None:
                break  # the next batch may go on with this step
            yield _word_arrays(ids[first[at] : first[to]], first[at : to + 1] - first[at], end)
            at = to
        ids, size, room = ids[first[at] :], size[at:], room[at:]


def _train(state, rate: float, words: bool):
    """A pass over a partition's passages or words from the common weights -> (weights, tokens)."""

    def run(batches):
        classes, flat = shared(state)
        model, adam, tokens, size = Model(classes, unpack(flat)), Adam(rate), 0, len(classes.inside)
        for x, y, text in _word_steps(batches, _id_type(size), size - 1) if words else _passage_steps(batches, _id_type(size)):
            adam.step(model.p, model.gradient(x, y, text)[1])
            tokens += len(y)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([pack(model.p).astype("<f4").tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["weights", "n"])
        release()

    return run


def _average(table: pa.Table) -> pa.Table:
    """One row: the mean by tokens, added up in the order of the rows' content."""
    total, n = 0.0, 0
    for w, k in sorted(zip(table.column("weights").to_pylist(), table.column("n").to_pylist(), strict=True)):
        total, n = total + np.frombuffer(w, dtype="<f4").astype(np.float64) * k, n + k
    return pa.table({"weights": pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def _fit_level(rows: DataFrame, key: str, content: list[str], tokens: int, classes: Classes, words: bool) -> np.ndarray:
    """Weights of one level, trained on the columns ``content`` in an order by ``key``; ``tokens`` sets the number of tasks."""
    spark, flat = rows.sparkSession, pack(initial(classes))
    tasks = max(1, -(-tokens // (ROUNDS * TOKENS_A_TASK)))
    groups = max(16, int(tasks**0.5))
    turn = F.pmod(F.xxhash64(F.lit(1), key), F.lit(ROUNDS))
    for r in range(ROUNDS if tokens else 0):
        own = rows.where(turn == r).select(F.xxhash64(F.lit(2), key).alias("order"), *content)
        dealt = own.repartition(tasks, "order").sortWithinPartitions("order", *content).select(*content)
        trained = dealt.mapInArrow(_train(share(spark, (classes, flat)), RATES[r], words), "weights binary, n long")
        some = trained.groupBy(F.pmod(F.xxhash64("weights"), F.lit(groups)).alias("g")).applyInArrow(_average, "weights binary, n long").toArrow()
        if some.num_rows:
            flat = np.frombuffer(_average(some).column("weights")[0].as_py(), dtype="<f4")
    return flat


class Fitted:
    """Both trained levels with what the scoring pass needs of the counts.

    ``levels``: (classes, weights) of each. ``first``, ``kinds``: by id, how often training words begin with it and how
    many distinct ones do. ``counts``: (word, first, n, spelled) of all training words, ``spelled`` as ``Spelling`` gives it.
    ``frequent`` holds the ``FREQUENT`` most frequent of them as an Arrow table, down to the count ``least``. ``total``: training
    tokens, ``distinct`` of them different, ``end``: training texts.
    """

    def __init__(self, levels, first, kinds, counts: DataFrame, frequent: pa.Table, least: int, total: int, distinct: int, end: int):
        self.levels, self.first, self.kinds, self.counts = levels, first, kinds, counts
        self.frequent, self.least, self.total, self.distinct, self.end = frequent, least, total, distinct, end


class Spelling:
    """The second level at work: log10(T(f) * P2(w)) of words, with f the first id, T(f) the distinct words that begin with it, 1 at least."""

    def __init__(self, level, kinds: np.ndarray):
        self.model = Model(level[0], unpack(level[1]))
        self.kinds = np.log10(np.maximum(kinds, 1))

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first ids, spelled) of words, word i of ids[first[i]:first[i + 1]]"""
        if len(first) < 2:
            return np.zeros(0, np.int32), np.zeros(0)
        inputs, targets, word = _word_arrays(ids, first, len(self.kinds) - 1)
        # a word of one block at most is seen whole wherever it stands; longer ones begin a block
        long = (np.diff(first) > STRIDE)[word]
        logs = np.empty(len(ids))
        for some, aligned in ((np.flatnonzero(~long), False), (np.flatnonzero(long), True)):
            logs[some] = self.model.log_probs(inputs[some], targets[some], word[some], aligned)
        begin = ids[first[:-1]]
        return begin, np.add.reduceat(logs, first[:-1]) / _LN10 + self.kinds[begin]


def _spell_counts(state):
    """(word, n, ids as bytes) -> (word, first, n, spelled)"""

    def run(batches):
        level, kinds = shared(state)
        spelling, kind = Spelling(level, kinds), _id_type(len(kinds))
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                begin, spelled = spelling(*_ids(part.column(2), kind))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(begin), part.column(1), pa.array(spelled)], names=["word", "first", "n", "spelled"])
        release()

    return run


def _spell_unknown(speller, state):
    """(key, times, word) -> (key, known, add, gain) of words that no training text has, times their number."""

    def run(batches):
        level, kinds = shared(state)
        own, spelling = shared(speller).build(), Spelling(level, kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                words = part.column(2).dictionary_encode()
                spelled = spelling(*own.spell(_listed(words.dictionary)))[1][words.indices.to_numpy()]
                nothing = np.zeros(len(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nothing.astype(np.int64)), pa.array(nothing), pa.array(spelled * part.column(1).to_numpy(zero_copy_only=False))],
                    names=["key", "known", "add", "gain"],
                )
        release()

    return run


def fit(training: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> Fitted:
    """Count and train on all rows of ``training``.

    Null and empty texts are one end each, repeated rows count as often as they stand, null ids are an id of their own;
    long texts are read in passages. An empty table gives a model of the priors alone. Other columns are ignored.
    """
    spark = training.sparkSession
    speller = share(spark, SpellerSource(ranks, pattern))
    place = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 40))
    read = materialize(training.select(place, F.col(text).cast("binary")).mapInArrow(_read(speller), _READ), "read")
    counts = read.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.mapInArrow(_spell(speller), "word binary, n long, ids binary"), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != F.lit(_END_WORD))
    end = counts.where(F.col("word") == F.lit(_END_WORD)).select("n").first()
    size = max(ranks.values()) + 2
    first, kinds, met, follows = (np.zeros(size) for _ in range(4))
    tables = {"first": first, "kinds": kinds, "read": met, "follows": follows}
    ids = counts.select("n", "ids").mapInArrow(_count_ids(size), "id int, first long, kinds long, read long, follows long")
    for r in ids.groupBy("id").agg(*(F.sum(c).alias(c) for c in tables)).collect():  # one row an id at most
        for c, x in tables.items():
            x[r["id"]] = r[c]
    begins = np.zeros(size, dtype=bool)
    for token, i in ranks.items():
        begins[i] = token[:1] == b" "
    begins[-1] = True  # the end
    over = ~begins
    over[-1] = True
    classes = Classes(first, first, begins), Classes(met, follows, over)
    passages = read.where("ids IS NOT NULL")
    tokens = passages.agg(F.sum("n")).first()[0] or 0
    levels = (
        (classes[0], _fit_level(passages, "key", ["ids"], int(tokens), classes[0], False)),
        (classes[1], _fit_level(words.withColumn("room", F.expr("1 + octet_length(word) div 3")), "word", ["ids", "room"], int(met.sum()), classes[1], True)),
    )
    known = words.mapInArrow(_spell_counts(share(spark, (levels[1], kinds))), "word binary, first int, n long, spelled double")
    known = materialize(known, "known")
    frequent = known.orderBy(F.col("n").desc(), "word").limit(FREQUENT).toArrow().combine_chunks()
    least = frequent.column("n")[-1].as_py() if frequent.num_rows == FREQUENT else 1
    return Fitted(levels, first, kinds, known, frequent, least, int(total), int(distinct), end["n"] if end else 0)


_SCORED = "key long, id string, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"
_LN10 = float(np.log(10))


class Words:
    """Words of a task by row: the first id, the count in the training corpus (0: not among the frequent ones), and ``inner``.

    Row 0 is the end, the frequent words come next and stay; others are forgotten when there are too many. ``inner``:
    log10((c(w) + T(f) * P2(w)) / (c(f) + T(f))) of frequent words; of others the denominator's part alone.
    """

    def __init__(self, own: Speller, first: np.ndarray, kinds: np.ndarray, frequent: pa.Table, end_count: int):
        self.own, self.floor = own, np.log10(first + np.maximum(kinds, 1))
        names, begin, n, spelled = (frequent.column(c) for c in ("word", "first", "n", "spelled"))
        self.always = {_END_WORD: 0} | {w: i for i, w in enumerate(chain.from_iterable(map(_listed, names.chunks)), 1)}
        begin, n, spelled = (x.to_numpy() for x in (begin, n, spelled))
        inner = np.log10(n + np.power(10.0, spelled)) - self.floor[begin]
        self.start = np.append(np.int32(own.end), begin.astype(np.int32)), np.append(end_count, n), np.append(0.0, inner)
        self.clear()

    def clear(self) -> None:
        self.table = dict(self.always)
        self.ids, self.count, self.inner = self.start

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The rows of distinct words."""
        if len(self.table) > len(self.always) + TABLE:
            self.clear()
        table = self.table
        at = np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
        if len(gaps := np.flatnonzero(at < 0)):
            new = [words[i] for i in gaps.tolist()]
            at[gaps] = np.arange(len(table), len(table) + len(new))
            table.update(zip(new, at[gaps].tolist(), strict=True))
            ids, first = self.own.spell(new)
            begin = ids[first[:-1]]
            self.ids = np.concatenate((self.ids, begin))
            self.count = np.concatenate((self.count, np.zeros(len(new), np.int64)))
            self.inner = np.concatenate((self.inner, -self.floor[begin]))
        return at


def _score(speller, state):
    def run(batches):
        from pyspark import TaskContext

        own = shared(speller).build()
        (classes, flat_weights), first, kinds, frequent, end_count = shared(state)
        model, words = Model(classes, unpack(flat_weights)), Words(own, first, kinds, frequent, end_count)
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 500_000):
                n, flat, met = _split([r[1] for r in part])
                # every text ends with row 0, the end; new words are looked at once for all that they stand for
                at, n = np.append(words.rows(met), 0), n + 1
                met.append(_END_WORD)
                doc = np.repeat(np.arange(len(part)), n)
                place = np.full(len(doc), len(met) - 1)
                inside = np.ones(len(doc), dtype=bool)
                inside[np.cumsum(n) - 1] = False
                place[inside] = flat
                count, known = words.count[at], words.inner[at]
                c, targets = count[place], words.ids[at][place]
                inputs = np.empty_like(targets)
                inputs[1:] = targets[:-1]
                inputs[np.cumsum(n) - n] = own.end
                of_word = model.log_probs(inputs, targets, doc, aligned=True) / _LN10 + known[place]
                # words that are not in the table, once a text with how often they stand there
                rare = np.flatnonzero(c == 0)
                _, some, times = np.unique(doc[rare] * len(met) + place[rare], return_index=True, return_counts=True)
                rare = rare[some]
                edges = pa.array(np.cumsum([0, *np.bincount(doc[rare], minlength=len(part))]), pa.int32())
                sums = lambda x: pa.array(np.bincount(doc, x, minlength=len(part)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(len(part))),
                        pa.array([r[0] for r in part], pa.string()),
                        pa.array(n),
                        sums(c > 0).cast(pa.int64()),
                        sums(np.log10(count + 1)[place]),
                        sums(of_word),
                        pa.ListArray.from_arrays(edges, pa.array([met[i] for i in place[rare].tolist()], pa.binary())),
                        pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
                    ],
                    names=[c.split()[0] for c in _SCORED.split(", ")],
                )
                key += len(part)
        release()

    return run


def score(docs: DataFrame, fitted: Fitted, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, per_token) for every row.

    A null or empty text is one end token; ids of any type, null ones too, stay as they are. Every row is scored whole and
    on its own, so repeated rows give equal rows (up to the rounding of sums); an empty table gives none; other columns are
    ignored. ``per_token`` is the score over the number of tokens.
    """
    spark = docs.sparkSession
    speller = share(spark, SpellerSource(ranks, pattern))
    state = share(spark, (fitted.levels[0], fitted.first, fitted.kinds, fitted.frequent, fitted.end))
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("binary"))
    scored = materialize(rows.mapInArrow(_score(speller, state), _SCORED), "scored")
    others = fitted.counts.where(F.col("n") <= fitted.least).select("word", "n", "spelled")
    pairs = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", "r.times", F.col("r.rare").alias("word"))
    met = materialize(pairs.join(others, "word", "left").select("key", "times", F.when(F.col("n").isNull(), F.col("word")).alias("word"), "n", "spelled"), "rare")
    known = met.where("n IS NOT NULL").select(
        "key",
        F.col("times").alias("known"),
        (F.col("times") * F.log10(F.col("n") + 1)).alias("add"),
        (F.col("times") * F.log10(F.col("n") + F.pow(F.lit(10.0), "spelled"))).alias("gain"),
    )
    kernel = _spell_unknown(speller, share(spark, (fitted.levels[1], fitted.kinds)))
    unknown = met.where("n IS NULL").select("key", "times", "word").mapInArrow(kernel, "key long, known long, add double, gain double")
    more = known.union(unknown).groupBy("key").agg(F.sum("known").alias("more"), F.sum("add").alias("add"), F.sum("gain").alias("gain"))
    floor = float(np.log10(fitted.total + fitted.distinct + 1))
    total = F.col("score") + F.coalesce("gain", F.lit(0.0))
    return scored.drop("rare", "times").join(more, "key", "left").select(
        F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(fitted.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        total.alias("score"),
        (total / F.col("n_tokens")).alias("per_token"),
    )

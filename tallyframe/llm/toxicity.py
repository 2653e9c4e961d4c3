"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A sample of the labelled rows (at most ``max_examples``, taken by hash of their ids: the documented bound of the fit) gives
the examples. Every example is indexed with all its words, weighted by the logarithm of their rarity among all documents,
which leaves a word of every document next to nothing, at any size. Words and word beginnings, and either of them standing ``OFTEN`` times in a text, whose share of
toxic examples is beyond chance weigh ``BOOST`` times as much; beginnings and repetitions are terms for that only.

The inverted index keeps postings by term and block of ``BLOCK`` examples with the greatest weight of the term in the
block. The most frequent terms stand in nearly all blocks, where such maxima say little; their weights are a small
matrix, and their part of all cosines is one product. A text's nearest examples are found exactly: the blocks of highest bound are evaluated first, then all
blocks whose bound is not below the worst neighbour found. Where that leaves out few blocks, the texts that follow in the same batch are held against
all examples without bounds, with equal results. Neighbours vote, weighted by a power of the cosine, and
a monotone map fitted on the examples themselves (each left out of its own vote, in a Spark job) calibrates the
share. The power, and the weight of the overall share beside the votes, are chosen by the same left-out votes. The index is bounded by ``max_examples`` whatever the corpus, so it is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._shared import materialize, release, rows_of, share_arrays, shared_arrays, sized

PREFIXES = (4, 5, 6)
MAX_EXAMPLES = 12_000
NEIGHBOURS = 16
BLOCK = 256
#: Blocks of highest bound that are evaluated before the others are held against the neighbours found.
FIRST_BLOCKS = 2
#: Texts whose frequent terms are looked up as one product, and texts whose postings are looked up together.
TOGETHER, FEW = 160, 4
#: Terms of at least this share of the examples, so many of them at most, are kept as rows of weights instead of postings.
DENSE_SHARE, DENSE_TERMS = 1 / 40, 512
#: Where this share of the blocks is evaluated in spite of their bounds, the texts beside it are held against all examples outright.
WORTH = 0.5
#: Examples of which only the greatest cosine is looked at for a floor under the neighbours'.
GROUP = 32
#: Postings that are weighted together while the index is built.
PART = 1 << 18
OFTEN = 3
BOOST = 8.0
#: (power of the cosine that weighs a vote, weight of the overall share of toxic examples beside the votes) to choose from.
SETTINGS = tuple((p, q) for p in (1, 2, 3, 4) for q in (0.1, 0.25, 1.0))
THRESHOLD = 0.3
_MANY = "+"
_WORD = re.compile(r"[^\W\d_]+")
#: Lower-case letters for letters, blanks for all other bytes, of texts in which a byte is a character.
_LETTERS = bytes(ord(chr(i).lower()) if _WORD.match(chr(i)) else 32 for i in range(256))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    if text.isascii():
        return text.encode().translate(_LETTERS).decode().split()
    try:
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def beginnings(word: str) -> list[str]:
    """The word's beginnings, marked by a hyphen, which no word holds."""
    return [word[:n] + "-" for n in PREFIXES if len(word) >= n]


def term_hashes(terms) -> np.ndarray:
    """64 bits of each term as signed numbers; terms are told apart by them."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, terms), np.uint64).view(np.int64)


class Terms:
    """Numbers of terms: the sorted hashes of all words of examples, and by name the terms that speak for toxicity.

    Numbers from ``len(hashes)`` on stand for words and beginnings whose repetition is telling while they are no terms themselves.
    """

    def __init__(self, hashes: np.ndarray, telling: list[str]):
        self.hashes = np.unique(np.concatenate((hashes, term_hashes(telling))))
        number = lambda t: int(np.searchsorted(self.hashes, term_hashes([t])[0]))
        self.telling = {t: number(t) for t in telling}
        #: By name, the number of each telling beginning, and of each base of a telling repetition.
        self.named = {t: n for t, n in self.telling.items() if not t.endswith(_MANY)}
        self.often: dict[int, int] = {}
        for t in telling:
            if t.endswith(_MANY):
                base = t.removesuffix(_MANY)
                if base not in self.named:
                    n = number(base)
                    known = n < len(self.hashes) and self.hashes[n] == term_hashes([base])[0]
                    self.named[base] = n if known else len(self.hashes) + len(self.often)
                self.often[self.named[base]] = self.telling[t]
        self.begin = {t[:-1]: n for t, n in self.named.items() if t.endswith("-")}
        self.starts = {t[: PREFIXES[0]] for t in self.begin}
        #: Words that are no terms while their repetition is one.
        self.lone = {t for t, n in self.named.items() if n >= len(self.hashes)}
        self.clear()

    def clear(self) -> None:
        #: Row by word; terms of row r are of_row[first[r]:first[r + 1]].
        self.rows: dict[str, int] = {}
        self.first, self.of_row = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "first", "of_row")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def _learn(self, words: list[str]) -> None:
        hashes = term_hashes(words)
        at = np.searchsorted(self.hashes, hashes)
        found = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(words), bool)
        # most words have their own term or none; only those that begin or repeat tellingly are looked at one by one
        row, out, named, begin, starts, lone = [], [], self.named, self.begin, self.starts, self.lone
        for i in [i for i, w in enumerate(words) if w[: PREFIXES[0]] in starts or w in lone]:
            w = words[i]
            if w in lone and not found[i]:
                row.append(i)
                out.append(named[w])
            for k in PREFIXES:
                if (t := w[:k]) in begin and len(w) >= k:
                    row.append(i)
                    out.append(begin[t])
        row = np.concatenate((np.flatnonzero(found), np.array(row, np.int64)))
        out = np.concatenate((at[found], np.array(out, np.int64)))
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.bincount(row, minlength=len(words)))))
        self.of_row = np.concatenate((self.of_row, out[np.argsort(row, kind="stable")]))

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, how often) of all texts, by text and number."""
        if len(self.rows) > 150_000:
            self.clear()
        found = [words_of(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(found))
        row = np.fromiter(map(self.rows.get, flat, repeat(-1)), np.int64, len(flat))
        if len(gaps := np.flatnonzero(row < 0)):
            missed = [flat[i] for i in gaps.tolist()]
            self._learn(list(dict.fromkeys(missed)))
            row[gaps] = [self.rows[w] for w in missed]
        text = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        size = self.first[row + 1] - self.first[row]
        terms = self.of_row[_ranges(self.first[row], size)]
        width = len(self.hashes) + len(self.often) + 1
        pair, n = np.unique(np.repeat(text, size) * width + terms, return_counts=True)
        text, terms = pair // width, pair % width
        if self.often:
            many = np.flatnonzero(n >= OFTEN)
            many = many[np.isin(terms[many], np.fromiter(self.often, np.int64))]
            more = np.array([self.often[t] for t in terms[many].tolist()], dtype=np.int64)
            real = terms < len(self.hashes)
            text, terms, n = np.append(text[real], text[many]), np.append(terms[real], more), np.append(n[real], n[many])
            order = np.lexsort((terms, text))
            text, terms, n = text[order], terms[order], n[order]
        return text, terms, n

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(term numbers in order, how often each) of every text."""
        text, terms, n = self.count(texts)
        edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(terms[a:z], n[a:z]) for a, z in zip(edges, edges[1:])]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` numbers, then those of start[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Index:
    """Block-max inverted index over the labelled examples.

    ``ids``, ``labels``: of the examples, by row. ``rows``, ``at``, ``tf``: the vectors as triples (row, term number,
    frequency). Weights are (1 + log tf) * ``weight`` of the term, vectors have length 1.
    """

    def __init__(self, terms: Terms, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, at: np.ndarray, tf: np.ndarray):
        self.terms, self.weight, self.ids, self.labels = terms, weight, ids, labels.astype(float)
        self.blocks = -(-len(ids) // BLOCK)
        if len(weight) and weight.min() <= 0:
            some = weight[at] > 0
            rows, at, tf = rows[some], at[some], tf[some]
        self.share = float(self.labels.mean()) if len(ids) else 0.0
        # in parts, as the driver does this: no array of all postings is made that is not kept
        w, length, held = np.empty(len(at), np.float32), np.zeros(len(ids)), np.zeros(len(weight), np.int64)
        parts = [slice(i, i + PART) for i in range(0, len(at), PART)]
        for x in parts:
            w[x] = (1 + np.log(tf[x])) * weight[at[x]]
            length += np.bincount(rows[x], w[x] * w[x], minlength=len(ids))
            held += np.bincount(at[x], minlength=len(weight))
        length = np.sqrt(np.maximum(length, 1e-300))
        for x in parts:
            w[x] /= length[rows[x]]
        top = np.argsort(-held, kind="stable")[:DENSE_TERMS]
        top = top[held[top] >= max(1, DENSE_SHARE * len(ids))]
        #: Column of the matrix by term, -1 for terms with postings.
        self.column = np.full(len(weight), -1, np.int16)
        self.column[top] = np.arange(len(top))
        dense = self.column[at] >= 0
        small = np.uint16 if len(ids) <= 1 << 16 else np.int32
        self.dense, self.columns = (rows[dense].astype(small), self.column[at[dense]], w[dense].astype(np.float32)), len(top)
        np.logical_not(dense, out=dense)
        rows, at, w = rows[dense].astype(small), at[dense], w[dense]
        del dense
        #: Where the postings of each term begin.
        held[top] = 0
        self.start = np.append(0, np.cumsum(held)).astype(np.int32 if len(at) < 1 << 31 else np.int64)
        self.rows, self.w = np.empty(len(at), small), np.empty(len(at), np.float32)
        some = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(at), PART), side="right") - 1, len(weight)))
        for low, high in zip(some, some[1:]):
            x = np.flatnonzero((at >= low) & (at < high))
            x = x[np.lexsort((rows[x], at[x]))]
            own = slice(self.start[low], self.start[high])
            self.rows[own], self.w[own] = rows[x], w[x]
        self.entered, self.matrix = False, None
        self.setting = SETTINGS[0]
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def _enter(self) -> None:
        """Entries, a term in a block each: where its postings begin, the block, its greatest weight, and each term's first entry."""
        block = self.rows // BLOCK
        self.within = (self.rows % BLOCK).astype(np.uint8 if BLOCK <= 256 else np.int16)
        new = np.ones(len(block), bool)
        np.not_equal(block[1:], block[:-1], out=new[1:])
        new[self.start[:-1][np.diff(self.start) > 0]] = True
        at = np.flatnonzero(new)
        self.entry_block = block[at].astype(np.int16 if self.blocks < 1 << 15 else np.int32)
        self.entry_start = np.append(at, len(self.rows)).astype(self.start.dtype)
        self.entry_most = np.maximum.reduceat(self.w, at) if len(at) else np.zeros(0, np.float32)
        self.term_start = np.searchsorted(at, self.start).astype(self.start.dtype)
        self.entered = True

    def __getstate__(self):
        left = ("entry_block", "entry_start", "entry_most", "term_start", "within")
        return {k: v for k, v in self.__dict__.items() if k not in left} | {"entered": False, "matrix": None}

    def _fill(self) -> None:
        """The entries, and the matrix of frequent terms (row, column), where they are first looked up; the driver needs neither."""
        if not self.entered:
            self._enter()
        if self.matrix is None:
            rows, columns, w = self.dense
            flat = np.zeros((self.blocks * BLOCK, self.columns), np.float32)
            flat[rows, columns] = w
            self.matrix = flat
            release()  # of what the entries and the matrix took on the way

    def _evaluate(self, chosen: np.ndarray, cell: np.ndarray, entry: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What terms with postings give to the cosines in the chosen (text, block) cells: one row of ``BLOCK`` a cell, and the cells."""
        flat = chosen.ravel()
        slot = np.cumsum(flat) - 1
        some = flat[cell]
        e, where = entry[some], slot[cell[some]] * BLOCK
        size = self.entry_start[e + 1] - self.entry_start[e]
        posting = _ranges(self.entry_start[e], size)
        cells = np.flatnonzero(flat)
        to = np.repeat(where, size)
        to += self.within[posting]
        out = np.bincount(to, np.repeat(own[some], size) * self.w[posting], minlength=len(cells) * BLOCK).reshape(-1, BLOCK)
        return out, cells

    def _evaluate_all(self, text: np.ndarray, at: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
        """What ``_evaluate`` gives for all cells: whole lists of postings are summed, in the same order."""
        start = self.start[at]
        size = self.start[at + 1] - start
        posting = _ranges(start, size)
        to = np.repeat(text * (self.blocks * BLOCK), size)
        to += self.rows[posting]
        part = np.repeat(own, size)
        part *= self.w[posting]
        return np.bincount(to, part, minlength=texts * self.blocks * BLOCK).reshape(-1, BLOCK)

    def nearest(self, text: np.ndarray, at: np.ndarray, tf: np.ndarray, texts: int, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, row, cosine) of the ``k`` examples of greatest cosine over 0 for each text, greatest first, ties by row.

        ``text``, ``at``, ``tf``: the texts' terms, as ``Terms.count`` gives them. ``but``: by text, an example to leave out.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        some = self.weight[at] > 0
        text, at, tf = text[some], at[some], tf[some]
        weights = (1 + np.log(tf)) * self.weight[at]
        weights /= np.sqrt(np.bincount(text, weights * weights, minlength=texts))[text]
        if not len(at):
            return none
        self._fill()
        asked, column = np.zeros((texts, self.columns), np.float32), self.column[at]
        asked[text[column >= 0], column[column >= 0]] = weights[column >= 0]
        often = asked @ self.matrix.T  # the frequent terms' part, exact for every example
        edges = np.searchsorted(text, np.arange(0, texts + FEW, FEW))
        found, bounded = [], True
        for low, a, z in zip(range(0, texts, FEW), edges, edges[1:]):
            own = slice(low, min(low + FEW, texts))
            # bounds are worth their while as long as they leave out a good part of the blocks; either way finds the same
            (of, row, score), seen = self._among(text[a:z] - low, at[a:z], weights[a:z], asked[own], often[own], k, None if but is None else but[own], bounded)
            bounded = seen < WORTH
            found.append((of + low, row, score))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _among(self, text, at, weights, asked, often, k, but, bounded):
        """What ``nearest`` gives, for texts whose terms have ``weights`` and whose frequent terms are ``asked`` and give ``often``; and the share of blocks evaluated.

        They are few, so that what stands between the steps stays in the processor's cache. ``bounded``: blocks are held
        against their bounds first, else all are evaluated.
        """
        texts, own, often = len(asked), weights.astype(np.float32), often.reshape(-1, BLOCK)
        cells, seen = (self._bounded if bounded else self._all)(text, at, own, often, texts, k, but)
        of, row, part, score = cells
        order = np.lexsort((-score, of))
        of, row, part, score = of[order], row[order], part[order], score[order]
        # the product's rounding depends on the company of a text; those that may be among the first k are summed again one by one
        begin, size = np.searchsorted(of, np.arange(texts)), np.bincount(of, minlength=texts)
        least = np.full(texts, -np.inf)
        least[size > k] = score[begin[size > k] + k - 1] - 2e-5
        near = score >= least[of]
        of, row = of[near], row[near]
        score = np.round(part[near] + np.einsum("ij,ij->i", asked[of], self.matrix[row]), 6)
        order = np.lexsort((row, -score, of))
        of, row, score = of[order], row[order], score[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        return (of[place < k], row[place < k], score[place < k]), seen

    def _all(self, text, at, own, often, texts, k, but):
        """(text, row, postings' part, cosine) of examples that may be among the ``k`` nearest, out of all; and 1, the share of blocks evaluated."""
        part = self._evaluate_all(text, at, own, texts)
        score = (part + often).reshape(texts, -1)
        if but is not None:
            score[np.arange(texts), but] = 0
        # the k-th of the greatest in each of many small groups is no more than the k-th of all
        most = score.reshape(texts, -1, GROUP).max(axis=2)
        worst = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] if most.shape[1] > k else np.zeros(texts)
        of, row = np.nonzero(score >= np.maximum(worst - 1e-5, 1e-300)[:, None])
        return (of, row, part.reshape(texts, -1)[of, row], score[of, row]), 1.0

    def _bounded(self, text, at, own, often, texts, k, but):
        """What ``_all`` gives, without the blocks whose bound is below the worst neighbour found; and the share of blocks evaluated."""
        start, size = self.term_start[at], self.term_start[at + 1] - self.term_start[at]
        entry = _ranges(start, size)
        own = np.repeat(own, size)
        cell = np.repeat(text, size) * self.blocks + self.entry_block[entry]
        bound = np.bincount(cell, own * self.entry_most[entry], minlength=texts * self.blocks).reshape(texts, self.blocks)
        bound = bound + often.max(axis=1).reshape(texts, self.blocks)
        first = min(FIRST_BLOCKS, self.blocks)
        chosen = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(chosen, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        found, worst, seen = [], np.zeros(texts), 0
        for turn in range(2):
            part, cells = self._evaluate(chosen, cell, entry, own)
            seen += len(cells)
            score = part + often[cells]
            of = cells // self.blocks
            if but is not None:
                out = np.flatnonzero(cells % self.blocks == but[of] // BLOCK)
                score[out, but[of[out]] % BLOCK] = 0
            if not turn and first * BLOCK > k:
                worst = np.partition(score.reshape(texts, -1), first * BLOCK - k, axis=1)[:, first * BLOCK - k]
            where, place = np.nonzero(score >= np.maximum(worst[of] - 1e-5, 1e-300)[:, None])
            found.append((of[where], cells[where] % self.blocks * BLOCK + place, part[where, place], score[where, place]))
            # blocks below the worst neighbour found (less the rounding of sums) hold none
            chosen = ~chosen & (bound >= worst[:, None] - 1e-5) & (bound > 0)
            if turn or not chosen.any():
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)), seen / bound.size

    def votes(self, of: np.ndarray, row: np.ndarray, cosine: np.ndarray, texts: int, setting: tuple[float, float] | None = None) -> np.ndarray:
        """By text, the share of toxic neighbours, weighted by a power of the cosine, with the overall share of a little weight."""
        power, prior = setting or self.setting
        w = cosine**power
        return (np.bincount(of, w * self.labels[row], minlength=texts) + prior * self.share) / (np.bincount(of, w, minlength=texts) + prior)

    def choose(self, votes: np.ndarray, y: np.ndarray) -> None:
        """Take the setting (column of ``votes``) under which examples, calibrated on the other half of them, lose least; then calibrate on all.

        Rows stand in the order of their hashes, so halves are by parity. The loss is the mean negative log likelihood; ties go
        to the first setting.
        """
        loss = []
        for column in votes.T:
            total = 0.0
            for half in (0, 1):
                fitted = np.arange(len(y)) % 2 == half
                self.calibrate(list(zip(column[fitted].tolist(), y[fitted].tolist(), strict=True)))
                p = np.clip(np.interp(column[~fitted], *self.curve), 1e-3, 1 - 1e-3)
                total -= float(np.log(np.where(y[~fitted] == 1, p, 1 - p)).sum())
            loss.append(round(total, 9))
        best = int(np.argmin(loss))
        self.setting = SETTINGS[best]
        self.calibrate(list(zip(votes[:, best].tolist(), y.tolist(), strict=True)))

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        """Monotone map from votes to observed shares: pooled adjacent violators on (left-out vote, label)."""
        pools: list[list[float]] = []
        for v, y in sorted(votes):
            pools.append([v, y, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                v2, y2, n2 = pools.pop()
                v1, y1, n1 = pools.pop()
                pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), y1 + y2, n1 + n2])
        # Half a case of either kind keeps small pools off 0 and 1.
        xs, ys = [0.0], [0.0]
        for v, y, n in pools:
            if v > xs[-1]:
                xs.append(v)
                ys.append(max(ys[-1], (y + 0.5 * v) / (n + 0.5)))
        if xs[-1] < 1:
            xs.append(1.0)
            ys.append(max(ys[-1], (1 + ys[-1]) / 2))
        self.curve = np.array(xs), np.array(ys)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Scores, and the rows of the nearest examples, of all texts."""
        out, near = np.full(len(texts), self.share), [[] for _ in texts]
        if self.blocks:
            text, at, tf = self.terms.count(texts)
            step = -(-len(texts) // max(1, -(-len(texts) // TOGETHER))) or 1
            edges = np.searchsorted(text, np.arange(0, len(texts) + step, step))
            for low, a, z in zip(range(0, len(texts), step), edges, edges[1:]):
                n = min(step, len(texts) - low)
                of, row, cosine = self.nearest(text[a:z] - low, at[a:z], tf[a:z], n)
                score = np.interp(self.votes(of, row, cosine, n), *self.curve)
                ends = np.searchsorted(of, np.arange(n + 1)).tolist()
                row = row.tolist()
                for k, (b, e) in enumerate(zip(ends, ends[1:])):
                    if e > b:
                        out[low + k], near[low + k] = score[k], row[b:e]
        return np.clip(out, 0, 1), near


def _count_terms(batches):
    """(term, toxic examples, examples) of parts of the sample, summed over some hundred thousand terms before they are sent on."""
    toxic, total = Counter(), Counter()

    def flush():
        names = list(total)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([total[t] for t in part], pa.int64())], names=["term", "toxic", "n"]
            )
        toxic.clear()
        total.clear()

    for batch in batches:
        for _, text, y in rows_of(batch, 3):
            found: Counter = Counter()
            for w, n in Counter(words_of(text or "")).items():
                for t in (w, *beginnings(w)):
                    found[t] += n
            names = [*found, *(t + _MANY for t, n in found.items() if n >= OFTEN)]
            total.update(names)
            if y:
                toxic.update(names)
            if len(total) > 200_000:
                yield from flush()
    yield from flush()


def _word_hashes(batches):
    """Hashes of the distinct words of parts of the sample."""
    for batch in batches:
        words = {w for (text,) in rows_of(batch, 1) for w in words_of(text or "")}
        yield pa.RecordBatch.from_arrays([pa.array(term_hashes(words))], names=["h"])


_CHUNK = 4_096


def _count_documents(terms):
    """Document frequencies of the terms in a task's documents, as (chunk of term numbers, 32-bit counts)."""

    def run(batches):
        own: Terms = shared_arrays(terms)
        counts = np.zeros(-(-len(own.hashes) // _CHUNK) * _CHUNK, dtype=np.int64)
        for batch in batches:
            for part in sized(rows_of(batch, 1), lambda r: len(r[0] or ""), 500_000):
                counts += np.bincount(own.count([r[0] or "" for r in part])[1], minlength=len(counts))
        parts = counts.reshape(-1, _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([parts[i].astype("<i8").tobytes() for i in some.tolist()], pa.binary())], names=["chunk", "counts"]
        )
        own = batch = part = parts = None  # release() gives back only what nothing holds any more
        release()

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, dtype=np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), dtype="<i8")
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _example_vectors(terms):
    def run(batches):
        own: Terms = shared_arrays(terms)
        for batch in batches:
            for part in sized(rows_of(batch, 3), lambda r: len(r[1] or ""), 1_000_000):
                tfs = own.vectors([r[1] or "" for r in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int32()),
                        pa.array([x for x, _ in tfs], pa.list_(pa.int32())), pa.array([x for _, x in tfs], pa.list_(pa.int32())),
                    ],
                    names=["doc", "y", "terms", "tf"],
                )
        own = batch = part = tfs = None
        release()

    return run


def _left_out_votes(index):
    """(row, terms, tf) of examples -> their votes without themselves, under every setting."""

    def run(batches):
        idx: Index = shared_arrays(index)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                row, terms, tf = (part.column(c) for c in range(3))
                text = np.repeat(np.arange(len(row)), np.diff(terms.offsets.to_numpy()))
                near = idx.nearest(text, terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), len(row), but=row.to_numpy())
                votes = np.stack([idx.votes(*near, len(row), s) for s in SETTINGS], axis=1)
                offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(SETTINGS))
                yield pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(offsets, pa.array(votes.ravel()))], names=["row", "votes"])
        idx = batch = part = row = terms = tf = None
        release()

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        max_examples: int = MAX_EXAMPLES, boost: float = BOOST) -> Index:
    """Fit the index on the rows of ``labels`` (the caller leaves out what is held out).

    Rows whose label is not 0 or 1, or whose id is null or not in ``docs``, are no examples; of repeated ids the greatest
    label counts. Equal texts count as one example with the greatest label, so that a page copied many times does
    not make its words look significant. Null and empty texts are examples without words. Without examples every text
    scores 0. The driver holds the examples' term counts, never the texts.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).cast(kind).alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_examples)
    )
    every = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    sample = every.join(F.broadcast(chosen), F.col("doc") == F.col("__id"))
    sample = materialize(
        sample.groupBy("text").agg(F.xxhash64(F.min("doc")).alias("order"), F.min("doc").alias("doc"), F.max("__y").alias("y")).select("doc", "text", "y"), "examples"
    )
    size, toxic = sample.agg(F.count("*"), F.sum("y")).first()
    if not size:
        none = np.zeros(0, np.int64)
        return Index(Terms(none, []), np.zeros(0), none, none, none, none, none)
    examples = sample.select(F.xxhash64("doc").alias("doc"), "text", "y")
    counts = (
        examples.mapInArrow(_count_terms, "term string, toxic long, n long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("n >= 3")
    )
    counts = materialize(counts, "terms")
    # Likelihood ratio of the term's share against the base share; the limit grows with the terms tested.
    p, tested = (toxic or 0) / size, counts.count()
    share_ = F.col("toxic") / F.col("n")
    entropy = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(F.lit(0.0))
    ratio = 2 * F.col("n") * (entropy(share_, F.lit(max(p, 1e-9))) + entropy(1 - share_, F.lit(max(1 - p, 1e-9))))
    telling = [r["term"] for r in counts.where((share_ > p) & (ratio > 2 * math.log(tested + 1) + 4)).select("term").collect()]
    hashes = examples.select("text").mapInArrow(_word_hashes, "h long").distinct().toArrow().column("h").to_numpy()
    terms = Terms(hashes, sorted(telling))
    space = share_arrays(spark, terms)
    frequency = np.zeros(-(-len(terms.hashes) // _CHUNK) * _CHUNK, dtype=np.int64)
    found = every.select("text").mapInArrow(_count_documents(space), "chunk int, counts binary").groupBy("chunk").applyInArrow(_add_counts, "chunk int, counts binary")
    for r in found.collect():  # a row for 4,096 terms of the examples
        frequency[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], dtype="<i8")
    documents = docs.count()
    weight = np.log((documents + 1) / np.maximum(frequency[: len(terms.hashes)], 1))
    weight[list(terms.telling.values())] *= boost
    vectors = materialize(examples.mapInArrow(_example_vectors(space), "doc long, y int, terms array<int>, tf array<int>"), "vectors")
    held = vectors.toArrow().combine_chunks().sort_by("doc")
    lists, tf = held.column("terms").combine_chunks(), held.column("tf").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    at = lists.flatten().to_numpy()
    # examples whose weightiest words agree stand in the same blocks; that tightens the blocks' bounds
    common = np.full(len(n), -1)
    by_frequency = np.argsort(-frequency[: len(terms.hashes)], kind="stable")
    position = np.empty(len(by_frequency), np.int32)
    position[by_frequency] = np.arange(len(by_frequency), dtype=np.int32)
    if len(at):
        common[n > 0] = by_frequency[np.minimum.reduceat(position[at], (np.cumsum(n) - n)[n > 0])]
    place = np.argsort(common, kind="stable")
    rank = np.empty(len(n), np.uint16 if len(n) <= 1 << 16 else np.int32)
    rank[place] = np.arange(len(n))
    docs_of, y = held.column("doc").to_numpy(), held.column("y").to_numpy()
    rows, tf = np.repeat(rank, n), tf.flatten().to_numpy()
    del held, lists, by_frequency, position, frequency
    index = Index(terms, weight, docs_of[place], y[place], rows, at, tf)
    # the index has what it needs of them; the driver does not hold them beside the copies for the executors
    del tf, n, at, rows, y
    release()
    # as an Arrow table: a list would go through an RDD, for which executors keep Python workers of another kind beside those of the other stages
    numbered = spark.createDataFrame(pa.table({"doc": docs_of, "row": rank.astype(np.int32)}))
    uncalibrated = share_arrays(spark, index)
    votes = vectors.join(F.broadcast(numbered), "doc").select("row", "terms", "tf").repartition(max(1, int(size) // 250)).mapInArrow(
        _left_out_votes(uncalibrated), "row int, votes array<double>"
    )
    left_out = votes.toArrow().combine_chunks().sort_by("row")
    index.choose(left_out.column("votes").combine_chunks().flatten().to_numpy().reshape(-1, len(SETTINGS)), index.labels[left_out.column("row").to_numpy()].astype(int))
    # what came of both is written or collected, nothing reads them again
    uncalibrated.destroy()
    space.destroy()
    del uncalibrated, space
    release()
    names = {r["h"]: r["doc"] for r in sample.select(F.xxhash64("doc").alias("h"), "doc").collect()}
    index.ids = [names[h] for h in index.ids.tolist()]
    return index


def _score(index):
    def run(batches):
        idx: Index = shared_arrays(index)
        names = [str(x) for x in idx.ids]
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or ""), 500_000):
                score, near = idx.scores([r[1] or "" for r in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.string()),
                        pa.array(score),
                        pa.array([[names[r] for r in x] for x in near], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "score", "evidence"],
                )
        idx = batch = part = names = near = None
        release()

    return run


def score(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, evidence, predicted) for every row; evidence holds the ids of the nearest examples.

    Texts without a word of any example, null and empty ones too, score the share of toxic examples and have no
    evidence. Whole texts are read, however long. Ids of any type, null ones too, stay; repeated rows give equal rows, an empty
    table none; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(
        _score(share_arrays(docs.sparkSession, index)), "doc_id string, score double, evidence array<string>"
    )
    return rows.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "score", F.col("evidence").cast(f"array<{kind.simpleString()}>").alias("evidence"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; the columns and all other rows stay as they are."""
    model = share_arrays(docs.sparkSession, index)

    def clean(batches):
        idx: Index = shared_arrays(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                keep = idx.scores([t or "" for t in part.column(at).to_pylist()])[0] < threshold
                yield part.filter(pa.array(keep))
        idx = batch = part = None
        release()

    return docs.mapInArrow(clean, docs.schema)

"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained here, in numpy, on the small labelled table below; it
reads word-shape features of a word and its neighbours and is decoded by Viterbi over all words of a text. Weights
are whole numbers, so sums do not depend on their order: texts are cut into blocks of ``BLOCK`` words, which step together
in numpy, once for the best way from every tag to every tag, and once more from the tags that the blocks before them leave. The
path is that of a plain pass over the text. What it finds is added where no base span lies and where the digits or the
address hold up; base spans always stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._shared import rows_of, share, shared, sized
from tallyframe.llm.secret_scan import SPANS, code_points_before, spans_array

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *KINDS)
#: Words of a text that are decoded one after another; blocks stand side by side.
BLOCK = 256
#: Weights are multiples of 1 / UNIT, kept as whole numbers.
UNIT = 1 << 20

#: The labelled table. Words in [kind ...] carry the kind, all others none.
LABELLED = """
write to [email anna.meier@post.example.org] before noon
my mail is [email j_doe@uni-mail.example] thanks
Contact: [email <support@shop.example.com>] or ask here
e-mail [email k.lee@localhost] for access
reach me under [email bob@intranet] or call
send it to [email (x.y@z.example.net)], please
the price is 3@5 in the shop
meet us @ noon near the door
follow @birdwatch for news
call me at [phone 555-201-3344] after six
call [phone (555) 201-3344] today
phone [phone 555.201.3344] or write
tel. [phone 030 1234 5678] from Monday
telephone [phone 01 44 55 66 77] in Paris
mobile [phone 0171-5551234] any time
fax [phone +49 30 5551234] only
my number is [phone 212-555-0187] ok
cell: [phone 917 555 0199] evenings
tel [phone +1 (988) 555-2485] works
phone: [phone 020 7946 0958] in London
ring [phone 1-800-555-0142] now
on 2021-03-04 we met 12 people
in 1998 there were 1200 houses and 300 barns
chapter 12.4 and section 3.2.1 of the book
version 4.12.0 was released in 2019
pages 120-134 of volume 7
the score was 3-1 after 90 minutes
about 12 000 000 people live there
it costs 1,299.00 or 49.99 each
between 10:30 and 11:45 on 04/05/2020
room 101 holds 25 chairs
order 20231105 came in 3 boxes
isbn 978-3-16-148410-0 on the cover
population 1234567 in 2001
years 1914-1918 and 1939-1945 were
the server at [ip 10.0.0.12] is down
ping [ip 192.168.1.254] failed again
host [ip 172.16.4.9:8080] answered
from [ip [10.1.2.3]] with love
address [ip 203.0.113.7/24] was blocked
ip [ip fe80::1ff:fe23:4567:890a] is local
ip address [ip 2001:db8::8a2e:370:7334] answered
at 12:30:45 the bell rang
ratio 4:3 or 16:9 on screens
pay with [card 4111 1111 1111 1111] today
card [card 5500-0000-0000-0004] expires soon
card number [card 4012888888881881] is mine
visa [card 4222 2222 2222 2222] was used
credit card [card 378282246310005] please
account 12345678 has 3 entries
serial 99881234567812345678 of the part
token 0b96a8c8d79c4a5085c9 is old
build 1.2.3.4567 failed on 8 cores
temperature 21.5 at 1013 hPa
add 2 + 2 to get 4
grew by +12 percent and +3 points
question 5 of 20 was hard
"""

_CUES = {
    "mail": ("mail", "e-mail", "email", "contact", "write", "reach", "send"),
    "phone": ("call", "phone", "tel", "telephone", "mobile", "cell", "fax", "ring", "number", "sms"),
    "ip": ("ip", "host", "server", "ping", "address", "from"),
    "card": ("card", "visa", "credit", "mastercard", "pay"),
    "other": ("version", "page", "pages", "isbn", "order", "section", "chapter", "build", "serial", "account", "token", "in", "on"),
}
_CUE = {w: k for k, words in _CUES.items() for w in words}
_RUN = re.compile(r"(.)\1*")


def shape(word: str) -> str:
    """Runs of letters, capitals and digits by class and length, other characters as they are: 030-12 -> d3-d2."""
    kinds = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return "".join(
        m[1] + (str(min(len(m[0]), 12)) if m[1] == "d" else "") for m in _RUN.finditer(kinds)
    )


def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'")
    s = shape(core)
    digits = sum(c.isdigit() for c in core)
    out = [f"shape={s}", f"digits={digits if digits < 8 else '8-9' if digits < 10 else '10-11' if digits < 12 else '12+'}"]
    out.append("first=" + (s[:1] or "-"))
    out += [f"has{c}" for c in "@+-.:/(" if c in core]
    if digits and digits == len(core):
        out.append("all-digits")
    if not digits:
        out.append("cue=" + _CUE.get(core.lower(), "none"))
    return tuple(out)


def read_labelled(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """(words, tag numbers) of every line."""
    out = []
    for line in table.strip().split("\n"):
        words, tags, tag = [], [], 0
        for w in line.split():
            if m := re.fullmatch(r"\[(email|ip|card|phone)", w):
                tag = TAGS.index(m[1])
                continue
            ends = bool(tag) and re.search(r"\][.,]?$", w)
            words.append(re.sub(r"\]([.,]?)$", r"\1", w) if ends else w)
            tags.append(tag)
            tag = 0 if ends else tag
        out.append((words, tags))
    return out


class Field:
    """Weights of the field, in units of 1 / ``UNIT``: per feature at -1, 0, +1 and tag, per pair of tags, per first tag."""

    def __init__(self, names: list[str]):
        self.names = {n: i for i, n in enumerate(names)}
        k = len(TAGS)
        self.emit = np.zeros((3, len(names) + 1, k), dtype=np.int64)  # the last row, of unknown features, stays 0
        self.move = np.zeros((k, k), dtype=np.int64)
        self.start = np.zeros(k, dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        #: Row by word and by features; what words of a row add at -1, 0 and +1.
        self._rows: dict[str, int] = {}
        self._alike: dict[tuple, int] = {}
        self._own: list[np.ndarray] = []

    def rows(self, word: str) -> list[int]:
        return [self.names.get(f, len(self.names)) for f in word_features(word)]

    def row(self, word: str) -> int:
        """The word's row; words of letters, lower-case but for the first, are told by that and their cue alone."""
        core = word.strip(".,;:!?\"'")
        plain = core.isalpha() and (core.islower() or len(core) > 1 and core[0].isupper() and core[1:].islower())
        key = (core[0].isupper(), _CUE.get(core.lower())) if plain else word_features(word)
        if (n := self._alike.get(key)) is None:
            n = self._alike[key] = len(self._own)
            self._own.append(self.emit[:, self.rows(word)].sum(axis=1))
        return n

    def scores(self, words: list[str], first: np.ndarray | None = None) -> np.ndarray:
        """Tag scores (words, tags) of sequences that stand one after another, beginning at ``first`` (default: one sequence)."""
        if len(self._rows) > 100_000:
            self.forget()
        for w in set(words).difference(self._rows):
            self._rows[w] = self.row(w)
        own = np.array(self._own).reshape(-1, 3, len(TAGS))[np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))]
        out = own[:, 1].copy()
        if len(words) > 1:
            inner = np.ones(len(words), dtype=bool)
            inner[0 if first is None else first] = False
            out[1:] += own[:-1, 0] * inner[1:, None]
            out[:-1] += own[1:, 2] * inner[1:, None]
        return out

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best tags of every sequence, by Viterbi; ties go to the smaller tag."""
        sizes = np.array([len(x) for x in sequences], dtype=np.int64)
        full = np.flatnonzero(sizes)
        out = [np.zeros(0, dtype=np.int8) for _ in sequences]
        if not len(full):
            return out
        first = np.cumsum(sizes[full]) - sizes[full]
        score = self.scores([w for x in sequences for w in x], first)
        tags = self._best(score, first, sizes[full])
        for i, x in zip(full.tolist(), np.split(tags, first[1:]), strict=True):
            out[i] = x
        return out

    def _best(self, score: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best tags of sequences of at least one word that stand one after another in ``score``."""
        k, count = len(TAGS), -(-sizes // BLOCK)
        head = np.cumsum(count) - count  # the first block of each sequence
        place = np.arange(count.sum()) - np.repeat(head, count)
        begin = np.repeat(first, count) + place * BLOCK
        length = np.minimum(np.repeat(first + sizes, count) - begin, BLOCK)
        # longer blocks first, so that those with a word number t are a prefix
        order = np.argsort(-length, kind="stable")
        begin, length, opens = begin[order], length[order], place[order] == 0
        live = np.searchsorted(-length, -np.arange(BLOCK + 1), side="left")  # live[t]: blocks of more than t words
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        steps = int(length[0])
        enter = np.zeros((len(order), k), dtype=np.int64)
        if count.max() > 1:
            # best way through a block, from the tag before it to its last tag
            way = self.move + score[begin][:, None]
            way[opens] = (self.start + score[begin[opens]])[:, None]
            for t in range(1, steps):
                n = live[t]
                new = way[:n, :, 0, None] + self.move[0]
                for m in range(1, k):
                    np.maximum(new, way[:n, :, m, None] + self.move[m], out=new)
                way[:n] = new + score[begin[:n] + t][:, None]
            more = np.argsort(-count, kind="stable")
            for i in range(1, int(count.max())):
                more = more[: np.searchsorted(-count[more], -i, side="left")]
                before = where[head[more] + i - 1]
                enter[where[head[more] + i]] = (enter[before][:, :, None] + way[before]).max(axis=1)
        back = np.zeros((steps, len(order), k), dtype=np.int8)
        best = np.zeros((len(order), k), dtype=np.int64)
        for t in range(steps):
            n = live[t]
            step = (best[:n] if t else enter)[:, :, None] + self.move
            back[t, :n] = step.argmax(axis=1)
            best[:n] = step.max(axis=1) + score[begin[:n] + t]
            if not t:
                best[opens] = self.start + score[begin[opens]]
        # the path of a block for each of its last tags, then the last tags from the end of each sequence
        path = np.zeros((steps, len(order), k), dtype=np.int8)
        tag = np.tile(np.arange(k, dtype=np.int8), (len(order), 1))
        for t in range(steps - 1, -1, -1):
            n = live[t]
            path[t, :n] = tag[:n]
            tag[:n] = np.take_along_axis(back[t, :n], tag[:n].astype(np.int64), axis=1)
        last = np.zeros(len(order), dtype=np.int64)
        ends = where[head + count - 1]
        last[ends] = best[ends].argmax(axis=1)
        more = np.argsort(-count, kind="stable")
        for i in range(1, int(count.max())):
            more = more[: np.searchsorted(-count[more], -i, side="left")]
            after = where[(head + count)[more] - i]
            last[where[(head + count)[more] - i - 1]] = tag[after, last[after]]
        out = np.zeros(len(score), dtype=np.int8)
        for t in range(steps):
            n = live[t]
            out[begin[:n] + t] = path[t, np.arange(n), last[:n]]
        return out


def train(table: str = LABELLED, steps: int = 250, rate: float = 0.1, ridge: float = 0.02) -> Field:
    """Maximise the penalised likelihood of the labelled table with Adam; forward-backward gives the gradient."""
    rows = read_labelled(table)
    field = Field(sorted({f for words, _ in rows for w in words for f in word_features(w)}))
    k, width, n = len(TAGS), len(field.names), len(rows)
    longest = max(len(w) for w, _ in rows)
    x = np.zeros((n, longest + 2, width))  # one blank word at both ends
    y = np.zeros((n, longest), dtype=int)
    size = np.array([len(w) for w, _ in rows])
    for i, (words, tags) in enumerate(rows):
        for t, w in enumerate(words):
            x[i, t + 1, field.rows(w)] = 1
        y[i, : len(tags)] = tags
    mask = np.arange(longest) < size[:, None]
    views = [x[:, d : d + longest] * mask[..., None] for d in range(3)]
    gold = np.eye(k)[y] * mask[..., None]
    pairs = np.einsum("ita,itb->ab", gold[:, :-1], gold[:, 1:])
    p = [np.zeros((3, width, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    lse = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for step in range(1, steps + 1):
        e = sum(np.einsum("itf,fk->itk", views[d], p[0][d]) for d in range(3))
        a, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        a[:, 0] = e[:, 0] + p[2]
        for t in range(1, longest):
            a[:, t] = np.where(mask[:, t, None], lse(a[:, t - 1, :, None] + p[1], 1) + e[:, t], a[:, t - 1])
        z = lse(a[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            inner = lse(p[1] + (e[:, t + 1] + b[:, t + 1])[:, None], 2)
            b[:, t] = np.where(mask[:, t + 1, None], inner, 0)
        node = np.exp(a + b - z[:, None, None]) * mask[..., None]
        edge = np.exp(a[:, :-1, :, None] + p[1] + (e + b)[:, 1:, None] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [
            np.stack([np.einsum("itf,itk->fk", views[d], gold - node) for d in range(3)]) - ridge * p[0],
            pairs - edge.sum(axis=(0, 1)) - ridge * p[1],
            (gold - node)[:, 0].sum(axis=0) - ridge * p[2],
        ]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    whole = lambda x: np.rint(x * UNIT).astype(np.int64)
    field.emit[:, :width] = whole(p[0])
    field.move, field.start = whole(p[1]), whole(p[2])
    return field


# The base patterns. A match can begin only where a run of its first class begins, hence the look-behinds;
# they change no match and keep long runs cheap.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans (kind, start, stop, True) by kind, then start."""
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end(), True))
            upto = m.end()
        at = text.find("@", max(at + 1, upto))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span(), True))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NON_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span(), True))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span(), True))
    return out


_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data.split()`` begin and end."""
    blank = np.concatenate(([True], _BLANK[np.frombuffer(data, dtype=np.uint8)], [True]))
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def _holds_up(kind: str, value: str) -> bool:
    digits = _NON_DIGIT.sub("", value)
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+@[A-Za-z0-9][^@\s]*", value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9.]+(:[0-9]+|/[0-9]+)?|[0-9A-Fa-f:]*:[0-9A-Fa-f:]+", value)) and (
            value.count(".") == 3 and all(x and int(x) <= 255 for x in re.split(r"[:/]", value)[0].split(".")) or value.count(":") >= 3
        )
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9 -]+", value))
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", value)) and any(c in value for c in " -.(")


def added_spans(field: Field, texts: list[str], datas: list[bytes], base: list[list]) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of the field that touch no base span, per text."""
    out: list[list] = [[] for _ in texts]
    found: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]  # byte place of the first word, characters to skip, kind, value
    for t, tags in enumerate(field.decode([[w.decode() for w in data.split()] for data in datas])):
        if not tags.any():
            continue
        begins, ends = word_places(datas[t])
        edges = np.append(np.flatnonzero(np.diff(tags, prepend=-1)), len(tags))
        for i in np.flatnonzero(tags[edges[:-1]]).tolist():
            kind = TAGS[tags[edges[i]]]
            raw = datas[t][begins[edges[i]] : ends[edges[i + 1] - 1]].decode()
            value = raw.strip(".,;:!?\"'<>[](){}") if kind != "phone" else raw.strip(".,;:!?\"'<>[]{}")
            if _holds_up(kind, value):
                found[t].append((int(begins[edges[i]]), raw.index(value), kind, value))
    for t, some in enumerate(found):
        if not some:
            continue
        at = code_points_before(np.frombuffer(datas[t], dtype=np.uint8), np.array([x[0] for x in some])).tolist()
        taken = sorted((x, y) for _, x, y, _ in base[t])
        upto = np.maximum.accumulate([y for _, y in taken]) if taken else np.zeros(0, int)
        begins = np.array([x for x, _ in taken])
        for a, (_, skip, kind, value) in zip(at, some, strict=True):
            a, b = a + skip, a + skip + len(value)
            # of the base spans that begin before b, the one that reaches furthest
            k = int(np.searchsorted(begins, b, side="left"))
            if not (k and upto[k - 1] > a):
                out[t].append((kind, a, b, False))
    return out


def _kernel(model):
    def run(batches):
        field = shared(model)
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or ""), 1_000_000):
                texts = [r[1] or "" for r in part]
                base = [base_spans(t) for t in texts]
                more = added_spans(field, texts, [t.encode() for t in texts], base)
                spans = [sorted(a + b, key=lambda s: (KINDS.index(s[0]), *s[1:3])) for a, b in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), spans_array(spans)], names=["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: str = LABELLED) -> DataFrame:
    """(doc_id, spans) for every row; spans are (kind, start, stop, base) in code points, by kind, then start.

    Null and empty texts have none. Whole texts are read, however long. Ids of any type, null ones too, stay; rows are read
    on their own, so repeated rows give equal rows, an empty table none; other columns are ignored. The field (a few hundred
    kB) is trained on the driver from ``labelled``.
    """
    model = share(docs.sparkSession, train(labelled))
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(_kernel(model), f"doc_id string, spans {SPANS}")
    return rows.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "spans")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans share the first's."""
    model = share(docs.sparkSession, train())

    @F.pandas_udf("string")
    def masked(values):
        field, out = shared(model), []
        for value in values:
            if not value:
                out.append(value)
                continue
            base = base_spans(value)
            spans = sorted(base + added_spans(field, [value], [value.encode()], [base])[0], key=lambda s: s[1:3])
            upto, parts = 0, []
            for kind, a, b, _ in spans:
                if a >= upto:
                    parts += [value[upto:a], f"[{kind}]"]
                upto = max(upto, b)
            out.append("".join([*parts, value[upto:]]))
        return __import__("pandas").Series(out)

    return docs.withColumn(text, masked(F.col(text)))

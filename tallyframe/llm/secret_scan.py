"""Secret scans with one combined deterministic automaton.

All rules are compiled to one automaton over bytes: the patterns become a nondeterministic automaton,
subset construction makes it deterministic (its start is entered again at every byte), partition refinement
makes it minimal, and bytes that behave alike share a column of the transition array. Bytes that return
every state to the start cut a batch of texts into lanes, and all lanes step through the array together, so
each byte is looked at once for all rules. Only lanes that reach an accepting state are read again, to
place the leftmost longest spans of the rules that were accepted there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._shared import rows_of, share, shared, sized

_PARSER = re._parser  # the standard library's own reader of pattern syntax


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what the automaton looks for, and which matches then count.

    ``group`` (0: the whole match) must have ``least`` bytes or more; matches that fall short are dropped
    without another try inside them.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False


#: The rules, base rules first.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),  # a run is taken whole, so the count may stand in the pattern
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", least=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Nfa:
    """Byte automaton with empty moves; one accepting state per rule."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, parsed, at: int, fold: bool) -> int:
        """Append what the parsed pattern matches after state ``at``; returns the state behind it."""
        for op, arg in parsed:
            name = str(op)
            if name in ("LITERAL", "IN"):
                chars = self._chars([(op, arg)] if name == "LITERAL" else arg, fold)
                to = self.state()
                self.moves[at].append((chars, to))
                at = to
            elif name == "SUBPATTERN":
                at = self.add(arg[-1], at, fold)
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    own = self.state()
                    self.empty[at].append(own)
                    self.empty[self.add(branch, own, fold)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high == _PARSER.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(inner, at, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules may not use {name}")
        return at

    @staticmethod
    def _chars(items, fold: bool) -> frozenset[int]:
        out: set[int] = set()
        for op, arg in items:
            if str(op) not in ("LITERAL", "RANGE"):
                raise ValueError(f"rules may not use {op} in a class")
            out.update([arg] if str(op) == "LITERAL" else range(arg[0], arg[1] + 1))
        if max(out) > 127:
            raise ValueError("rules are made of ASCII characters")
        if fold:
            out |= {ord(chr(c).swapcase()) for c in out if chr(c).isalpha()}
        return frozenset(out)

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _shortest(parsed):
    """The pattern with an unbounded repeat at its end cut to the least count: a match begins where it begins."""
    items = list(parsed)
    if items and str(items[-1][0]) == "SUBPATTERN":
        op, arg = items[-1]
        items[-1] = (op, (*arg[:-1], _shortest(arg[-1])))
    elif items and str(items[-1][0]) == "MAX_REPEAT":
        op, (low, high, inner) = items[-1]
        items[-1] = (op, (low, max(low, 1) if high == _PARSER.MAXREPEAT else high, inner))
    return items


class Automaton:
    """``step[state, column[byte]]`` and ``accepts[state]`` (a bit per rule); state 0 is the start.

    ``search``: the start is entered again at every byte, so a state accepts where some shortest match ends.
    Otherwise matches begin at the first byte and ``dead`` is the state that nothing leaves (-1: none).
    """

    def __init__(self, rules: tuple[Rule, ...], search: bool):
        nfa = _Nfa()
        root, accept = nfa.state(), {}
        for k, rule in enumerate(rules):
            own = nfa.state()
            nfa.empty[root].append(own)
            parsed = _PARSER.parse(rule.pattern)
            accept[nfa.add(_shortest(parsed) if search else parsed, own, rule.ignore_case)] = 1 << k
        byte_sets = {m[0] for moves in nfa.moves for m in moves}
        signature = [tuple(b in s for s in byte_sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.column = np.array([kinds[s] for s in signature], dtype=np.uint8)
        sample = {i: next(b for b in range(256) if self.column[b] == i) for i in range(len(kinds))}
        start = nfa.closure([root])
        names, todo, table, masks = {start: 0}, [start], [], []
        while todo:
            states = todo.pop(0)
            masks.append(sum({accept[s] for s in states if s in accept}))
            row = []
            for i in range(len(kinds)):
                to = {t for s in states for chars, t in nfa.moves[s] if sample[i] in chars}
                to = nfa.closure(to | ({root} if search else set()))
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row.append(names[to])
            table.append(row)
        self.step, self.accepts = self._minimal(np.array(table), np.array(masks))
        resets = (self.step == 0).all(axis=0)
        #: Bytes that bring every state back to the start.
        self.resets = resets[self.column] if search else None
        stays = (self.step == np.arange(len(self.step))[:, None]).all(axis=1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(stays)[0]) if not search and stays.any() else -1

    @staticmethod
    def _minimal(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Refine the partition by accepted rules until states of a block move to the same blocks."""
        _, block = np.unique(masks, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        order = {int(block[0]): 0}
        for b in block.tolist():
            order.setdefault(b, len(order))
        name = np.array([order[b] for b in block.tolist()])
        first = [int(np.flatnonzero(name == i)[0]) for i in range(len(order))]
        return name[table[first]].astype(np.int32), masks[first].astype(np.uint16)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.auto = Automaton(rules, search=True)
        self.single = [Automaton((r,), search=False) for r in rules]
        self.exact = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]
        #: Bytes of the shortest match of any rule.
        self.shortest = min((_PARSER.parse(r.pattern).getwidth()[0] for r in rules), default=1)
        self.columns = len(self.auto.step[0])
        self.flat = np.ascontiguousarray(self.auto.step * self.columns).ravel()  # states are row offsets
        self.rows = np.repeat(self.auto.accepts, self.columns)  # accepted rules by row offset

    def lanes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, accepted rules) of the lanes of ``data`` that reach an accepting state."""
        cut = np.flatnonzero(self.auto.resets[data])
        start = np.concatenate(([0], cut + 1))
        stop = np.concatenate((cut, [len(data)]))
        long = stop - start >= self.shortest
        start, stop = start[long], stop[long]
        order = np.argsort(start - stop, kind="stable")
        start, stop = start[order], stop[order]
        sizes = stop - start
        column = self.auto.column[data]
        state = np.zeros(len(start), dtype=np.int32)
        got = np.zeros(len(start), dtype=np.uint16)
        flat, rows = self.flat, self.rows
        i, live = 0, len(start)
        while live and i < sizes[0]:
            live = int(np.searchsorted(-sizes, -i, side="left"))
            if live < 8:
                break
            s = flat[state[:live] + column[start[:live] + i]]
            state[:live] = s
            got[:live] |= rows[s]
            i += 1
        for k in range(live if live < 8 else 0):
            s, mask, step = int(state[k]), int(got[k]), flat
            for c in column[start[k] + i : stop[k]].tolist():
                s = int(step[s + c])
                mask |= int(rows[s])
            got[k] = mask
        hit = np.flatnonzero(got)
        return start[hit], stop[hit], got[hit]

    def spans(self, data: bytes, a: int, b: int, mask: int) -> Iterator[tuple[int, int, int]]:
        """(rule, start, stop) in ``data[a:b]``, leftmost longest and apart, of the rules in ``mask``."""
        for k, rule in enumerate(self.rules):
            if not mask >> k & 1:
                continue
            auto = self.single[k]
            step, accepts, column, dead = auto.step.tolist(), auto.accepts.tolist(), auto.column.tolist(), auto.dead
            i = a
            while i < b:
                s, end, j = 0, -1, i
                while j < b:
                    s = step[s][column[data[j]]]
                    if s == dead:
                        break
                    j += 1
                    if accepts[s]:
                        end = j
                if end < 0:
                    i += 1
                    continue
                part = data[i:end] if not rule.group else self.exact[k].fullmatch(data[i:end]).group(rule.group)
                if len(part) >= rule.least:
                    yield k, i, end
                i = end

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the (start, stop, rule) spans in code points, by start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        data = b"\n".join(texts) + b"\n"
        arr = np.frombuffer(data, dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        found = [(i, j, k) for a, b, mask in zip(*(x.tolist() for x in self.lanes(arr)), strict=True) for k, i, j in self.spans(data, a, b, mask)]
        if found:
            at = np.array([i for i, _, _ in found])
            text = np.searchsorted(first, at, side="right") - 1
            begin = code_points_before(arr, np.concatenate((at, first[text])))
            start = begin[: len(at)] - begin[len(at) :]
            for t, a, (i, j, k) in zip(text.tolist(), start.tolist(), found, strict=True):
                out[t].append((a, a + j - i, k))  # secrets are ASCII
        return [sorted(x) for x in out]


def code_points_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points of the UTF-8 bytes lie before each place: one running count over the bytes."""
    if not len(at):
        return np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    edges = np.concatenate(([0], at[order]))
    begins = (data & 0xC0) != 0x80
    counts = np.array([np.count_nonzero(begins[a:z]) for a, z in zip(edges.tolist(), edges[1:].tolist())], dtype=np.int64)
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(counts)
    return out


SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean>>"


def spans_array(found: list[list[tuple[str, int, int, bool]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
    return pa.array([[dict(kind=k, start=a, stop=b, base=c) for k, a, b, c in x] for x in found], kind)


def _kernel(compiled, rules):
    def run(batches):
        scanner = shared(compiled)
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 1_000_000):
                found = scanner.scan([r[1] or b"" for r in part])
                named = [[(rules[k].kind, a, b, rules[k].base) for a, b, k in x] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.string()), spans_array(named)], names=["doc_id", "spans"]
                )

    return run


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row; spans are (kind, start, stop, base) in code points, stop exclusive.

    Spans are ordered by start, then by the order of the rules. Null and empty texts have none; whole texts are scanned, however
    long. Ids of any type, null ones too, stay; rows are scanned on their own, so repeated rows give equal rows, an
    empty table none; other columns are ignored.
    """
    if len(rules) > 16:
        raise ValueError("one automaton takes 16 rules")
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("binary")).mapInArrow(
        _kernel(share(docs.sparkSession, Scanner(rules)), rules), f"doc_id string, spans {SPANS}"
    )
    return rows.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "spans")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans share one mask."""
    compiled = share(docs.sparkSession, Scanner(RULES))

    @F.pandas_udf("string")
    def masked(values):
        scanner, out = shared(compiled), []
        for value in values:
            upto, parts = 0, []
            for a, b, _ in scanner.scan([value.encode()])[0] if value else ():
                if a >= upto:
                    parts += [value[upto:a], mask]
                upto = max(upto, b)
            out.append("".join([*parts, value[upto:]]) if value else value)
        return __import__("pandas").Series(out)

    return docs.withColumn(text, masked(F.col(text)))

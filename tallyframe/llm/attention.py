"""A small causal self-attention model in numpy: one masked attention layer over subword ids.

It serves for sequences of any kind of ids. Inputs are ids with an embedding of their own where they are frequent,
shared ones elsewhere. Position t
attends to itself and at least ``STRIDE`` earlier positions of its text; windows of ``2 * STRIDE`` positions
overlap by half, and the second half of each is scored, so each token is scored once. The output is a softmax in
two levels (group, member), then the corpus share of the id within its member's class.
"""

from __future__ import annotations

import numpy as np

WIDTH, STRIDE, GROUPS, MEMBERS = 16, 16, 16, 16
OWN, HASHED = 2048, 64
_CAUSAL = (np.arange(2 * STRIDE)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE).astype(np.float32)
_LAG = np.clip(np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :], 0, 2 * STRIDE - 1)


class Classes:
    """How ids enter the model and leave it, from their counts in the whole training corpus.

    ``inputs`` and ``counts``: how often each id is read and predicted; ``possible``: the ids that can be predicted.
    The most frequent inputs have embeddings of their own, all others share ``HASHED``. The ``OWN_CLASSES`` most
    frequent targets are classes by themselves; the others are dealt into classes of similar total count. As much as
    one count for each id seen is spread over all possible ids, so that none of them has probability 0.
    """

    OWN_CLASSES = GROUPS * MEMBERS - 64

    def __init__(self, inputs: np.ndarray, counts: np.ndarray, possible: np.ndarray):
        n = len(counts)
        order = np.argsort(-inputs, kind="stable")
        self.embedding = (OWN + np.arange(n) % HASHED).astype(np.int32)
        self.embedding[order[:OWN]] = np.arange(min(OWN, n))
        weight = np.where(possible, counts + max(1, np.count_nonzero(counts)) / n, 0.0)
        order = np.argsort(-weight, kind="stable")
        cls = np.zeros(n, dtype=np.int32)
        cls[order[: self.OWN_CLASSES]] = np.arange(min(self.OWN_CLASSES, n))
        if len(rest := order[self.OWN_CLASSES :]):
            part = np.cumsum(weight[rest]) / max(weight[rest].sum(), 1e-300)
            cls[rest] = self.OWN_CLASSES + np.minimum((part * 64).astype(int), 63)
        total = np.bincount(cls, weight, minlength=GROUPS * MEMBERS)
        with np.errstate(divide="ignore"):
            self.inside = np.log(weight / np.maximum(total, 1e-300)[cls])
        # classes are dealt to groups in turn by count, so that groups weigh about the same
        rank = np.empty(GROUPS * MEMBERS, dtype=np.int32)
        rank[np.argsort(-total, kind="stable")] = np.arange(GROUPS * MEMBERS)
        self.group, self.member = (rank[cls] % GROUPS).astype(np.uint8), rank[cls] // GROUPS
        grid = np.full((GROUPS, MEMBERS), 1e-6)
        grid[rank % GROUPS, rank // GROUPS] += total
        self.group_prior = np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32)
        self.member_prior = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)


SHAPES = {
    "embed": (OWN + HASHED, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
    "lag": (2 * STRIDE,), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, WIDTH, MEMBERS), "member_bias": (GROUPS, MEMBERS),
}


def initial(classes: Classes, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in SHAPES.items()}
    p["group"] *= 0.1
    p["member"] *= 0.1
    p["lag"] = (-0.3 * np.arange(2 * STRIDE)).astype(np.float32)
    p["group_bias"], p["member_bias"] = classes.group_prior.copy(), classes.member_prior.copy()
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _blocks(x: np.ndarray) -> np.ndarray:
    """(n, ...) -> (blocks, STRIDE, ...)"""
    return x.reshape(-1, STRIDE, *x.shape[1:])


def _windows(x: np.ndarray) -> np.ndarray:
    """Windows of each block but the first and the block before it, as views that overlap."""
    return np.lib.stride_tricks.as_strided(x, (len(x) // STRIDE - 1, 2 * STRIDE, *x.shape[1:]), (STRIDE * x.strides[0], *x.strides), writeable=False)


def _attend(p, rows: np.ndarray, text: np.ndarray, table: np.ndarray):
    """Hidden states of all positions; ``rows`` (embedding rows) and ``text`` (text numbers) start with a blank block.

    The values' last column is 1, so the weighted sum carries its own total.
    """
    met = np.take(table, rows, axis=0)
    queries = _blocks(met[STRIDE:])[..., WIDTH : 2 * WIDTH]
    keys, values = _windows(met[:, 2 * WIDTH : 3 * WIDTH]), _windows(met[:, 3 * WIDTH :])
    score = queries @ keys.transpose(0, 2, 1)
    score += np.where(_CAUSAL > 0, p["lag"][_LAG], np.float32(-1e4))
    np.minimum(score, 30, out=score)
    np.exp(score, out=score)
    blocks = _blocks(text)
    mixed = np.flatnonzero((blocks[:-1, 0] != blocks[1:, -1]) | (blocks[:-1, -1] != blocks[1:, 0]))
    if 2 * len(mixed) > len(score):
        score *= _windows(text)[:, None, :] == blocks[1:, :, None]
    elif len(mixed):
        around = np.concatenate((blocks[mixed], blocks[mixed + 1]), axis=1)
        score[mixed] *= around[:, None, :] == blocks[mixed + 1][:, :, None]
    summed = (score @ values).reshape(-1, WIDTH + 1)
    context = summed[:, :WIDTH] / summed[:, WIDTH:]
    hidden = context + met[STRIDE:, :WIDTH]
    hidden /= 1 + np.abs(hidden)
    return hidden, score, summed[:, WIDTH], context, met, queries, keys, values


def _table(p) -> np.ndarray:
    """By embedding row: the embedding, its query, scaled, its key and value, and a 1."""
    e = p["embed"]
    projections = np.concatenate((p["query"] / np.float32(np.sqrt(WIDTH)), p["key"], p["value"]), axis=1)
    return np.concatenate((e, e @ projections, np.ones((len(e), 1), e.dtype)), axis=1)


def _padded(rows: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole blocks, a blank one first. Texts are numbered anew, one after the other: short numbers tell those of a window apart."""
    tail = -len(rows) % STRIDE
    marks = np.concatenate((np.full(STRIDE, -1, text.dtype), text, np.full(tail, -2, text.dtype)))
    marks[1:] = np.cumsum(marks[1:] != marks[:-1])
    marks[0] = 0
    return np.concatenate((np.zeros(STRIDE, rows.dtype), rows, np.zeros(tail, rows.dtype))), marks.astype(np.int16)


def _block_starts(text: np.ndarray) -> np.ndarray:
    """Places for the positions of all texts, each text from the start of a block on."""
    begin = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(text)))
    room = -(-size // STRIDE) * STRIDE
    return np.arange(len(text)) + np.repeat(np.cumsum(room) - room - begin, size)


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions dealt to shelves of equal room that hold one group each: the place of every position, the shelves' groups, the room.

    A group takes as many shelves as it needs; there are less than 48 and half as many free places as positions, so
    that one product over all shelves does for any mix of groups.
    """
    size = np.bincount(group, minlength=GROUPS)
    room = max(1, -(-len(group) // (2 * GROUPS)))
    shelves = -(-size // room)
    begin = (np.cumsum(shelves) - shelves) * room - (np.cumsum(size) - size)
    place = np.empty(len(group), np.int64)
    place[np.argsort(group, kind="stable")] = np.arange(len(group)) + np.repeat(begin, size)
    return place, np.repeat(np.arange(GROUPS), shelves), room


class Model:
    def __init__(self, classes: Classes, p: dict[str, np.ndarray]):
        self.classes, self.p = classes, p

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, text: np.ndarray, aligned: bool = False, chunk: int = 8_192) -> np.ndarray:
        """Natural log probability of each target; texts are numbered by ``text`` and stand one after the other.

        ``aligned``: every text begins a block, so that its windows do not depend on what stands before it.
        """
        c, p, n = self.classes, self.p, len(inputs)
        place = _block_starts(text) if aligned else np.arange(n)
        size = int(place[-1]) + 1 if n else 0
        table, ones = _table(p), np.ones(MEMBERS, np.float32)
        rows, marks = np.zeros(size, c.embedding.dtype), np.full(size, -2)
        rows[place], marks[place] = c.embedding[inputs], text
        rows, marks = _padded(rows, marks)
        out = c.inside[targets].astype(np.float64)
        for at in range(0, size, chunk):
            stop = min(len(rows) - STRIDE, at + chunk)
            a, z = np.searchsorted(place, (at, stop))
            hidden = _attend(p, rows[at : stop + STRIDE], marks[at : stop + STRIDE], table)[0][place[a:z] - at]
            group, member = c.group[targets[a:z]], c.member[targets[a:z]]
            top = hidden @ p["group"]
            top += p["group_bias"]
            got = top[np.arange(z - a), group]
            total = np.exp(top, out=top) @ ones
            seat, shelf, room = _by_group(group)
            spread = np.zeros((len(shelf) * room, WIDTH), hidden.dtype)
            spread[seat] = hidden
            low = spread.reshape(-1, room, WIDTH) @ p["member"][shelf]
            low += p["member_bias"][shelf][:, None]
            low = low.reshape(-1, MEMBERS)
            got += low[seat, member]
            total *= (np.exp(low, out=low) @ ones)[seat]
            out[a:z] += got - np.log(total)
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, text: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the class choices and its gradient."""
        c, p, n = self.classes, self.p, len(inputs)
        rows, marks = _padded(c.embedding[inputs], text)
        full, weight, total, context, met, queries, keys, values = _attend(p, rows, marks, _table(p))
        hidden = full[:n]
        group, member = c.group[targets], c.member[targets]
        g = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        ones, every = np.ones(MEMBERS, np.float32), np.arange(n)
        top = hidden @ p["group"]
        top += p["group_bias"]
        np.exp(top, out=top)
        top /= (top @ ones)[:, None]
        right = top[every, group]
        top[every, group] -= 1
        g["group"], g["group_bias"] = hidden.T @ top, np.ones(n, np.float32) @ top
        dh = top @ p["group"].T
        place, shelf, room = _by_group(group)
        spread = np.zeros((len(shelf) * room, WIDTH), hidden.dtype)
        spread[place] = hidden
        spread = spread.reshape(-1, room, WIDTH)
        low = spread @ p["member"][shelf]
        low += p["member_bias"][shelf][:, None]
        low = low.reshape(-1, MEMBERS)
        np.exp(low, out=low)
        low /= (low @ ones)[:, None]
        right_member = low[place, member]
        low[place, member] -= 1
        free = np.ones(len(low), dtype=bool)
        free[place] = False
        low[np.flatnonzero(free)] = 0
        low = low.reshape(-1, room, MEMBERS)
        held = (np.arange(GROUPS)[:, None] == shelf).astype(np.float32)
        g["member"] = (held @ (spread.transpose(0, 2, 1) @ low).reshape(-1, WIDTH * MEMBERS)).reshape(GROUPS, WIDTH, MEMBERS)
        g["member_bias"] = held @ (np.ones(room, np.float32) @ low)
        dh += (low @ np.ascontiguousarray(p["member"].transpose(0, 2, 1))[shelf]).reshape(-1, WIDTH)[place]
        loss = -np.log(right).sum() - np.log(right_member).sum()
        dz = np.zeros_like(full)
        slope = 1 - np.abs(hidden)
        slope *= slope
        np.multiply(dh, slope, out=dz[:n])
        # what a window's weights get: the last column, against the values' 1, takes off what all of them share
        shift = np.empty((len(full), WIDTH + 1), full.dtype)
        np.divide(dz, total[:, None], out=shift[:, :WIDTH])
        np.einsum("ij,ij->i", shift[:, :WIDTH], context, out=shift[:, WIDTH])
        np.negative(shift[:, WIDTH], out=shift[:, WIDTH])
        shift = _blocks(shift)
        dscore = shift @ values.transpose(0, 2, 1)
        dscore *= weight
        g["lag"] = np.bincount(_LAG.ravel(), dscore.sum(axis=0).ravel(), minlength=2 * STRIDE).astype(np.float32)

        def folded(weights, d):  # a block is the second half of its window and the first of the next
            out = np.zeros((len(weights) + 2, 2 * STRIDE, WIDTH), d.dtype)
            np.matmul(weights.transpose(0, 2, 1), d, out=out[1:-1])
            return (out[:-1, STRIDE:] + out[1:, :STRIDE]).reshape(-1, WIDTH)

        dq, dk, dv = (dscore @ keys).reshape(-1, WIDTH), folded(dscore, queries), folded(weight, shift[..., :WIDTH])
        own, scale = np.ascontiguousarray(met[:, :WIDTH]), np.float32(np.sqrt(WIDTH))
        g["query"], g["key"], g["value"] = own[STRIDE:].T @ dq / scale, own.T @ dk, own.T @ dv
        de = dk @ p["key"].T
        de += dv @ p["value"].T
        dz += dq @ (p["query"].T / scale)
        de[STRIDE:] += dz
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
        g["embed"][rows[order[first]]] = np.add.reduceat(np.take(de, order, axis=0), first, axis=0)
        return float(loss) / n, {k: x / np.float32(n) for k, x in g.items()}


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * x * x
            p[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)

"""MinHash near-dedup as a chosen-path set similarity join.

Each distinct shingle set has ``TREES`` x ``DEPTH`` minwise tokens. In every tree the sets branch by their
tokens, one level after the other: a node holds the sets that share the tokens of its path. Nodes of at most
``LIMIT`` sets are leaves; larger ones branch on, down to ``DEPTH``. A pair of Jaccard similarity 0.8 stays
together over d levels of one tree with probability 0.8^d, so ``TREES`` independent trees miss it with
(1 - 0.8^d)^TREES: 3e-7 at the full depth of six levels, less at fewer. Tokens below the roots are kept by their lower
halves: equal ones stay equal, others agree by chance once in 65,536, which adds candidates and loses none.

Candidates are compared in two passes, so that groups of copies never become all their pairs. First every
set is held against the smallest set of its nodes (a star, two of which are confirmed per set). Confirmed
links are closed to components; then leaves, and the nodes that are still large at the full depth, are
compared exhaustively between sets of different components; sets that meet a large component are compared with
all its members. Comparing means: sizes within the threshold
and 128-bit one-bit minwise sketches that agree in at least ``SKETCH_AGREES`` places (a pair at 0.8 agrees in
115 on average, deviation 3.4). Sets that may link by these are gathered to clusters, whose shingle hashes meet once, block
against block; blocks give out links only, no candidates, and no more than join their sets. Links are
confirmed exactly on the full shingle sets of both texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._shared import materialize, rows_of, sized
from tallyframe.llm.components import components

TREES, DEPTH, ROOT_DEPTH, LIMIT = 50, 6, 2, 24
SKETCH_AGREES = 98
#: Numbers that a set keeps of its path in a tree: the tokens of the root, then the others two by two.
PACKED = ROOT_DEPTH + (DEPTH - ROOT_DEPTH) // 2
#: Vertices of candidate links up to which their ids (8 bytes each) are broadcast.
BROADCAST_IDS = 500_000
#: Components of more sets are compared as groups, in blocks of so many sets.
GROUP, BLOCK = 32, 512
#: Minwise values that the sketch takes a bit of each; the trees go on in the same row of values beyond them.
_POOL = 128
_PROFILE = "doc long, n_shingles long, ka long, kb long, s1 long, s2 long, tokens array<int>"


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = max(_POOL, TREES * DEPTH)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The exact set: distinct ``k``-word shingles, or the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def profiles_of(texts: list[bytes], k: int, sets_only: bool = False):
    """Per text: set size, two set hashes, two sketch words, and the minwise tokens; or the sorted shingle hashes."""
    import xxhash

    words = [t.lower().split() for t in texts]
    seen: dict[bytes, int] = {}
    counts = np.array([len(w) for w in words])
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in chain.from_iterable(words)), np.int64, int(counts.sum()))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
    word = hashes[ids]
    ends = np.cumsum(counts)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        own = word[end - n : end]
        size = min(k, n)
        if not n:
            sets.append(own)
            continue
        h = np.full(n - size + 1, size, dtype=np.uint64)
        for j in range(size):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + own[j : n - size + 1 + j])
        sets.append(np.unique(h))
    if sets_only:
        return sets
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    ka, kb = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    tokens = np.zeros((len(texts), max(_POOL, TREES * DEPTH)), np.uint32)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        ka[some] = np.add.reduceat(_mix(flat + np.uint64(1)), at)
        kb[some] = np.add.reduceat(_mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
        short = (flat >> np.uint64(32)).astype(np.uint32)
        for j, (seed, mult) in enumerate(zip(*_seeds(), strict=True)):
            h = (short ^ seed) * mult
            h ^= h >> np.uint32(15)
            tokens[some, j] = np.minimum.reduceat(h * np.uint32(0x2C1B3C6D), at)
    bits = (tokens[:, :_POOL] * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64)
    places = np.uint64(1) << np.arange(64, dtype=np.uint64)
    s1, s2 = (bits[:, :64] * places).sum(axis=1, dtype=np.uint64), (bits[:, 64:] * places).sum(axis=1, dtype=np.uint64)
    return sizes, ka, kb, s1, s2, tokens[:, : TREES * DEPTH]


def packed(tokens: np.ndarray) -> np.ndarray:
    """``PACKED`` numbers a tree: tokens of the root as they are, the lower halves of the others side by side."""
    paths = tokens.reshape(len(tokens), TREES, DEPTH)
    low = paths[:, :, ROOT_DEPTH:] & np.uint32(0xFFFF)
    return np.concatenate((paths[:, :, :ROOT_DEPTH], low[:, :, ::2] << np.uint32(16) | low[:, :, 1::2]), axis=2).reshape(len(tokens), -1)


def _profile(k: int):
    def run(batches):
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 1_000_000):
                sizes, *longs, tokens = profiles_of([r[1] or b"" for r in part], k)
                tokens = packed(tokens)
                values = pa.array(tokens.ravel().view(np.int32))
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * tokens.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(x.view(np.int64)) for x in longs),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    names=[c.split()[0] for c in _PROFILE.split(", ")],
                )

    return run


def _alike(n1: str, n2: str, a: tuple[str, str], b: tuple[str, str], percent: int) -> Column:
    """What every pair at the threshold meets (sizes) or meets but for chance (sketches)."""
    sizes = (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
    differ = F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))
    return sizes & (differ <= _POOL - SKETCH_AGREES)


def _descend(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Branch level by level. Returns the star candidates (a, b, differ) and the rows (node, v, n, s1, s2) to compare."""
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.slice("tokens", t * PACKED + 1, F.lit(PACKED)).alias("path")),
    )
    rows = sets.select("v", F.col("n_shingles").cast("int").alias("n"), "s1", "s2", F.explode(trees).alias("t")).select(
        "v", "n", "s1", "s2",
        F.xxhash64("t.tree", *(F.col("t.path")[i] for i in range(ROOT_DEPTH))).alias("node"),
        F.slice("t.path", ROOT_DEPTH + 1, PACKED - ROOT_DEPTH).alias("rest"),
    )
    stars, leaves = [], []
    for depth in range(ROOT_DEPTH, DEPTH + 1):
        nodes = materialize(
            rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("v", "n", "s1", "s2")).alias("c")).where("size > 1"), "nodes"
        ).select("node", "size", F.col("c.v").alias("cv"), F.col("c.n").alias("cn"), F.col("c.s1").alias("c1"), F.col("c.s2").alias("c2"))
        near = _alike("n", "cn", ("s1", "s2"), ("c1", "c2"), percent) & (F.col("v") != F.col("cv"))
        differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("c1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("c2")))
        deep = F.col("size") > LIMIT if depth < DEPTH else F.lit(False)
        level = materialize(
            rows.join(nodes, "node").select(
                "node", "v", "n", "s1", "s2", deep.alias("deep"), F.when(deep, F.col("rest")).alias("rest"),
                F.when(near, F.col("cv")).alias("star"), F.when(near, differ.cast("int")).alias("differ"),
            ),
            "level",
        )
        stars.append(level.where("star IS NOT NULL").select(F.col("v").alias("a"), F.col("star").alias("b"), "differ"))
        leaves.append(level.where("NOT deep").select("node", "v", "n", "s1", "s2"))
        pair, second = divmod(depth - ROOT_DEPTH, 2)
        token = F.shiftrightunsigned(F.get("rest", F.lit(pair)), 0 if second else 16).bitwiseAND(0xFFFF)
        rows = level.where("deep").select("v", "n", "s1", "s2", F.xxhash64("node", token).alias("node"), "rest")
        if depth < DEPTH and rows.isEmpty():
            break
    star, leaf = stars[0], leaves[0]
    for s in stars[1:]:
        star = star.union(s)
    for x in leaves[1:]:
        leaf = leaf.union(x)
    return star, leaf


def _confirm(k: int, percent: int):
    """Arrow kernel (a, b, text of a, text of b) -> (a, b) of the pairs whose full sets meet the threshold."""

    def run(batches):
        last, kept = None, set()
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in range(4))
            links = []
            for i in range(batch.num_rows):
                text = tb[i].as_py()
                if last is None or text != last:
                    last, kept = text, shingle_set(text, k)
                own = shingle_set(ta[i].as_py(), k)
                common = len(own & kept)
                if common and 100 * common >= percent * (len(own) + len(kept) - common):
                    links.append(i)
            at = pa.array(links, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    return run


def _only(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """The texts of the written ids ``ends`` (v); few ids are broadcast, their number is counted first."""
    return texts.join(F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends, "v", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have ``percent`` % of their union in common."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    wanted = materialize(_only(texts, materialize(ends, "ends")), "texts")
    left = wanted.select(F.col("v").alias("a"), F.col("text").alias("ta"))
    right = wanted.select(F.col("v").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return materialize(joined.mapInArrow(_confirm(k, percent), "a long, b long"), "links")


def _node_labels():
    """Arrow kernel over nodes (arrays v, n, s1, s2, own of their sets) -> (a, b): each set that may link to a set of another
    component of the node, and the smallest set that such possible links lead to."""

    def labels(v, n, s1, s2, own, percent):
        differ = np.bitwise_count(s1[:, :, None] ^ s1[:, None, :]) + np.bitwise_count(s2[:, :, None] ^ s2[:, None, :])
        low, high = np.minimum(n[:, :, None], n[:, None, :]), np.maximum(n[:, :, None], n[:, None, :])
        alike = (differ <= _POOL - SKETCH_AGREES) & (low * 100 >= high * percent) & (own[:, :, None] != own[:, None, :]) & (low > 0)
        least = np.where(alike.any(axis=2), v, np.iinfo(np.int64).max)
        while True:
            near = np.minimum(np.where(alike, least[:, None, :], np.iinfo(np.int64).max).min(axis=2), least)
            if (near == least).all():
                break
            least = near
        return np.nonzero(alike.any(axis=2) & (least != v)), least

    def padded(column: pa.Array, width: int, dtype) -> np.ndarray:
        flat, at = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
        out = np.zeros((len(at), width), dtype)
        out[np.arange(width) < at[:, None]] = flat.astype(dtype, copy=False)
        return out

    def run(percent):
        def kernel(batches):
            for batch in batches:
                sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
                order, at = np.argsort(sizes, kind="stable"), 0
                while at < len(order):
                    # nodes of like size side by side, a few million cells at once
                    width = int(sizes[order[min(len(order), at + max(1, 4_000_000 // int(sizes[order[at]]) ** 2)) - 1]])
                    upto = at + max(1, min(4_000_000 // width**2, int(np.searchsorted(sizes[order], width, "right")) - at))
                    width = int(sizes[order[upto - 1]])
                    part = batch.take(pa.array(order[at:upto]))
                    at = upto
                    v, n, s1, s2, own = (padded(part.column(c), width, t) for c, t in enumerate((np.int64, np.int64, np.uint64, np.uint64, np.int64)))
                    where, least = labels(v, n, s1, s2, own, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(v[where]), pa.array(least[where])], names=["a", "b"])

        return kernel

    return run


def _sets_of(k: int):
    """Arrow kernel (v, text) -> (v, hashes): the sorted 64-bit hashes of the shingles, packed."""

    def run(batches):
        for batch in batches:
            for part in sized(rows_of(batch, 2), lambda r: len(r[1] or b""), 1_000_000):
                sets = profiles_of([r[1] or b"" for r in part], k, sets_only=True)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["v", "hashes"])

    return run


def _link_block(percent: int):
    """Arrow group (i, j, at, cluster, v, own, s1, s2, hashes) -> links between components, enough to join what links join.

    Sets of one cluster and different components are compared: sizes and sketches first, then the shingle hashes.
    """

    def run(table: pa.Table) -> pa.Table:
        i, j, at, cluster, v, own, s1, s2 = (table.column(c).to_numpy() for c in range(8))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        s1, s2, joined, out = s1.view(np.uint64), s2.view(np.uint64), own.copy(), []
        for x in np.flatnonzero(at == i):
            # the other block, or what comes later in the same one
            may = (at == j) & (cluster == cluster[x]) & (joined != joined[x])
            may[: x + 1] &= i[x] != j[x]
            may &= np.minimum(sizes, sizes[x]) * 100 >= np.maximum(sizes, sizes[x]) * percent
            may &= np.bitwise_count(s1 ^ s1[x]) + np.bitwise_count(s2 ^ s2[x]) <= _POOL - SKETCH_AGREES
            for y in np.flatnonzero(may):
                if joined[x] == joined[y]:
                    continue
                place = np.minimum(np.searchsorted(sets[y], sets[x]), sizes[y] - 1)
                common = int((sets[y][place] == sets[x]).sum())
                if common and 100 * common >= percent * (sizes[x] + sizes[y] - common):
                    out.append((max(v[x], v[y]), min(v[x], v[y])))
                    joined[joined == joined[y]] = joined[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _across(leaf: DataFrame, near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare between different components: (v, cluster) and, for components over ``GROUP``, (v, component).

    Sets of a node whose sizes and sketches allow a link share a cluster: clusters are the components of these
    possible links, of which each set names one a node, never all. Sets of large components name none; a set that may link
    to members of a large component is named once, not with each member.
    """
    of = near.join(near.groupBy("component").agg(F.count("*").alias("many")), "component").select("v", F.col("component").alias("own"), "many")
    leaf = materialize(
        leaf.join(of, "v", "left").withColumns({"own": F.coalesce("own", "v"), "many": F.coalesce("many", F.lit(1))}), "leaves"
    )
    small = leaf.where(F.col("many") <= GROUP)
    mixed = small.groupBy("node").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size")).where("low < high")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = small.join(materialize(mixed.select("node", parts.alias("parts")), "mixed"), "node")
    mine = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    rows = rows.withColumn("at", mine).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = rows.groupBy("node", F.least("at", "y").alias("i"), F.greatest("at", "y").alias("j")).agg(  # two blocks at most
        F.collect_list(F.struct("v", "n", "s1", "s2", "own")).alias("x")
    )
    possible = met.select(*(F.col(f"x.{c}").alias(c) for c in ("v", "n", "s1", "s2", "own"))).mapInArrow(_node_labels()(percent), "a long, b long")
    clusters = components(possible).withColumnRenamed("component", "cluster")
    large = leaf.where(F.col("many") > GROUP)
    parts = materialize(large.groupBy("node", "own").agg(F.min("n").alias("low"), F.max("n").alias("high")), "parts")
    every = leaf.select("node", F.col("v"), "n", F.col("own").alias("mine"))
    outside = (
        every.join(parts, "node")
        .where((F.col("mine") != F.col("own")) & (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent))
        .select("v", F.col("own").alias("component")).distinct()
    )
    return materialize(clusters, "clusters"), materialize(outside, "outside")


def _within_clusters(clusters: DataFrame, sets: DataFrame, hashed: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside clusters: small clusters by the dozen, large ones block against block of ``BLOCK`` sets."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = clusters.join(sizes, "cluster").join(near.withColumnRenamed("component", "own"), "v", "left")
    mine = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    rows = rows.withColumns({"own": F.coalesce("own", "v"), "at": mine}).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dozens = max(1, clusters.count() // BLOCK)
    rows = rows.withColumns({
        "i": F.least("at", "y"), "j": F.greatest("at", "y"),
        "task": F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(dozens))).otherwise(F.col("cluster")), "one": F.col("parts") == 1,
    })
    rows = materialize(rows.select("task", "one", "i", "j", "at", "cluster", "v", "own"), "dealt")
    full = rows.join(sets.select("v", "s1", "s2"), "v").join(hashed, "v")
    full = full.select("i", "j", "at", "cluster", "v", "own", "s1", "s2", "hashes", "task", "one")
    return full.groupBy("task", "one", "i", "j").applyInArrow(_link_block(percent), "a long, b long")


def _compare_blocks(percent: int):
    """Arrow group of rows (inside, v, hashes): links of the sets outside with those inside, one for each set at most."""

    def run(table: pa.Table) -> pa.Table:
        inside, ids = (table.column(c).to_pylist() for c in ("inside", "v"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        here = [i for i, x in enumerate(inside) if x]
        a, b = [], []
        if here:
            sizes = np.array([len(sets[i]) for i in here])
            flat, owner = np.concatenate([sets[i] for i in here]), np.repeat(np.arange(len(here)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in (i for i, x in enumerate(inside) if not x):
                low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(owner[at], minlength=len(here))
                hit = np.flatnonzero((common > 0) & (100 * common >= percent * (len(sets[i]) + sizes - common)))
                if len(hit):
                    best = int(hit[np.argmax(common[hit])])
                    a.append(max(ids[i], ids[here[best]]))
                    b.append(min(ids[i], ids[here[best]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _against_groups(outside: DataFrame, near: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets and the large components they may belong to: every member is compared, block by block.

    Members and sets are dealt into blocks of ``BLOCK``; a task compares a block of the one with a block of the other, so no
    task grows with the group. One link suffices to join a set to a component.
    """
    sizes = near.groupBy("component").agg(F.count("*").alias("members"))
    plan = outside.groupBy("component").agg(F.count("*").alias("others")).join(sizes, "component").select(
        "component", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("others") / BLOCK).cast("int").alias("ob")
    )
    plan = materialize(plan, "blocks")
    deal = lambda mine, count: F.pmod(F.xxhash64("v"), F.col(count)).cast("int").alias(mine)
    members = near.join(plan, "component").select("component", "v", F.lit(True).alias("inside"), deal("i", "mb"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"))
    others = outside.join(plan, "component").select("component", "v", F.lit(False).alias("inside"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), deal("j", "ob"))
    rows = members.select("component", "i", "j", "inside", "v").union(others.select("component", "i", "j", "inside", "v"))
    return rows.join(hashed, "v").groupBy("component", "i", "j").applyInArrow(_compare_blocks(percent), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set: the distinct ``k``-word shingles of its words (A-Z lower-cased, split at ASCII blanks);
    with fewer words, the whole sequence. Documents with equal sets, or with ``percent`` % of the union in
    common, are linked; component_id is the smallest id reachable and ``kept`` marks the document that has
    it. Texts without words, null or empty, are linked with nothing. Rows with a null id keep a null
    component and are kept. Ids are expected to be unique; repeated rows give equal rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("v"), F.col(text).alias("text"))
    profiles = materialize(source.select("v", F.col("text").cast("binary")).mapInArrow(_profile(k), _PROFILE), "profiles")
    real = profiles.where("n_shingles > 0 AND doc IS NOT NULL")
    rest = ("n_shingles", "s1", "s2", "tokens")
    sets = materialize(
        real.groupBy("ka", "kb").agg(F.min("doc").alias("v"), *(F.first(c).alias(c) for c in rest)), "sets"
    )
    star, leaf = _descend(sets, percent)
    best = star.groupBy("a").agg(F.min("b").alias("low"), F.min_by("b", F.struct("differ", "b")).alias("close"))
    first = best.select("a", F.explode(F.array_distinct(F.array("low", "close"))).alias("b"))
    texts = source.where("v IS NOT NULL")
    links = confirmed(first, texts, k, percent)
    near = components(links)

    clusters, outside = _across(leaf, near, percent)
    held = near.join(outside.select("component").distinct(), "component", "left_semi").select("v")
    wanted = materialize(clusters.select("v").union(outside.select("v")).union(held).distinct(), "ends")
    hashed = materialize(_only(texts, wanted).select("v", F.col("text").cast("binary")).mapInArrow(_sets_of(k), "v long, hashes binary").dropDuplicates(["v"]), "hashes")
    found = _within_clusters(clusters, sets, hashed, near, percent).union(_against_groups(outside, near, hashed, percent))
    second = confirmed(found, texts, k, percent)
    whole = components(links.union(second))

    of_set = sets.select("ka", "kb", "v").join(whole, "v", "left").select(
        "ka", "kb", F.coalesce("component", "v").alias("component")
    )
    named = real.select("doc", "n_shingles", "ka", "kb").join(of_set, ["ka", "kb"]).select("doc", "n_shingles", "component")
    empty = profiles.where("n_shingles = 0 OR doc IS NULL").select("doc", "n_shingles", F.col("doc").alias("component"))
    return named.union(empty).select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns stay as they are."""
    out = near_duplicates(docs, doc_id, text, k, percent)
    gone = materialize(out.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")

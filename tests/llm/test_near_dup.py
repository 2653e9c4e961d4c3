import random

from tallyframe.llm import near_dup
from tallyframe.llm.components import components


def brute(docs, k, percent):
    sets = {d: near_dup.shingle_set(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "a b"), (1006, "A\tB")]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(15, 60))] for _ in range(25)]
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, " ".join(words)))
    return docs


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (5000, 5001)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000}


def test_equals_brute_force(spark):
    docs = corpus(11)
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, v int").repartition(4)
    for k in (2, 5):
        want = brute(docs, k, 80)
        rows = near_dup.near_duplicates(df, k=k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = {d for d, (_, c) in want.items() if c == d}
    assert {r.doc_id for r in near_dup.drop_near_duplicates(df).collect()} == kept


def test_large_group_of_near_copies_and_empty_table(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    docs = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, k=2).collect()} == want
    assert near_dup.near_duplicates(df.limit(0), k=2).count() == 0


def test_trees_find_pairs_at_the_threshold_at_full_depth():
    miss = (1 - 0.8**near_dup.DEPTH) ** near_dup.TREES
    assert miss < 3e-7
    rng, pairs = random.Random(9), 2000
    texts = []
    for _ in range(pairs):
        words = [str(rng.random()) for _ in range(36)]
        texts += [" ".join(words[:32]), " ".join(words[4:])]
    # sets of 32 words, 28 of them in both: 28 of 36 in common, a little under the threshold
    *_, tokens = near_dup.profiles_of([t.encode() for t in texts], 1)
    assert tokens.shape == (2 * pairs, near_dup.TREES * near_dup.DEPTH)
    same = (tokens[::2] == tokens[1::2]).reshape(pairs, near_dup.TREES, near_dup.DEPTH)
    found = same.all(axis=2).any(axis=1).sum()
    assert found == pairs


def test_rows_keep_whole_root_tokens_and_halves_of_the_others(spark):
    docs = corpus(3, 40)
    *_, tokens = near_dup.profiles_of([(t or "").encode() for _, t in docs], 2)
    paths = tokens.reshape(len(docs), near_dup.TREES, near_dup.DEPTH)
    df = spark.createDataFrame(docs, "v long, text string").selectExpr("v", "cast(text AS binary)")
    rows = {r.doc: r.tokens for r in df.mapInArrow(near_dup._profile(2), near_dup._PROFILE).collect()}
    for (d, _), path in zip(docs, paths.tolist(), strict=True):
        assert len(rows[d]) == 4 * near_dup.TREES
        for tree, whole in enumerate(path):
            own = [x % 2**32 for x in rows[d][4 * tree : 4 * tree + 4]]
            low = [x % 2**16 for x in whole[2:]]
            assert own == [*whole[:2], low[0] << 16 | low[1], low[2] << 16 | low[3]]


def test_levels_branch_by_each_token_of_the_path(spark):
    # 60 sets share the root and all tokens but one of each tree: they part at that token's level, into nodes of one
    root, halves = (7, 8), (5, 6, 9, 10)
    rows = []
    for place in range(4):
        for i in range(60):
            low = [*halves]
            low[place] = 1000 + i
            rows.append((place * 100 + i, 10, 0, 0, [root[0] + place, root[1], low[0] << 16 | low[1], low[2] << 16 | low[3]] * near_dup.TREES))
    sets = spark.createDataFrame(rows, "v long, n_shingles long, s1 long, s2 long, tokens array<int>")
    _, leaf = near_dup._descend(sets, 80)
    assert leaf.count() == 0
    same = spark.createDataFrame([(v, n, a, b, t) for v, n, a, b, t in rows[:60]] + [(900, 10, 0, 0, rows[0][4])], sets.schema)
    assert {r.v for r in near_dup._descend(same, 80)[1].select("v").distinct().collect()} == {0, 900}

import random

from tallyframe.llm import line_dedup


def brute(docs):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    holders = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and d is not None:
                holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        drop = [d is not None and len(h := holders.get(key(x), ())) >= 5 and max(h) != d for x in lines]
        out.append((d, len(lines), sum(drop), "\n".join(x for x, y in zip(lines, drop) if not y)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    shared = [f"Shared line number {i} with É and Some Capitals to pass forty" for i in range(6)] + ["short"]
    docs = [(None, "\n".join(shared)), (100, None), (101, ""), (102, "\n\n")]
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            x = rng.choice(shared) if rng.random() < 0.6 else f"own line {rng.random()} of document {d} that is quite long"
            lines.append(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and "É" not in x else x) + rng.choice(["", "\r"]))
        docs.append((d, "\n".join(lines)))
    docs.append(docs[-1])
    docs.append((59, "same id, another text\n" + shared[0]))
    df = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, gaps string").repartition(4)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs), key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_hot_line_leaves_once(spark):
    hot = "this very line stands in a great many of the documents"
    df = spark.createDataFrame([(i, f"{hot}\nrow {i}\n{hot}") for i in range(500)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()}
    assert rows[499] == (0, f"{hot}\nrow 499\n{hot}")
    assert all(rows[i] == (2, f"row {i}") for i in range(499))

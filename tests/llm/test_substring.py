import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.queries import QUERIES
from tallyframe.llm.substring import COVERS, cover_for, dedup_substrings

SCHEMA = "doc_id long, text string, source string, n_words string"


def brute(rows, n=13):
    """Kept words by rows: a window goes where a smaller id has the same one."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    lowest = {}
    for d, w in words:
        for i in range(len(w) - n + 1 if d is not None else 0):
            k = tuple(w[i : i + n])
            lowest[k] = min(lowest.get(k, d), d)
    out = []
    for d, w in words:
        gone = {p for i in range(len(w) - n + 1 if d is not None else 0) if lowest[tuple(w[i : i + n])] < d for p in range(i, i + n)}
        out.append((d, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, n=13, parts=3):
    docs = spark.createDataFrame([(d, t, "s", "x") for d, t in rows], SCHEMA).repartition(parts)
    out = dedup_substrings(docs, n=n)
    assert out.columns == ["doc_id", "text", "source", "n_words", "n_removed", "kept_text"]
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_text")) for r in out.collect()), key=str)


def planted(seed, docs, vocabulary):
    """Texts over few words with passages that start at every place modulo the period, some repeated in one text."""
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    passages = [some(k) for k in (12, 13, 14, 19, 20, 60)]
    rows = []
    for d in range(docs):
        words = some(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages) + some(rng.randrange(9))
        rows.append((d * 7 % docs, "\t".join(words)))
    return rows


def test_covers_hold_every_difference():
    for p, cover in COVERS.items():
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))
    assert cover_for(13) == (7, (0, 1, 3)) and cover_for(1) == (1, (0,)) and cover_for(6)[0] == 3


@pytest.mark.parametrize("n", [2, 5, 13])
def test_equals_brute_force(spark, n):
    rows = planted(n, 150, 2000 if n > 5 else 12)
    got = found(spark, rows, n)
    assert got == brute(rows, n) and sum(r[2] for r in got) > 200


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [
        (None, long), (None, long), (3, None), (4, ""), (5, " \x0b\f\n"), (6, long), (6, long), (7, long), (8, "x " + long.upper()),
        (9, " ".join(f"a{i}" for i in range(12))), (10, " ".join(["z"] * 400)), (11, " ".join(["z"] * 13)), (2, "é" + long[2:]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (1, a + " " + b), (2, b + " y " + a), (None, a)]
    assert found(spark, rows) == brute(rows)


def test_very_long_text_and_hot_passage(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    hot = " ".join(f"h{i}" for i in range(30))
    rows = [(0, long), (1, "q " + long)] + [(i, f"{hot} t{i} u{i}") for i in range(2, 900)]
    out = {r[0]: r for r in found(spark, rows, parts=8)}
    assert out[0][2] == 0 and out[1][2] == 300_000 and out[1][3] == "q"
    assert out[2][2] == 0 and all(out[i][3] == f"t{i} u{i}" for i in range(3, 900))


def test_text_ids_raise(spark):
    with pytest.raises(ValueError, match="integer"):
        dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    from tallyframe.llm import substring

    rows = planted(1, 80, 300)
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    assert found(spark, rows) == brute(rows)


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(docs))
    out = QUERIES["op11_substring_dedup"](spark, sf)
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want
    assert out.agg(F.sum("n_removed")).first()[0] > 0

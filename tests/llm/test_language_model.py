import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import attention, bpe, language_model
from tallyframe.llm.queries import held_out


@pytest.fixture(scope="module")
def ranks(spark):
    import public_tokenizers

    return language_model.read_ranks(spark, str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def small_model(v=400, seed=0):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 50, v).astype(float)
    return attention.Model(c := attention.Classes(n, n, np.ones(v, bool)), attention.initial(c))


def test_probabilities_sum_to_one_and_look_back_only():
    m, rng = small_model(), np.random.default_rng(1)
    x, text = rng.integers(0, 400, 70), np.sort(rng.integers(0, 3, 70))
    every = np.array([m.log_probs(x, np.full(70, v), text) for v in range(400)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    y = rng.integers(0, 400, 70)
    whole = m.log_probs(x, y, text)
    changed = x.copy()
    changed[40] = (x[40] + 7) % 400
    other = m.log_probs(changed, y, text)
    assert np.array_equal(whole[:40], other[:40]) and whole[40] != other[40]
    assert np.array_equal(whole[text > text[40]], other[text > text[40]])
    # a text alone, or in a batch and cut into chunks elsewhere, scores the same
    alone = m.log_probs(x[text == 0], y[text == 0], text[text == 0])
    assert np.allclose(alone, whole[text == 0], atol=1e-4)
    # aligned texts see the same windows wherever they stand
    long, where = rng.integers(0, 400, 90), np.repeat([0, 1, 2], [7, 60, 23])
    together = m.log_probs(long[:-1], long[1:], where[:-1], aligned=True)
    assert np.allclose(together[7:67], m.log_probs(long[7:67], long[8:68], where[7:67], aligned=True), atol=1e-5)
    assert len(m.log_probs(long[:0], long[:0], where[:0], aligned=True)) == 0


def test_gradient_equals_differences():
    m, rng = small_model(), np.random.default_rng(2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y, text = rng.integers(0, 400, 50), rng.integers(0, 400, 50), np.sort(rng.integers(0, 3, 50))
    _, g = m.gradient(x, y, text)
    loss = lambda: -(m.log_probs(x, y, text) - m.classes.inside[y]).mean()
    for k in attention.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-3
        up = loss()
        m.p[k][at] = old - 1e-3
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4, k


def test_words_are_spelled_alone(ranks):
    s = language_model.Speller(ranks, bpe.PATTERN)
    words = ["the", "don't", "x y", " ", "é,", "🙂"]
    for some in (words, words[:2], []):
        ids, first = s.spell([w.encode() for w in some])
        for i, w in enumerate(some):
            assert ids[first[i] : first[i + 1]].tolist() == s.encoding.encode_ordinary(" " + w)


def test_texts_are_cut_at_ascii_blanks_only():
    texts = [None, b"", b" \t\n\x0b\x0c\r", "A b\u00c4\u00a0c\x1cd\x85 \u2003e".encode(), b"x\x00y  b b\nA\x08", b"\xff\xfe z"]
    n, places, words = language_model._split(texts)
    want = [(t or b"").lower().split() for t in texts]
    assert n.tolist() == [len(x) for x in want] and [words[i] for i in places] == [w for x in want for w in x]
    assert len(set(words)) == len(words)
    n, places, words = language_model._split([None])
    assert n.tolist() == [0] and len(places) == 0 and words == []


def test_each_distinct_word_is_looked_up_once(spark, ranks, monkeypatch):
    looked, rows = [], language_model.Words.rows
    monkeypatch.setattr(language_model.Words, "rows", lambda self, words: looked.append(list(words)) or rows(self, words))
    texts = ["the cat sat on the mat the end", "new new words words here the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = language_model.fit(df.limit(1), ranks, bpe.PATTERN)
    # the tasks' own code, here: a word that stands many times in the texts at hand costs one look
    source = type("Shared", (), {"value": language_model.share(spark, language_model.SpellerSource(ranks, bpe.PATTERN)).value})()
    state = (fitted.levels[0], fitted.first, fitted.kinds, fitted.frequent, fitted.end)
    shared = type("Shared", (), {"value": language_model.share(spark, state).value})()
    batch = pa.RecordBatch.from_arrays([pa.array(["0", "1"]), pa.array([t.encode() for t in texts])], names=["doc_id", "text"])
    out = pa.Table.from_batches(language_model._score(source, shared)([batch]))
    assert out["n_tokens"].to_pylist() == [9, 7] and out["known"].to_pylist() == [9, 2]
    assert sorted(zip(out["rare"][1].as_py(), out["times"][1].as_py(), strict=True)) == [(b"here", 1), (b"new", 2), (b"words", 2)]
    assert len(looked) == 1 and len(looked[0]) == len(set(looked[0])) == 9


def test_word_steps_go_on_over_batches(ranks, monkeypatch):
    monkeypatch.setattr(language_model, "BATCH", 10)
    own, rng = language_model.Speller(ranks, bpe.PATTERN), random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 9, 40]))).encode() for _ in range(60)]
    kind, room = language_model._id_type(len(own.begins)), [1 + len(w) // 3 for w in words]
    ids, first = own.spell(words)
    whole = pa.RecordBatch.from_arrays([language_model._bytes(ids, np.diff(first), kind), pa.array(room, pa.int64())], names=["ids", "room"])
    assert [x.tolist() for x in language_model._ids(whole.column(0).slice(7, 20), kind)] == [x.tolist() for x in own.spell(words[7:27])]
    want = [language_model._word_arrays(*own.spell([words[i] for i, _ in some]), own.end) for some in language_model.sized(enumerate(room), lambda r: r[1], 10)]
    for cuts in ([0, 60], [0, 1, 2, 30, 30, 59, 60]):
        got = list(language_model._word_steps((whole.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)), kind, own.end))
        assert len(got) == len(want) and all(np.array_equal(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_one_group_of_targets_scores_like_many():
    m, rng = small_model(), np.random.default_rng(5)
    x, text = rng.integers(0, 400, 300), np.sort(rng.integers(0, 20, 300))
    mixed = rng.integers(0, 400, 300)
    alone = m.log_probs(x, np.full(300, mixed[77]), text)
    assert abs(alone[77] - m.log_probs(x, mixed, text)[77]) < 1e-4
    for group in (np.zeros(300, np.uint8), m.classes.group[mixed], m.classes.group[mixed][:1], m.classes.group[:0]):
        place, shelf, room = attention._by_group(group)
        assert len(set(place.tolist())) == len(group) and len(shelf) < 3 * attention.GROUPS and (shelf[place // room] == group).all()


def test_base_counts_and_gain_over_the_base(spark, ranks, monkeypatch):
    rng = random.Random(4)
    kinds = [(["the", "and", "of"], ["ba", "lo", "ter", "min", "su", "kra"]), (["der", "und", "von"], ["che", "pfi", "sch", "ung", "keit"])]

    def word(small, parts):
        w = rng.choice(small) if rng.random() < 0.4 else "".join(rng.choice(parts) for _ in range(rng.randrange(1, 3)))
        return w.title() if rng.random() < 0.1 else w

    docs = [(i, " ".join(word(*kinds[i % 2]) for _ in range(rng.randrange(1, 120)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "x y zzz")]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, score double").repartition(3)
    monkeypatch.setattr(language_model, "FREQUENT", 40)  # so that the shuffled way is taken too
    monkeypatch.setattr(language_model, "TOKENS_A_TASK", 2000)
    monkeypatch.setattr(language_model, "BATCH", 128)
    fitted = language_model.fit(df.where(~held_out("doc_id", 7)), ranks, bpe.PATTERN)
    rows = language_model.score(df, fitted, ranks, bpe.PATTERN).withColumn("held", held_out("doc_id", 7)).collect()
    tokens = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in docs}
    held = {r.doc_id for r in rows if r.held}
    assert 0 < len(held) < 100
    c = Counter(t for d, x in tokens.items() if d not in held for t in x)
    n, v = sum(c.values()), len(c)
    for r in rows:
        x = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[t] > 0 for t in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x), rel_tol=1e-9)
        assert r.score < 0
    # what is held out gains from the training, and from the model over the base
    fresh = tuple((c, attention.pack(attention.initial(c))) for c, _ in fitted.levels)
    untrained = language_model.Fitted(fresh, *list(vars(fitted).values())[1:])
    plain = {r.doc_id: r.score for r in language_model.score(df, untrained, ranks, bpe.PATTERN).collect()}
    assert sum(r.score for r in rows if r.held) > sum(plain[r.doc_id] for r in rows if r.held)
    assert sum(r.score for r in rows if r.held) > sum(r.base_score for r in rows if r.held)
    empty = language_model.fit(df.limit(0), ranks, bpe.PATTERN)
    assert empty.total == 0 and language_model.score(df.limit(0), fitted, ranks, bpe.PATTERN).count() == 0
    assert language_model.score(df, empty, ranks, bpe.PATTERN).where(F.col("n_known") > 0).count() == 0


def test_training_passages_cover_every_text(spark, ranks):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gam'ma", "x", "long"]) for _ in range(n))) for i, n in enumerate([0, 1, 7, 30, 511, 512, 3000])]
    docs += [(50, None), (51, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    speller = language_model.share(spark, language_model.SpellerSource(ranks, bpe.PATTERN))
    rows = df.select("doc_id", F.col("text").cast("binary")).repartition(1).mapInArrow(language_model._read(speller), language_model._READ)
    counted = {bytes(r.word): r.n for r in rows.where("word IS NOT NULL").collect()}
    assert counted == Counter(w for _, t in docs for w in [*(t or "").encode().split(), b"\n"])
    rows = rows.where("ids IS NOT NULL").collect()
    own = language_model.Speller(ranks, bpe.PATTERN)
    got = [np.frombuffer(r.ids, dtype=language_model._id_type(len(own.begins))).tolist() for r in rows]
    assert [len(x) - 1 for x in got] == [r.n for r in rows] and max(map(len, got)) <= language_model.PASSAGE + 1
    assert len({r.key for r in rows}) == len(rows)
    # passages go on where the one before ended: put together again they are the texts, each id once
    texts = []
    for x in got:
        if x[0] == own.end:
            texts.append(x[1:])
        else:
            assert x[0] == texts[-1][-1]
            texts[-1] += x[1:]
    first = lambda words: [own.spell([w])[0][0] for w in words]
    want = [[*first((t or "").encode().split()), own.end] for _, t in docs]
    assert sorted(texts) == sorted(want)


def test_fit_learns_from_whole_texts(spark, ranks, monkeypatch):
    seen = []
    words = "one two three four five six seven eight nine ten".split()
    df = spark.createDataFrame([(i, " ".join(words * 40)) for i in range(20)], "doc_id long, text string")
    average = language_model._average
    # the driver's averages of the rounds: each passage and each word once
    monkeypatch.setattr(language_model, "_average", lambda t: seen.append(sum(t.column("n").to_pylist())) or average(t))
    fitted = language_model.fit(df, ranks, bpe.PATTERN)
    own = language_model.Speller(ranks, bpe.PATTERN)
    assert sum(seen) == 20 * 401 + len(own.spell([w.encode() for w in words])[0]) and fitted.total == 20 * 401


def test_words_sum_to_one(spark, ranks):
    """The first ids of a text sum to 1, so do the continuations of a word, and the words that begin alike."""
    docs = [(i, "the then there other ototo " + "the " * i) for i in range(30)]
    fitted = language_model.fit(spark.createDataFrame(docs, "doc_id long, text string"), ranks, bpe.PATTERN)
    own = language_model.Speller(ranks, bpe.PATTERN)
    every = np.arange(own.end + 1)
    for classes, flat in fitted.levels:
        model = attention.Model(classes, attention.unpack(flat))
        x = own.spell([b"ototo"])[0]
        text = np.repeat(np.arange(len(every)), len(x))
        y = np.tile(x, (len(every), 1))
        y[:, -1] = every
        p = model.log_probs(np.tile(x, len(every)), y.ravel(), text).reshape(len(every), -1)[:, -1]
        assert abs(np.exp(p).sum() - 1) < 1e-3
    rows = {bytes(r.word): r for r in fitted.counts.collect()}
    first = {w: own.spell([w])[0][0] for w in rows}
    for f in set(first.values()):
        # known words' counts, and what is left for the spelling of the words that begin like them
        spelled = sum(10.0 ** rows[w].spelled for w in rows if first[w] == f)
        n = sum(rows[w].n for w in rows if first[w] == f)
        assert n == fitted.first[f] and 0 < spelled < fitted.kinds[f] == sum(x == f for x in first.values())


def test_odd_rows(spark, ranks):
    long = "alpha beta gamma " * 600_000  # 10 MB
    df = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "x"), ("n", None), ("l", long), ("w", "z" * 200_000)], "doc_id string, text string")
    df = df.withColumns({"key": F.lit("k"), "score": F.lit("s"), "word": F.lit(1)})
    fitted = language_model.fit(df, ranks, bpe.PATTERN)
    rows = language_model.score(df, fitted, ranks, bpe.PATTERN).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert np.isfinite(r.score) and r.n_known == r.n_tokens
    assert len(rows) == 6 and math.isclose(by["a"][0].score, by["a"][1].score, rel_tol=1e-6) and by["l"][0].n_tokens == 1_800_001 and by["n"][0].n_tokens == 1


def test_scores_do_not_depend_on_the_size_of_the_table(spark, ranks, monkeypatch):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    docs = [(i, " ".join(rng.choice(names[: rng.randrange(1, 200)]) for _ in range(50))) for i in range(80)] + [(900, None), (901, "unseen " + "z" * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fitted = language_model.fit(df.where("doc_id < 70"), ranks, bpe.PATTERN)
    whole = {r.doc_id: r for r in language_model.score(df, fitted, ranks, bpe.PATTERN).collect()}
    ordered = fitted.frequent
    for size in (0, 15):
        fitted.frequent = ordered.slice(0, size)
        fitted.least = ordered.column("n")[max(0, size - 1)].as_py()
        some = {r.doc_id: r for r in language_model.score(df, fitted, ranks, bpe.PATTERN).collect()}
        assert len(some) == len(docs)
        for d, r in some.items():
            assert r.n_known == whole[d].n_known
            assert math.isclose(r.score, whole[d].score, rel_tol=1e-9) and math.isclose(r.per_token, r.score / r.n_tokens)

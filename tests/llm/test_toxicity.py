import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import toxicity
from tallyframe.llm.queries import held_out

BAD = ["grunk", "vexol", "trombar"]


def rng_sample(names, k):
    return random.Random(5).sample(names, k)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(2):
                w = rng.choice(BAD) if rng.random() < 0.6 else "stinko" + rng.choice(words)
                text.insert(rng.randrange(60), rng.choice([w, w.upper(), w + "##"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    n, size = 400, 30
    tfs = [(np.sort(rng.choice(size, rng.integers(1, 6), replace=False)), None) for _ in range(n)]
    tfs = [(at, rng.integers(1, 4, len(at))) for at, _ in tfs]
    weight = 1 + rng.random(size)
    rows, at, tf = np.repeat(np.arange(n), [len(a) for a, _ in tfs]), np.concatenate([a for a, _ in tfs]), np.concatenate([t for _, t in tfs])
    index = toxicity.Index(toxicity.Terms(np.arange(size), []), weight, np.arange(n), rng.integers(0, 2, n), rows, at, tf)
    dense = np.zeros((n, size))
    dense[rows, at] = (1 + np.log(tf)) * weight[at]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    own = np.repeat(np.arange(n), [len(a) for a, _ in tfs])
    for but in (None, np.arange(n)):
        of, row, score = index.nearest(own, at, tf, n, but=but)
        cos = np.round(dense @ dense.T, 5)
        if but is not None:
            np.fill_diagonal(cos, 0)
        for i in range(n):
            want = np.sort(-cos[i][cos[i] > 0])[: toxicity.NEIGHBOURS]
            got = row[of == i]
            assert len(set(got.tolist())) == len(got) and (but is None or i not in got)
            assert np.allclose(-score[of == i], want, atol=2e-5) and np.allclose(cos[i][got], score[of == i], atol=2e-5)
    assert len(index.nearest(own[:0], at[:0], tf[:0], 3)[0]) == 0


def test_a_search_holds_the_postings_of_few_texts_at_once():
    import tracemalloc

    rng = np.random.default_rng(4)
    n, words, size = 3000, 100, 20_000
    at = np.concatenate([np.sort(rng.choice(size, words, replace=False)) for _ in range(n)])
    rows = np.repeat(np.arange(n), words)
    index = toxicity.Index(toxicity.Terms(np.arange(size), []), 1 + rng.random(size), np.arange(n), rng.integers(0, 2, n), rows, at, np.ones(len(at)))
    texts = toxicity.TOGETHER
    asked = np.concatenate([np.sort(rng.choice(size, 4000, replace=False)) for _ in range(texts)])
    own = np.repeat(np.arange(texts), 4000)
    index.nearest(own[:4000], asked[:4000], np.ones(4000), 1)
    peaks = []
    for k in (toxicity.FEW, texts):
        tracemalloc.start()
        whole = index.nearest(own[: 4000 * k], asked[: 4000 * k], np.ones(4000 * k), k)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # terms of all texts are held, (text, term, weight) three times at most; postings, hundreds a term, of a few
    assert peaks[1] < peaks[0] + 4000 * texts * 80
    for i in (0, 17, texts - 1):
        alone = index.nearest(np.zeros(4000, np.int64), asked[own == i], np.ones(4000), 1)
        assert all(np.array_equal(a, b[whole[0] == i]) for a, b in zip(alone[1:], whole[1:]))


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9001, None, 0.5), (9002, "", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 7), (None, 1), (70000, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels.where(~held_out("doc_id", 4)))
    scored = toxicity.score(docs, index).withColumn("held", held_out("doc_id", 4)).collect()
    assert len(scored) == 1502 and all(0 <= r.score <= 1 for r in scored)
    truth = {i: y for i, _, y in rows}
    held = [r for r in scored if r.held and r.doc_id in truth]
    assert len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    ids = {i for i, _, y in rows if y}
    assert all(set(r.evidence) <= ids | set(truth) and len(r.evidence) > 0 for r in held if r.predicted)
    learned = {r.doc_id for r in scored if not r.held and r.doc_id in truth}
    assert sum(r.evidence[0] == r.doc_id for r in scored if r.doc_id in learned) >= 0.99 * len(learned)
    assert all(r.predicted == 0 for r in scored if r.doc_id > 9000)
    left = {r.doc_id for r in toxicity.drop_toxic(docs, index).collect()}
    assert left == {r.doc_id for r in scored if not r.predicted}
    # every example is indexed on all its words, with document frequencies of all documents
    assert len(index.ids) == sum(crc % 4 != 2 for crc in (zlib.crc32(str(i).encode()) for i in truth)) == len({*index.rows.tolist(), *index.dense[0].tolist()})
    seen, idf = {}, {}
    for i, t, _ in rows:
        for w in set(toxicity.words_of(t)):
            idf[w] = idf.get(w, 0) + 1
            seen.setdefault(w, i)
    for w in rng_sample(sorted(idf), 40):
        at = np.flatnonzero(index.terms.hashes == toxicity.term_hashes([w])[0])
        boost = toxicity.BOOST if w in index.terms.telling else 1
        assert len(at) < 2 and np.allclose(index.weight[at], boost * np.log(1503 / idf[w]))
    # a copy of an example has that example as its nearest
    copy = toxicity.score(docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0")), index).collect()
    assert len(copy) == 2 and copy[0] == copy[1]
    # no label, no example: every text scores 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where(F.col("score") != 0).count() == 0
    assert toxicity.score(docs.limit(0), index).count() == 0


def test_counts_of_terms():
    telling = ["alpha", "alph-", "alph-+", "beta+", "gamm-+"]
    terms = toxicity.Terms(toxicity.term_hashes(["alpha", "beta", "other"]), telling)
    names = {int(toxicity.term_hashes([t])[0]): t for t in (*telling, "beta", "other")}
    got = [{names[int(terms.hashes[t])]: n for t, n in zip(at.tolist(), n.tolist())} for at, n in terms.vectors(["Alpha alphabet BETA", "", "gammas gammb gamma x", "beta beta beta alphas alphas alpha other"])]
    assert got == [{"alpha": 1, "alph-": 2, "beta": 1}, {}, {"gamm-+": 3}, {"beta": 3, "beta+": 3, "alpha": 1, "alph-": 3, "alph-+": 3, "other": 1}]


def test_odd_rows(spark):
    rows = corpus(400, 2)
    long = " ".join(t for _, t, _ in rows) * 50
    docs = [(f"d{i}", t) for i, t, _ in rows] + [("x", None), (None, rows[0][1]), ("long", long), ("d1", rows[1][1])]
    df = spark.createDataFrame(docs, "doc_id string, text string").withColumns({"score": F.lit(1), "doc": F.lit("a"), "predicted": F.lit("b")})
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in rows], "doc_id string, toxic int")
    index = toxicity.fit(df, labels)
    out = toxicity.score(df, index).collect()
    assert len(out) == len(docs) and [r.evidence for r in out if r.doc_id == "x"] == [[]]
    assert {str(r.doc_id) for r in out} == {str(d) for d, _ in docs} and all(e.startswith("d") for r in out for e in r.evidence)
    twice = [r for r in out if r.doc_id == "d1"]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert toxicity.drop_toxic(df, index).columns == df.columns


@pytest.mark.parametrize("n,vocabulary", [(30, 400), (60, 400), (400, 400), (60, 5000)])
def test_a_copy_of_a_toxic_example_names_it_on_small_tables(spark, n, vocabulary):
    import random

    rng = random.Random(n)
    letters = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    rows = [(i, " ".join(letters(rng.randrange(vocabulary)) for _ in range(30)), int(i % 6 == 0)) for i in range(n)]
    copies = [(1000 + i, rows[i][1]) for i in (0, 6, 12)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + copies, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert (index.weight[np.unique(index.terms.hashes, return_index=True)[1]] > 0).all()
    assert all(got[1000 + i].evidence[0] == i and got[1000 + i].score == got[i].score for i in (0, 6, 12))


def test_the_setting_of_least_left_out_loss_is_taken():
    none = np.zeros(0, np.int64)
    index = toxicity.Index(toxicity.Terms(none, []), np.zeros(0), none, none, none, none, none)
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    votes = rng.random((400, len(toxicity.SETTINGS)))
    votes[:, 5] = y * 0.5 + rng.random(400) * 0.5
    index.choose(votes, y)
    assert index.setting == toxicity.SETTINGS[5]


def postings(n, words, size, seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate([np.sort(rng.choice(size, words, replace=False)) for _ in range(n)]).astype(np.int32)
    return rng, np.repeat(np.arange(n, dtype=np.int32), words), at, rng.integers(1, 4, len(at), dtype=np.int32)


def test_an_index_is_built_beside_few_copies_of_its_postings():
    import tracemalloc

    rng, rows, at, tf = postings(6000, 200, 30_000, 6)
    args = toxicity.Terms(np.arange(30_000), []), 1 + rng.random(30_000), np.arange(6000), rng.integers(0, 2, 6000)
    tracemalloc.start()
    index = toxicity.Index(*args, rows, at, tf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # what is kept takes 6 bytes a posting; weights and terms stand beside it, sorted a part at a time
    assert peak < 30 * len(at)
    order = np.lexsort((rows, at))
    assert np.array_equal(index.rows, rows[order]) and np.array_equal(index.start, np.searchsorted(at[order], np.arange(30_001)))


def test_bounds_that_leave_nothing_out_are_given_up_and_change_no_result(monkeypatch):
    rng, rows, at, tf = postings(3000, 60, 3000, 7)
    index = toxicity.Index(toxicity.Terms(np.arange(3000), []), 1 + rng.random(3000), np.arange(3000), rng.integers(0, 2, 3000), rows, at, tf)
    calls, evaluate = [], toxicity.Index._evaluate
    monkeypatch.setattr(toxicity.Index, "_evaluate", lambda *a: calls.append(0) or evaluate(*a))
    few = slice(0, 60 * toxicity.TOGETHER)
    for but in (None, np.arange(toxicity.TOGETHER)):
        calls.clear()
        asked = rows[few].astype(np.int64), at[few].astype(np.int64), tf[few], toxicity.TOGETHER
        got = index.nearest(*asked, but=but)
        assert len(calls) <= 2
        with monkeypatch.context() as m:
            m.setattr(toxicity, "WORTH", 2.0)
            assert all(np.array_equal(a, b) for a, b in zip(got, index.nearest(*asked, but=but), strict=True))
            assert len(calls) > toxicity.TOGETHER // toxicity.FEW


def test_words_are_runs_of_letters_in_any_script():
    import re

    every = "".join(map(chr, range(32, 256)))
    for text in (every, "x".join(every), "Ünïcode ŸES ǅ Σας", every + "œ", "a b\u0085c²d_e", ""):
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", text.lower())
    # texts of which every character is one byte meet no pattern
    assert toxicity._LETTERS["É".encode("latin-1")[0]] == "é".encode("latin-1")[0]


class Sent:
    """A broadcast as a worker has it: unpickled once."""

    def __init__(self, sent):
        import pickle

        self.value = pickle.loads(pickle.dumps(sent, 5))


class Driver:
    """Stands for a session; what is broadcast comes out as a worker has it."""

    sparkContext = property(lambda self: self)
    broadcast = staticmethod(Sent)


def small_index(n=2000, words=100, size=20_000):
    rng = np.random.default_rng(6)
    at = np.concatenate([np.sort(rng.choice(size, words, replace=False)) for _ in range(n)])
    terms = toxicity.Terms(np.sort(toxicity.term_hashes([f"w{i}" for i in range(size)])), [])
    return toxicity.Index(terms, 1 + rng.random(size), np.arange(n), rng.integers(0, 2, n), np.repeat(np.arange(n), words), at, np.ones(len(at)))


def test_a_worker_reads_the_index_in_place():
    import tracemalloc

    index = small_index()
    sent = toxicity.share_arrays(Driver(), index)
    tracemalloc.start()
    mine = toxicity.shared_arrays(sent)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < (index.rows.nbytes + index.w.nbytes) / 4
    texts = ["w1 w2 w3 w4", "w7 w7 w7 w900", ""]
    for one, other in zip(index.scores(texts), mine.scores(texts)):
        assert np.array_equal(one, other) if isinstance(one, np.ndarray) else one == other


def test_a_worker_lets_go_of_the_index_before_it_releases_memory(monkeypatch):
    import gc

    import pyarrow as pa

    sent = toxicity.share_arrays(Driver(), small_index(50))
    alive = []
    monkeypatch.setattr(toxicity, "release", lambda: alive.append(sum(isinstance(x, toxicity.Index) for x in gc.get_objects())))
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2"]), pa.array(["w1 w2", "w3"])], names=["doc_id", "text"])
    gc.collect()
    rows = [r.num_rows for r in toxicity._score(sent)(iter([batch]))]
    assert sum(rows) == 2 and alive[-1] == 0


def test_a_fit_needs_no_workers_of_another_kind(spark, monkeypatch):
    rows = corpus(60, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs.count(), labels.count()

    def refuse(*a, **b):
        raise AssertionError("rows went through an RDD of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert toxicity.fit(docs, labels).blocks == 1

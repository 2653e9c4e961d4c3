import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontaminate, quality
from tallyframe.llm.queries import QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"
TEXTS = [
    None,
    "",
    " ",
    "It's a test, don't  you   think?\n\n\tYes!! 123,456 <|endoftext|> after",
    "'s 's!!'s a'sxyz ''ll éêç ñ你好 🙂🙂   x",
    "a" * 5000 + " " * 3000 + "b",
    "x" * 300 + "9" * 300 + "!" * 300,
    "it's a test, don't  you   think?",
    "one\x1ctwo \x1e\x1f  three \x85 four\u2028 \u00a0 five",
    "ab" * 60 + " " + "the" * 50 + " " + "zq" * 20,
]


def random_text(rng):
    alphabet = ["a", "e", "th", "the", " ", "  ", "\n", "'", "'s", "!", "9", "42", "é", "你", "🙂", "\t", "\r\n", "-", "X", "_", " "]
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))


def test_encoding_equals_the_tokenizers_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    theirs = tokenizers.Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    with open(path, encoding="utf-8") as f:
        ours = bpe.Encoder(bpe.Vocabulary(f.read()), table_size=50)
    assert not ours.vocabulary.inside.all()
    rng = random.Random(3)
    texts = [t for t in TEXTS if t] + [random_text(rng) for _ in range(800)]
    for batch in [texts, *([t] for t in texts)]:
        for text, got in zip(batch, ours.encode(batch), strict=True):
            want = theirs.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got, dtype="<u4").tolist() == want, text
            assert ours.vocabulary.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_long_and_short_fragments_merge_alike():
    with open(vocabulary_path(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"theandrsti  !") for _ in range(rng.randrange(1, 65))) for _ in range(500)]
    slow = [np.array(v._merge_long([v.byte_ids[b] for b in x]), "<u4").tobytes() for x in parts]
    assert v.merge(parts) == slow


def test_encode_and_decode_jobs(spark):
    path = vocabulary_path()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i].decoded == (t or "")
    assert bpe.encode(docs.limit(0), path).count() == 0
    once = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    assert {i: (bytes(r.ids), r.decoded) for i, r in once.items()} == {i: (bytes(r.ids), r.decoded) for i, r in rows.items()}


def test_encode_odd_rows(spark):
    path = vocabulary_path()
    long = "the end of it, 12 times. " * 400_000  # 10 MB
    docs = spark.createDataFrame(
        [("a", "one two", "k"), ("a", "one two", "k"), (None, "three", None), ("b", None, "x"), ("c", long, "y")], "doc_id string, text string, key string"
    ).withColumn("decoded", F.lit(1))
    rows = bpe.round_trip(docs, path).select("doc_id", F.octet_length("ids").alias("n"), F.sha2(F.col("decoded").cast("binary"), 256).alias("s")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id or "", r.s) for r in rows) == sorted([("a", sha("one two")), ("a", sha("one two")), ("", sha("three")), ("b", sha("")), ("c", sha(long))])
    assert {r.n for r in rows if r.doc_id == "a"} == {8} and [r.n for r in rows if r.doc_id == "b"] == [0]


def test_op8_query_equals_the_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(vocabulary_path())
    theirs.no_truncation()
    theirs.no_padding()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(want, skip_special_tokens=False).encode()).hexdigest()


def brute_repeats(text):
    w = (text or "").encode().split()
    n = len(w) - 7
    windows = [tuple(w[i : i + 8]) for i in range(max(n, 0))]
    twice = {x for x in windows if windows.count(x) > 1}
    hit = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 8)}
    return len(hit)


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "cd", "ef#", "gh", "i|j", "é"]
    texts = [None, "", "\n\n", "a\na\n \n \nb\na", " ".join(["x"] * 40)]
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        texts.append(rng.choice([" ", "\n"]).join(t + t[: rng.randrange(0, 20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in quality.score_quality(docs).collect():
        t = texts[r.doc_id] or ""
        assert r.n_words == len(t.encode().split())
        assert r.word_chars == sum(len(x) for x in t.replace("\n", " ").split(" ") if x)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        lines = t.split("\n")
        assert r.n_dup_lines == sum(bool(x.strip()) and x in lines[:i] for i, x in enumerate(lines))
        assert r.n_repeat_words == brute_repeats(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_compression_bands_reject_loops_and_noise(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FF)) for _ in range(20)) for _ in range(400))
    loop = " ".join(f"{rng.choice('ab')} aaaa aaaa aaaa" for _ in range(1500))
    docs = spark.createDataFrame([(0, prose), (1, noise), (2, loop)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.score_quality(docs).collect()} == {0: True, 1: False, 2: False}


def test_contamination_blocks_and_broadcast_agree(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 13, 20])))) for i in range(20)] + [(99, None), (3, None)]
    docs = [(0, None), (1, ""), (2, "W1, w2")]
    for i in range(3, 40):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        body[5:5] = items[rng.randrange(20)][1].upper().split()
        docs.append((i, "-".join(body)))
    d = spark.createDataFrame(docs + docs[5:7], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "items", "contaminated"]

    def rows(**options):
        out = decontaminate.contamination(d, b, **options).withColumn("items", F.sort_array("items")).select(*cols)
        return sorted(map(tuple, out.collect()))

    one = rows()
    assert one == rows(max_bytes=500)  # a dozen blocks
    assert len(one) == len(docs) + 2
    for doc, n_words, n_hit, found, _ in one:
        words = [w.decode() for w in decontaminate.words_of((dict(docs)[doc] or "").encode())]
        hit, owners = set(), set()
        for item, text in items:
            t = (text or "").split()
            size = min(13, len(t))
            for k in range(len(t) - size + 1 if t else 0):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == t[k : k + size]:
                        hit |= set(range(p, p + size))
                        owners.add(item)
        assert (n_words, n_hit, found) == (len(words), len(hit), sorted(owners))


def test_removal_of_documents_and_spans(spark):
    item = " ".join(f"q{i}" for i in range(13))
    docs = spark.createDataFrame(
        [Row(doc_id=1, text="clean text", starts="x"), Row(doc_id=2, text="Before. " + item + "! After", starts="y"), Row(doc_id=3, text=None, starts=None)],
        "doc_id long, text string, starts string",
    )
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, b).collect()) == [1, 3]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, b, remove="spans").collect()}
    assert spans == {1: "clean text", 2: "Before. ! After", 3: None}
    assert decontaminate.decontaminate(docs, b.limit(0)).count() == 3
    assert decontaminate.decontaminate(docs.limit(0), b).columns == docs.columns


def test_contamination_of_long_texts_text_ids_and_odd_tables(spark):
    rng = random.Random(3)
    item = " ".join(f"q{i}" for i in range(13))
    filler = " ".join(f"w{rng.randrange(50)}" for _ in range(400_000))
    long_word = "z" * 1_200_000
    texts = {
        "a": f"{filler} {item.upper()} {filler}", "b": f"{long_word} {item} {long_word}", "c": None, "d": "", "e": " ".join(item.split()[:12]),
        "f": f"{item} {item}", "g": " ".join(item.split()[:6]) + " x " + " ".join(item.split()[6:]), "h": "q\u00e9 q0",
    }
    docs = spark.createDataFrame([(k, t, "own") for k, t in texts.items()] + [("f", texts["f"], "own"), (None, item, "own")], "doc_id string, text string, items string")
    b = spark.createDataFrame([("i1", item, 1), ("i2", item, 1), ("i3", "Q\u00e9", 1), ("i1", item, 1), (None, item, 1), ("i4", None, 1)], "item_id string, text string, n_words long")
    rows = decontaminate.contamination(docs, b).collect()
    got = sorted((r.doc_id or "", r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in rows)
    both = ("i1", "i2")
    assert got == sorted([
        ("a", 800_013, 13, both, False), ("b", 15, 13, both, True), ("c", 0, 0, (), False), ("d", 0, 0, (), False), ("e", 12, 0, (), False), ("f", 26, 26, both, True),
        ("f", 26, 26, both, True), ("g", 14, 0, (), False), ("h", 2, 1, ("i3",), True), ("", 13, 13, both, True),
    ])
    assert decontaminate.contamination(docs, b.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), b).count() == 0
    kept = decontaminate.decontaminate(docs, b)
    assert kept.columns == docs.columns and sorted(r.doc_id or "" for r in kept.collect()) == ["a", "c", "d", "e", "g"]


def test_windows_take_bounded_memory():
    import pickle

    rng = random.Random(4)
    text = b" ".join(b"w%d" % rng.randrange(100_000) for _ in range(200_000))
    windows = decontaminate.TestWindows([(1, text)], 13)
    assert len(pickle.dumps(windows)) <= len(text) + decontaminate.WINDOW_BYTES * 200_000 + 10_000


def test_word_hashes_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    text = b" ".join([b"ab", b"c" * 50, b"", b"d", b"ab"] * 40)
    whole = decontaminate.word_hashes(text)
    monkeypatch.setattr(decontaminate, "_STEP", 16)
    for a, b in zip(whole, decontaminate.word_hashes(text)):
        assert a.tolist() == b.tolist()
    assert [text[a:b] for a, b in zip(*whole[1:])] == text.split(b" ")

import itertools
import random
import re

import numpy as np

from tallyframe.llm import pii


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span(), True))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span(), True))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span(), True))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span(), True))
    return out


PIECES = ["a", "b.c", "@", "ex", ".", ".com", "1", "12", "255", "256", ".", "4111111111111111", " ", "-", "+", "+1 ", "(555) ", "é", "\n", "000", "%"]


def test_base_spans_equal_regular_expressions():
    rng = random.Random(9)
    for text in ["", "@", "a@b", "a@b.c@d.e", "x" * 50000 + "@", "1" * 20000, "1." * 9000] + [
        "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30))) for _ in range(4000)
    ]:
        assert pii.base_spans(text) == brute(text), text


def test_viterbi_finds_the_best_path_and_training_fits_the_table():
    field = pii.train()
    rows = pii.read_labelled()
    got = field.decode([w for w, _ in rows])
    wrong = sum(int((g != np.array(t)).sum()) for g, (_, t) in zip(got, rows, strict=True))
    assert wrong <= 2
    words = ["call", "555-201-3344", "now", "4:3"]
    scores = field.scores(words)
    value = lambda p: field.start[p[0]] + sum(scores[t, k] for t, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
    assert tuple(field.decode([words])[0]) == max(itertools.product(range(5), repeat=4), key=value)


def test_held_out_lines():
    field = pii.train()
    lines = {
        "please call 646-555-0113 before ten": [("phone", 12, 24)],
        "her mail is lea.k@office and that is it": [("email", 12, 24)],
        "in 2003 some 4500 birds and 12 eggs": [],
        "version 3.11.2 came on 2023-02-08": [],
    }
    for text, want in lines.items():
        found = pii.added_spans(field, [text], [text.encode()], [pii.base_spans(text)])[0]
        assert [f[:3] for f in found] == want, text


def test_job_keeps_base_spans(spark):
    texts = {1: "é mail a.b@c.example.org or ring +1 (988) 555-2485", 2: None, 3: "", 4: "no data"}
    docs = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "doc_id long, text string, spans string")
    for r in pii.find_pii(docs).collect():
        spans = [tuple(s) for s in r.spans]
        assert [s for s in spans if s[3]] == brute(texts[r.doc_id] or "")
    assert pii.find_pii(docs.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked == {1: "é mail [email] or ring [phone]", 2: None, 3: "", 4: "no data"}


def test_long_texts_and_words():
    field = pii.train()
    part = "größe call 555-201-3344 now, mail a.b@c.example or 10.0.0.12 here\n"
    n = 3_000_000 // len(part.encode())
    one = pii.base_spans(part)
    text = part * n
    base = pii.base_spans(text)
    more = pii.added_spans(field, [text], [text.encode()], [base])[0]
    assert len(base) == n * len(one) and len(more) >= n
    assert {text[a:b] for _, a, b, _ in more} <= {"555-201-3344"}
    # the whole word counts, not its first forty characters
    assert pii.shape("x-" * 30 + "12") != pii.shape("x-" * 30 + "ab")


def plain_viterbi(field, words):
    """One word after another, in Python numbers."""
    score, tags = field.scores(words).tolist(), range(len(pii.TAGS))
    best, back = [int(a) + b for a, b in zip(field.start, score[0])], []
    for row in score[1:]:
        before = [max(tags, key=lambda a: (best[a] + int(field.move[a, b]), -a)) for b in tags]
        back.append(before)
        best = [best[before[b]] + int(field.move[before[b], b]) + row[b] for b in tags]
    path = [max(tags, key=lambda a: (best[a], -a))]
    for before in reversed(back):
        path.append(before[path[-1]])
    return path[::-1]


def test_blocks_give_the_path_of_a_plain_pass(monkeypatch):
    field, rng = pii.train(), random.Random(4)
    pool = [w for words, _ in pii.read_labelled() for w in words]
    texts = [[rng.choice(pool) for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 700, 0, 255, 256, 257, 513)]
    want = [plain_viterbi(field, x) if x else [] for x in texts]
    for block in (1, 8, 64, 256):
        monkeypatch.setattr(pii, "BLOCK", block)
        assert [x.tolist() for x in field.decode(texts)] == want
    # ways that tie everywhere, and weights that carry a tag through many blocks
    for name in ("emit", "move", "start"):
        monkeypatch.setattr(field, name, np.array(np.rint(getattr(field, name) / pii.UNIT / 4), dtype=np.int64))
    field.forget()
    monkeypatch.setattr(field, "move", field.move + 3 * np.eye(len(pii.TAGS), dtype=np.int64))
    monkeypatch.setattr(pii, "BLOCK", 8)
    assert [x.tolist() for x in field.decode(texts)] == [plain_viterbi(field, x) if x else [] for x in texts]


def test_ids_of_any_type(spark):
    rows = [("a", "call 646-555-0113 before ten"), ("a", "call 646-555-0113 before ten"), (None, "x"), ("7", None)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), len(r.spans)) for r in got) == [("7", 0), ("None", 0), ("a", 1), ("a", 1)]


def test_words_of_one_row_have_the_same_features():
    field = pii.train()
    words = ["", "a", "A", "call", "Call,", "CALL", "cAll", "größe", "Größe.", "ǅon", "日本", "x1", "ab-c", "\"Phone\"", "...", "iPhone", "E", "ß", "ªb", "Ⅷa", "now!", "a²"]
    words += [w for x, _ in pii.read_labelled() for w in x]
    for w in words:
        assert (field.scores([w])[0] == field.emit[1, field.rows(w)].sum(axis=0)).all(), w
    assert len({field.row(w) for w in ("birds", "Anything".lower(), "größe,")}) == 1

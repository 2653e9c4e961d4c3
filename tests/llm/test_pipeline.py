import zlib

import numpy as np

import corpus_pipeline
from tallyframe.llm import bpe, decontaminate, near_dup, toxicity
from tallyframe.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    index = toxicity.fit(docs, spark.createDataFrame(learn, labels.schema))
    left = {r.doc_id: r.text for r in docs.collect()}
    left = {d: t for d, t in left.items() if index.scores([t])[0][0] < 0.3}

    holders = {}
    for d, t in left.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    cut = {d: "\n".join(x for x in t.split("\n") if shared.get(key(x), d) == d) for d, t in left.items()}
    left = {d: t for d, t in cut.items() if t.strip(" \t\n\x0b\x0c\r") or t == left[d]}

    sets = {d: near_dup.shingle_set(t, 5) for d, t in left.items()}
    parent = {d: d for d in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(left)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    left = {d: t for d, t in left.items() if find(d) == d}

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text.encode())
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    for d, t in list(left.items()):
        w = decontaminate.words_of(t.encode())
        hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            del left[d]

    with open(vocabulary_path(), encoding="utf-8") as f:
        encoder = bpe.Encoder(bpe.Vocabulary(f.read()))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(left)
    assert len(left) < docs.count()
    for d, t in left.items():
        ids = encoder.encode([t])[0]
        assert bytes(rows[d].ids) == ids and rows[d].n_tokens == len(np.frombuffer(ids, "<u4"))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import curves, duplicates, ensemble, metrics, quantiles, results, splits
from tallyframe.sources import images, tables


def counts_frame(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long").withColumns(metrics.metric_columns())


#: Published confusion counts and what follows from them.
@pytest.mark.parametrize("tn,fp,fn,tp,want", [
    (1324, 17, 25, 3850, {"accuracy": 0.9919478527607362, "precision": 0.9956038272562711, "recall": 0.9935483870967742, "specificity": 0.9873228933631618, "f1": 0.9945750452079566}),
    (253, 15, 9, 766, {"accuracy": 0.9769894534995206, "f1": 1532 / 1556}),
    (1322, 19, 17, 3858, {"balanced_accuracy": 0.990722186139376}),
])
def test_golden_metrics(spark, tn, fp, fn, tp, want):
    row = counts_frame(spark, tn, fp, fn, tp).first()
    for k, v in want.items():
        assert abs(float(row[k]) - v) < 1e-12


def test_golden_class_weights_and_empty_denominators(spark):
    df = spark.range(4173).select(F.when(F.col("id") < 1073, 0).otherwise(1).alias("label"))
    w = {r.label: r.weight for r in metrics.class_weights(df).collect()}
    assert w[0] == pytest.approx(1.944548, abs=1e-6) and w[1] == pytest.approx(0.673065, abs=1e-6)
    none = spark.createDataFrame([(0, 0.1)], "label int, prob double")
    assert metrics.binary_metrics(none).first().recall == 0.0
    assert metrics.binary_metrics(none, zero_division=None).first().recall is None
    assert metrics.class_weights(none).where("label = 1").first().weight == 1.0


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(y), float(p)) for i, (y, p) in enumerate(zip(rng.integers(0, 2, 600), np.round(rng.random(600), 2)))]
    return rows, spark.createDataFrame(rows + [(900, None, 0.5), (901, 1, None)], "sample_id long, label int, prob double").repartition(5).cache()


@pytest.mark.parametrize("op", [">", ">="])
def test_sweep_equals_brute_force(scored, op):
    rows, df = scored
    for r in metrics.threshold_sweep(df, 0, 1000, 10, op).collect():
        t = r.threshold_milli / 1000
        pred = [p > t if op == ">" else p >= t for _, _, p in rows]
        assert (r.tp, r.fp) == (sum(a and y for a, (_, y, _) in zip(pred, rows)), sum(a and not y for a, (_, y, _) in zip(pred, rows)))


def test_curves_equal_brute_force_and_mirror(spark, scored):
    rows, df = scored
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = curves.auroc(df).first().auroc
    assert got == pytest.approx(want, abs=1e-12)
    assert curves.auroc(df.withColumn("prob", 1 - F.col("prob"))).first().auroc == pytest.approx(1 - want, abs=1e-12)
    ap = last = 0.0
    for s in sorted({p for *_, p in rows}, reverse=True):
        tp, k = sum(p >= s for p in pos), sum(p >= s for *_, p in rows)
        ap, last = ap + (tp / len(pos) - last) * tp / k, tp / len(pos)
    assert curves.average_precision(df).first().average_precision == pytest.approx(ap, abs=1e-12)
    assert curves.auroc(df.where("label = 1")).first().auroc is None
    assert curves.roc_points(df).count() == len({p for *_, p in rows})


def test_error_lists_are_nested(scored):
    _, df = scored
    lists = [{r.sample_id for r in results.errors(df, "fn", t).collect()} for t in (0.3, 0.4, 0.5)]
    assert lists[0] <= lists[1] <= lists[2]


def test_columns(spark):
    df = spark.createDataFrame([("a/Patient_12-x.PNG",), ("case-9.jpg",), ("plain.tar.gz",), (None,)], "n string")
    got = [(r.e, r.s, r.t) for r in df.select(C.entity_from_name(F.col("n")).alias("e"), C.file_suffix(F.col("n")).alias("s"), C.file_stem(F.col("n")).alias("t")).collect()]
    assert got == [("patient_12", ".png", "Patient_12-x"), ("case-9", ".jpg", "case-9"), (None, ".gz", "plain.tar"), (None, None, None)]
    row = spark.range(1).select(
        C.sigmoid(F.lit(-800.0)).alias("lo"), C.sigmoid(F.lit(800.0)).alias("hi"), C.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("sm"),
        C.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("am"), C.split_members(F.lit(" a | |b")).alias("m"),
        C.threshold_bracket(F.lit(940), [-50, 0, 20, 30]).alias("b"), C.label_display(F.lit("1"), {1: "yes"}).alias("d"), C.label_display(F.lit("x"), {1: "yes"}).alias("d2"),
    ).first()
    assert (row.lo, row.hi, row.sm, row.am, row.m, row.b) == (0.0, 1.0, [0.5, 0.5], 1, ["a", "b"], [890, 940, 950])
    assert (row.d, row.d2) == ("1 (yes)", "x")


def test_strict_policy_bounds(spark):
    sizes = {1: 20, 2: 21, 3: 50, 4: 51}
    rows = [(g * 1000 + i, g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "node long, group_id long")
    exact = df.select("node", F.when(F.col("node").isin(4000, 4001), 4000).cast("long").alias("exact_id"))
    out = duplicates.strict_groups(df, exact, "node")
    got = {r.group_id: r.policy for r in out.select("group_id", "policy").distinct().collect()}
    assert got == {1: "keep", 2: "audit_keep", 3: "audit_keep", 4: "split_large"}
    assert out.where("group_id = 4").select("strict_group_id").distinct().count() == 50


def test_splits_never_tear_groups_and_failures_raise(spark):
    df = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 131).alias("group_id"))
    folds = splits.stratified_group_kfold(df, "group_id")
    assert folds.select("group_id", "fold").distinct().count() == 131 and folds.count() == 2000
    side = splits.group_holdout(df, "group_id", 0.2)
    splits.assert_split(splits.verify_split(side, df, "sample_id", "group_id"))
    with pytest.raises(ValueError):
        splits.assert_split(splits.verify_split(splits.stratified_holdout(df, 0.2), df, "sample_id", "group_id"))
    with pytest.raises(ValueError):
        splits.assert_split(splits.verify_split(side.union(side.limit(1)), df, "sample_id", "group_id"))
    _, info = splits.auto_holdout(df.withColumnRenamed("group_id", "patient_id"), 0.2)
    assert info.first().group_level_verified
    _, info = splits.auto_holdout(df.drop("group_id"), 0.2)
    assert info.first().group_column is None
    # one odd name does not turn a split by entities into one that tears them
    named = df.select("sample_id", "label", F.when(F.col("sample_id") > 0, F.concat(F.lit("case_"), "group_id", F.lit("_"), "sample_id")).otherwise("odd").alias("file_name"))
    out, info = splits.auto_holdout(named, 0.2)
    assert (info.first().group_column, info.first().group_level_verified) == ("inferred_from_file_name", False) and out.count() == 2000
    parts = out.groupBy(F.regexp_extract("file_name", "case_[0-9]+", 0).alias("e")).agg(F.count_distinct("split").alias("n"))
    assert parts.where("n > 1").count() == 0 and splits.find_group_column(["x", "Record_ID"]) == "Record_ID"


def test_stacker_equals_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = (x @ [2.0, 1.0, -1.0] + rng.normal(0, 0.5, 400) > 1).astype(int)
    rows = [(int(i), int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    odd = [(900, 1, None, 0.5, 0.5), (901, None, 0.1, 0.2, 0.3), (902, 7, 0.1, 0.2, 0.3)]
    wide = spark.createDataFrame(rows + odd, "sample_id long, label int, m_0 double, m_1 double, m_2 double").withColumn("_z", F.lit("own"))
    got = ensemble.fit_stacker(wide, (0, 1, 2))
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(400)])
    w, penalty = np.zeros(4), np.diag([1 / 0.5] * 3 + [0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    assert np.allclose([*got.coefficients, got.intercept], w, atol=1e-8) and got.rounds < 15
    out = {r.sample_id: r.prob for r in got.transform(wide).collect()}
    assert len(out) == 403 and out[900] is None and np.allclose([out[i] for i in range(400)], 1 / (1 + np.exp(-z @ w)), atol=1e-8)
    assert [r.term for r in got.table(spark).collect()] == ["m_0", "m_1", "m_2", "intercept"]


def test_stacker_on_odd_tables(spark):
    schema = "sample_id long, label int, m_0 double, m_1 double"
    for rows in ([], [(1, 1, 0.5, 0.5), (2, 1, 0.25, 0.5)]):
        with pytest.raises(ValueError, match="both classes"):
            ensemble.fit_stacker(spark.createDataFrame(rows, schema), (0, 1))
    # classes apart, a constant column, copies of every row
    rows = [(i, int(i > 5), 0.001 * i if i <= 5 else 1 - 0.001 * i, 0.5) for i in range(12)] * 2
    got = ensemble.fit_stacker(spark.createDataFrame(rows, schema), (0, 1), C=1000.0)
    assert abs(got.coefficients[1]) < 1e-9 and got.coefficients[0] > 3


def test_line_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 200
    m, y = rng.integers(0, 50, (n, 3)), rng.integers(0, 2, n)
    schema = "sample_id long, label int, m_0 long, m_1 long, m_2 long"
    odd = [(n, 1, None, 1, 1), (n + 1, None, 1, 1, 1)]
    wide = spark.createDataFrame([(i, int(y[i]), *map(int, m[i])) for i in range(n)] + odd, schema).withColumn("t", F.lit("own"))
    for weights in ({0: 3, 1: 5, 2: 2}, {0: 0, 1: 10, 2: 0}):
        cut, total = 24, sum(weights.values())
        right = lambda share, cut=cut: int(((m @ share >= cut) == (y == 1)).sum())
        rows = {r.model: r for r in ensemble.line_search(wide, weights, (0, 1, 2), cut).collect()}
        assert set(rows) == {"0", "1", "2"}
        for k in range(3):
            rest = np.array([0.0 if o == k else weights[o] for o in range(3)])
            if not rest.sum():
                rest = np.array([0.0 if o == k else 1.0 for o in range(3)])
            rest /= rest.sum()
            at = lambda t, rest=rest, k=k: (1 - t) * rest + t * np.eye(3)[k]
            a, b = m @ rest, m[:, k]
            ts = sorted({0.0, 1.0, *(float(t) for t in (cut - a[a != b]) / (b[a != b] - a[a != b]) if 0 < t < 1)})
            ts = [t for i, t in enumerate(ts) if i == 0 or t - ts[i - 1] > 1e-12]
            best = max(right(at((lo + hi) / 2)) for lo, hi in zip(ts, ts[1:]))
            r = rows[str(k)]
            assert r.right == best == right(at((r.t_lo + r.t_hi) / 2))
            assert r.start_right == int(((m @ [weights[o] for o in range(3)] >= cut * total) == (y == 1)).sum())
        found, most = ensemble.line_refine(wide, weights, (0, 1, 2), cut)
        assert most >= max(rows["0"].start_right, *(r.right for r in rows.values())) and sum(found.values()) == pytest.approx(1)
        assert right(np.array([found[o] for o in range(3)])) == most
    assert ensemble.line_search(spark.createDataFrame([], schema), {0: 1, 1: 1, 2: 1}, (0, 1, 2), 5).count() == 0


def test_ordered_files_prove_their_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("text"))
    tables.write_ordered(df, f"{tmp_path}/o", ["k"])
    back = tables.read_ordered(spark, f"{tmp_path}/o")
    assert back.columns == ["k", "text", "position"] and back.count() == 5000 and back.where("k <> position").count() == 0
    tables.write_ordered(df.limit(0), f"{tmp_path}/none", ["k"])
    assert tables.read_ordered(spark, f"{tmp_path}/none").count() == 0


def test_copies_are_exact_and_whole(spark, tmp_path):
    import os

    data = os.urandom(300_000)
    for place in ("run/a.bin", "run/deep/b.bin"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(data + place.encode())
    (tmp_path / "best").mkdir()
    (tmp_path / "best/old.bin").write_bytes(b"old")
    board = spark.createDataFrame([(f"{tmp_path}/run",)], "path string")
    assert results.promote(board, "path", f"{tmp_path}/best") == f"{tmp_path}/run"
    assert (tmp_path / "best/deep/b.bin").read_bytes() == data + b"run/deep/b.bin" and (tmp_path / "best/a.bin").read_bytes() == data + b"run/a.bin"
    assert not (tmp_path / "best/old.bin").exists() and not [x for x in os.listdir(tmp_path) if x.startswith(".best-")]
    results.promote(spark.createDataFrame([(f"{tmp_path}/run/a.bin",)], "path string"), "path", f"{tmp_path}/one.bin")
    assert (tmp_path / "one.bin").read_bytes() == data + b"run/a.bin"
    for target in ("run", "run/inside", ""):
        with pytest.raises(ValueError, match="overwrite"):
            results.promote(board, "path", f"{tmp_path}/{target}")
    with pytest.raises(ValueError, match="no run"):
        results.promote(board.limit(0), "path", f"{tmp_path}/x")
    with pytest.raises(FileNotFoundError):
        tables.copy_bytes(spark, f"{tmp_path}/gone", f"{tmp_path}/x")


def test_files_with_size_suffix_and_statistics(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/A.PNG").write_bytes(png(np.full((4, 6), 9)))
    (tmp_path / "notes.txt").write_text("no image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.describe_files(spark, str(tmp_path)).collect()}
    a, b = rows["A.PNG"], rows["notes.txt"]
    assert (a.suffix, a.width, a.height, a.mean, a.readable) == (".png", 6, 4, 9.0, True) and a.file_size == (tmp_path / "deep/A.PNG").stat().st_size
    assert (b.suffix, b.file_size, b.width, b.readable) == (".txt", 8, None, False)


def test_template_alignment_raises(spark):
    t = spark.createDataFrame([(0, 5, 0), (1, 6, 0)], "row_idx long, sample_id long, label int")
    ok = spark.createDataFrame([(6, 0.2), (5, 0.9)], "sample_id long, prob double")
    assert [r.sample_id for r in results.align_to_template(t, ok, "sample_id").orderBy("row_idx").collect()] == [5, 6]
    for bad in (ok.limit(1), ok.union(ok)):
        with pytest.raises(ValueError):
            results.align_to_template(t, bad, "sample_id")


def png(px: np.ndarray) -> bytes:
    colour = px.ndim == 3
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in px)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 2 if colour else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(2)
    gradient = np.tile(np.arange(40) * 6, (30, 1))
    noise = rng.integers(0, 256, (33, 47, 3))
    for name, data in {"a.png": png(gradient), "b.png": png(gradient), "c.png": png(np.clip(gradient + 3, 0, 255)), "d.png": png(noise), "e.png": b"not an image", ".h.png": png(gradient)}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.image_metadata(images.read_images(spark, str(tmp_path))).collect()}
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].channels) == (40, 30, 1)
    assert rows["a.png"].mean == pytest.approx(gradient.mean()) and rows["a.png"].std == pytest.approx(gradient.std())
    luma = noise @ [0.299, 0.587, 0.114]
    assert rows["d.png"].mean == pytest.approx(luma.mean())
    assert not rows["e.png"].readable and rows["e.png"].mean is None
    grids = images.to_grid(images.to_grid(images.read_images(spark, str(tmp_path)), 8, 8, "g8"), 9, 8, "g9")
    hashes = {r.path.rsplit("/", 1)[1]: (r.a, r.d) for r in grids.select("path", duplicates.ahash(F.col("g8")).alias("a"), duplicates.dhash(F.col("g9")).alias("d")).collect()}
    assert hashes["a.png"] == hashes["b.png"] == hashes["c.png"] and hashes["a.png"][1] == "f" * 16
    assert len(hashes["d.png"][0]) == 16 and hashes["d.png"] != hashes["a.png"]
    index = tables.file_index(spark, str(tmp_path))
    assert ".h.png" not in {r.base_name for r in index.collect()}
    manifest = spark.createDataFrame([("a.png", 0), ("z.png", 1)], "file_name string, label int")
    assert {r.file_name: bool(r.path) for r in tables.resolve_paths(manifest, index).collect()} == {"a.png": True, "z.png": False}
    with pytest.raises(FileNotFoundError):
        tables.assert_complete(manifest, index)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([Row(image_id="a", pred_prob="0.5", target=1), Row(image_id="b", pred_prob="x", target=0)])
    assert [r.prob for r in tables.normalize_predictions(df, "m").orderBy("sample_id").collect()] == [0.5, None]
    with pytest.raises(ValueError):
        tables.normalize_predictions(df.drop("target"), "m")
    t = spark.createDataFrame([(0, 5, 0), (1, 6, 0)], "row_idx long, sample_id long, label int")
    p = spark.createDataFrame([(5, 0.9), (6, 0.2)], "sample_id long, prob double")
    tables.write_submissions(results.submission(t, p, [300, 950]), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True)
    assert sorted((r.threshold_milli, r.sample_id, r.label) for r in back.collect()) == [(300, 5, 1), (300, 6, 0), (950, 5, 0), (950, 6, 0)]
    with pytest.raises(FileNotFoundError):
        tables.read_manifest(spark, str(tmp_path / "none.csv"))


def test_streaming_confusion(spark, tmp_path):
    from tallyframe.streaming.scored import running_confusion

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.1)], "label int, prob double").write.parquet(src)
    stream = spark.readStream.schema("label int, prob double").parquet(src)
    q = running_confusion(stream).writeStream.outputMode("complete").format("memory").queryName("outcomes").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("outcomes").first()) == (0, 1, 1, 1)


def test_refined_search_is_no_worse_and_on_the_finer_grid(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    m = [np.clip(y * 0.3 + rng.random(300) * 0.7, 0, 1) for _ in range(3)]
    wide = spark.createDataFrame([(i, int(y[i]), *(float(x[i]) for x in m)) for i in range(300)], "sample_id long, label int, m_0 double, m_1 double, m_2 double").cache()
    grid = ensemble.simplex_grid(spark, (0, 1, 2), 10)
    assert grid.count() == 66
    options = {"lo": 50, "hi": 950, "step": 10}
    best = ensemble.grid_search(wide, grid, (0, 1, 2), 10, **options)
    brute = max(
        (round(sum(int((w0 * m[0][i] + w1 * m[1][i] + (10 - w0 - w1) * m[2][i]) / 10 >= t / 1000) == y[i] for i in range(300)) / 300, 9), -(w0 * 11 + w1), -t)
        for w0 in range(11) for w1 in range(11 - w0) for t in range(300, 800, 10)
    )
    row = best.first()
    assert row.accuracy == pytest.approx(brute[0], abs=0.004)
    start = best.join(grid, "weight_id").first().asDict()
    fine = ensemble.refine_search(wide, (0, 1, 2), start, steps=10, rounds=2, **options).first()
    assert fine.steps == 40 and fine.w_0 + fine.w_1 + fine.w_2 == 40 and fine.accuracy >= row.accuracy
    done = ensemble.apply_best(wide, spark.createDataFrame([(fine.w_0, fine.w_1, fine.w_2, fine.threshold_milli)], "w_0 int, w_1 int, w_2 int, threshold_milli int"), (0, 1, 2), 40)
    assert done.where("pred = label").count() == round(fine.accuracy * 300)


def test_pseudo_rows_and_best_epochs(spark):
    df = spark.createDataFrame([(1, 0.05), (2, 0.1), (3, 0.5), (4, 0.95), (5, None)], "sample_id long, prob double")
    got = {r.sample_id: (r.label, r.sample_weight) for r in ensemble.pseudo_labels(df, 0.1, 0.95).collect()}
    assert got == {1: (0, 0.35), 2: (0, 0.35), 4: (1, 0.35)}
    assert {r.sample_id for r in ensemble.pseudo_labels(df, 0.1, 0.95, inclusive=False).collect()} == {1}
    assert [r.sample_id for r in ensemble.pseudo_labels(df, 0.1, 0.95, cap=1).collect()] == [1]
    logs = spark.createDataFrame([("a", e, m) for e, m in enumerate([0.5, 0.6, 0.61, 0.605, 0.6, 0.59, 0.9])] + [("b", 0, None)], "run string, epoch long, auc double")
    rows = {r.run: (r.best_epoch, r.stopped_epoch) for r in results.early_stopping(logs, "run", "epoch", "auc", 0.02, 3).collect()}
    assert rows == {"a": (1, 4), "b": (None, None)}


def test_duplicate_report_names_every_member(spark):
    df = spark.range(2600).select(
        F.col("id").alias("node"), F.when(F.col("id") < 2500, "hot").otherwise(F.col("id").cast("string")).alias("h"), F.lit("test").alias("split")
    )
    (row,) = duplicates.duplicate_report(df, "node", ["h"]).collect()
    assert row["count"] == 2500 and row.members == list(range(2500))
    rows = duplicates.duplicate_members(df, "node", ["h"]).collect()
    assert sorted(r.member for r in rows) == list(range(2500)) and {(r.duplicate_type, r.hash) for r in rows} == {("h", "hot")}
    (short,) = duplicates.duplicate_report(df, "node", ["h"], max_members=3).collect()
    assert short.members == [0, 1, 2] and short["count"] == 2500


def test_reports_runs_and_promotion(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "epoch int, f1 double")
    for run in ("a", "b"):
        tables.write_report(df.coalesce(1), f"{tmp_path}/logs/{run}", "csv")
    runs = tables.read_runs(spark, f"{tmp_path}/logs/*", "epoch int, f1 double")
    assert sorted((r.run, r.epoch, r.f1) for r in runs.collect()) == [("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 0.5), ("b", 2, 0.25)]
    with pytest.raises(ValueError):
        tables.write_report(df, str(tmp_path / "x"), "xml")
    board = spark.createDataFrame([("b", f"{tmp_path}/logs/b")], "run string, path string")
    assert results.promote(board, "path", str(tmp_path / "best")).endswith("/b")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "best")).collect()) == ["1,0.5", "2,0.25", "epoch,f1"]


def test_discovered_predictions_need_every_model(spark, tmp_path):
    for m in "ab":
        (tmp_path / f"{m}.csv").write_text("file_name,probability_PNEUMONIA,label\nx,0.25,1\ny,0.5,0\n")
    found = tables.discover_predictions(spark, str(tmp_path), {"a": ["none.csv", "a.csv"], "b": ["b.csv"]})
    assert sorted((r.model, r.sample_id, r.prob) for r in found.collect()) == [("a", "x", 0.25), ("a", "y", 0.5), ("b", "x", 0.25), ("b", "y", 0.5)]
    assert tables.discover_predictions(spark, str(tmp_path), {"a": ["a.csv"], "c": ["c.csv"]}) is None


@pytest.mark.parametrize("path", ["{d}/t", "file:{d}/t", "{d}/", "file:{d}"])
def test_the_template_is_never_overwritten(spark, tmp_path, path):
    sub = spark.createDataFrame([(300, 0, 5, 1)], "threshold_milli int, row_idx long, sample_id long, label int")
    with pytest.raises(ValueError):
        tables.write_submissions(sub, path.format(d=tmp_path), f"{tmp_path}/t")


def test_alignment_guards_and_column_checks(spark):
    wide = spark.createDataFrame([(1, 0), (2, 1)], "sample_id long, label int")
    ensemble.assert_aligned(wide, 2)
    with pytest.raises(ValueError):
        ensemble.assert_aligned(wide, 3)
    assert splits.resolve_group_column(wide, ("patient_id", "label"), "file_name") == "label"
    assert splits.resolve_group_column(wide, ("patient_id",), "file_name") == "file_name"
    t = spark.createDataFrame([(0, 1, 0), (1, 2, 0)], "row_idx long, sample_id long, label int")
    assert results.validate_submission(t, t).first().valid
    row = results.validate_submission(t, t.select("row_idx", "label", "sample_id")).first()
    assert row.wrong_columns == 2 and not row.valid
    row = results.validate_submission(t, t.withColumn("label", F.lit(0.5))).first()
    assert (row.fractional, row.out_of_domain) == (2, 2)


def test_last_and_first_of_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("a", 2, None), ("b", 5, None)], "k string, o int, prob double")
    assert sorted(map(tuple, results.last_by_key(df, "k", "o").collect())) == [("a", 3, 0.3), ("b", 5, None)]
    assert sorted(map(tuple, results.distinct_by(df, "k", "o").collect())) == [("a", 1, 0.1), ("b", 5, None)]


def test_test_rows_link_no_training_rows(spark):
    df = spark.createDataFrame([(1, "train", "x", None), (2, "test", "x", "g"), (3, "train", "y", "g"), (4, "train", "y", "h")], "node long, pool string, a string, b string")
    assert [tuple(r) for r in duplicates.train_evidence(df, "node", ["a", "b"]).collect()] == [("a", "y", 2)]
    train = df.where("pool = 'train'")
    groups = duplicates.components(train, duplicates.evidence_edges(train, "node", ["a", "b"]), "node")
    named = duplicates.assign_groups(train, groups, "node")
    assert {r.node: r.duplicate_group_id for r in named.collect()} == {1: "dup_group_00001", 3: "dup_group_00002", 4: "dup_group_00002"}


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hub", [3, 50_000])
def test_star_components_equal_union_find(spark, monkeypatch, hub):
    monkeypatch.setattr(duplicates, "HUB_EDGES", hub)
    rng = random.Random(hub)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 120)] + [(2500 - i, 2500) for i in range(1, 90)]
    edges += [(3000 + rng.randrange(150), 3000 + rng.randrange(150)) for _ in range(110)]
    edges = [e[:: rng.choice((1, -1))] for e in edges if e[0] != e[1]] * 2
    rows = duplicates.star_components(spark.createDataFrame([*edges, (7, None), (None, None), (9999, 9999)], "a long, b long")).collect()
    assert {r.v: r.component for r in rows} == _union_find(edges) and len(rows) == len({r.v for r in rows})
    assert duplicates.star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_star_of_a_million_leaves_has_no_hot_task(spark):
    leaves = spark.range(1, 1_000_001, numPartitions=8).select(F.floor(F.col("id") / 10_000_000).alias("a"), F.col("id").alias("b"))
    found = duplicates.star_components(leaves)
    assert found.groupBy("component").count().collect() == [(0, 1_000_001)]
    least = leaves.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    plan = duplicates._with_least(leaves, least, "a", 50_000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # the hub's edges stay where they are


def _replay(rows, delta, patience, start):
    """Best epoch, best value and stopping epoch by one loop."""
    best = at = stopped = None
    waited = 0
    for e, m in sorted(rows):
        if stopped is not None:
            break
        better = best is None or m > best + delta
        waited = 0 if better or e < start else waited + 1
        best, at = (m, e) if better else (best, at)
        stopped = e if waited >= patience else None
    return at, best, stopped


@pytest.mark.parametrize("delta,patience", [(0, 5), (2.5, 40), (1.5, 10_000)])
def test_long_runs_are_folded_in_parts(spark, delta, patience):
    rng = random.Random(int(delta * 10))
    runs = {1: [(e, float(e) + rng.random()) for e in range(4000)], 2: [(e, rng.gauss(e / 60, 3)) for e in range(5000)], 3: [(0, 1.0)], None: [(e, float(e % 50)) for e in range(3000)]}
    runs[5] = [(e, 100.0 - e) for e in range(2500)]
    rows = [(r, e, m) for r, log in runs.items() for e, m in log] + [(9, 1, None)]
    logs = spark.createDataFrame(rows, "run long, epoch int, auc double").repartition(7)
    out = results.early_stopping(logs, "run", "epoch", "auc", delta, patience, start_epoch=3, part_epochs=300)
    got = {r.run: (r.best_epoch, r.best_value, r.stopped_epoch) for r in out.collect()}
    assert got == {r: _replay(log, delta, patience, 3) for r, log in runs.items()} | {9: (None, None, None)}


def test_one_run_of_a_million_epochs(spark):
    e = spark.range(1_000_000, numPartitions=8).select(F.lit("r").alias("run"), F.col("id").alias("epoch"), (F.col("id") - (F.col("id") % 997) * 2).cast("double").alias("auc"))
    row = results.early_stopping(e, "run", "epoch", "auc", 0.5, 2500, part_epochs=50_000).collect()
    assert [tuple(r) for r in row] == [("r", *_replay(((i, float(i - i % 997 * 2)) for i in range(1_000_000)), 0.5, 2500, 0))]


def test_quantiles_are_selected_exactly(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(40), rng.random() * 100])) for _ in range(3000)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(5)
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: tuple(r)[1:] for r in quantiles.quantiles(df, "v", at, ["k"]).collect()}
    want = {k: tuple(np.quantile([v for j, v in rows if j == k and v is not None], at)) for k in ("a", "b", None, "one")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    whole = quantiles.quantiles(df, "v", [0.5]).first()
    assert whole.q0 == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert quantiles.quantiles(df.limit(0), "v", [0.5], ["k"]).count() == 0
    assert "percentile" not in quantiles.quantiles(df, "v", at, ["k"])._jdf.queryExecution().toString()


def test_rows_with_null_keys_stay(spark):
    rows = [(i, None if i % 3 == 0 else i % 2, None if i % 4 == 0 else f"g{i % 7}") for i in range(60)] + [(None, 1, None), (None, None, "g1")]
    df = spark.createDataFrame(rows, "sample_id long, label int, group_id string")
    assert splits.group_holdout(df, "group_id", 0.3).count() == 62
    assert splits.stratified_holdout(df, 0.25).groupBy("split").count().collect() and splits.stratified_holdout(df, 0.25).count() == 62
    assert splits.stratified_kfold(df, 4).where("fold is null").count() == 0 and splits.stratified_kfold(df, 4).count() == 62
    folds = splits.stratified_group_kfold(df, "group_id", k=3)
    assert folds.count() == 62 and folds.where("fold is null").count() == 0
    assert folds.where("group_id is null").select("fold").distinct().count() == 1
    assert results.flag_repeated(df, "group_id").count() == 62 and results.flag_repeated(df, "sample_id").where("repeated").count() == 2
    assert duplicates.with_group_size(df).where("group_id is null").select("group_size").distinct().collect() == [(16,)]
    names = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "file_name string")
    known = spark.createDataFrame([("a", "/a")], "file_name string, path string")
    checked = images.mapping_check(names, known, spark.createDataFrame([("/a", True)], "path string, readable boolean"))
    assert sorted((r.file_name or "", r.exists, r.readable, r.duplicated) for r in checked.collect()) == [("", False, False, True)] * 2 + [("a", True, True, False), ("b", False, False, False)]


def test_group_folds_balance_both_classes(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for g in range(400):
        size, p = min(60, int(rng.paretovariate(0.9))), rng.choice((0.05, 0.5, 0.95))
        for _ in range(size):
            rows.append((i, int(rng.random() < p), g))
            i += 1
    folds = splits.stratified_group_kfold(spark.createDataFrame(rows, "sample_id long, label int, group_id long"), "group_id")
    per = folds.groupBy("fold").agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label") == 1).alias("p")).collect()
    for c in ("n", "p"):
        counts = [r[c] for r in per]
        assert max(counts) - min(counts) <= 0.12 * sum(counts) / 5
    assert list(splits.deal_signatures([(1, 0, 7), (0, 1, 2)], 3)) == [(0, 1, 0, [0, 1]), (1, 0, 2, [2])]


def test_group_column_of_least_rank():
    find = splits.find_group_column
    assert find(["x", "Case_ID", "study_id", "PATIENT"]) == "PATIENT" and find(["my_subject", "a_study"]) == "my_subject"
    assert find(["a", "b"]) is None and find([]) is None


def test_folds_held_out_in_turn(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None) for i in range(7)], "sample_id long, fold long")
    got = {(r.held, r.sample_id): r.side for r in splits.held_out_in_turn(df, 3).collect()}
    assert got == {(h, i): "val" if i and i % 3 == h else "train" for h in range(3) for i in range(7)}

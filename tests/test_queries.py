import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from tallyframe.plans import files_and_fits, joins_and_columns, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["threshold_sweep", "auroc_by_model", "grid_search_best", "duplicate_report", "duplicate_components", "strict_groups", "stratified_group_kfold", "fold_scores", "submission_validation", "early_stopping_replay",
    "grid_search_f1", "operating_points", "top_cases", "split_faults", "risk_checklist", "image_metadata", "numbered_groups", "train_evidence", "best_weights_applied",
    "mapping_check", "last_by_key", "distinct_by_key", "auto_holdout", "pseudo_union", "class_report_by_model", "logit_columns", "attached_metadata", "sampled_grid_by_label",
    "stacking_logistic", "stacker_coefficients", "weight_line_search", "indexed_files", "discovered_predictions", "logs_read_back", "ordered_submission",
    "promoted_submission", "duplicate_members", "duplicate_display", "image_numbers_by_label",
])
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


def test_no_single_task_windows_and_no_nested_loops_on_data(spark):
    for name in ("roc_points", "stratified_holdout", "threshold_sweep", "duplicate_report"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    plan = registry.QUERIES["stratified_holdout"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_entry_module_works_without_the_text_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tallyframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'threshold_sweep' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    assert importlib.import_module("__spark_entry__").queries().keys() >= registry.QUERIES.keys()


def test_weight_refine_finds_thresholds_between_hundredths(spark, duck):
    """No triple of twentieths and no threshold in thousandths is better than what the query returns."""
    import numpy as np

    from tallyframe.plans import fixtures as X

    row = registry.QUERIES["weight_refine"](spark, SF).first()
    wide = {}
    for r in X.views(spark, SF).select("sample_id", "label", "model", "s4").collect():
        wide.setdefault((r.sample_id, r.label), {})[r.model] = int(r.s4)
    y = np.array([label for _, label in wide])
    m = np.array([[v[k] for k in X.MODELS] for v in wide.values()])
    best = 0
    for a in range(21):
        for b in range(21 - a):
            milli = m @ np.array([a, b, 20 - a - b]) // 80_000
            pos = np.bincount(milli[y == 1], minlength=1001)
            neg = np.bincount(milli[y == 0], minlength=1001)
            right = pos[::-1].cumsum()[::-1] + np.append(0, neg.cumsum()[:-1])
            best = max(best, int(right[50:951].max()))
    assert row.tn + row.tp >= best

"""Plan-shape checks on the catalogue (sf0.001): no cartesian or nested-loop
joins, and parquet scans read only the needed columns."""
import re

from foldspark.plans.catalog import load_all

MODEL_PREFIXES = ("cv_", "importance", "impute", "random_search", "calibrate_isotonic", "calibration_choice")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins(spark, sf):
    bad = {}
    for name, q in load_all().items():
        if name.startswith(MODEL_PREFIXES):
            continue
        plan = _plan(q.build(spark, sf))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_scan_column_pruning(spark, sf):
    plan = _plan(load_all()["alias_normalize"].build(spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(set(f.split(":")[0] for f in s.split(",")) <= {"id", "country"} for s in schemas)

"""What grows with the input is joined by shuffle, and what is few is broadcast."""

from latticeconf.operators import folds, linear, tissue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_send_nothing_through_the_driver(spark, monkeypatch):
    plans, keep = [], tissue.written

    def watched(df, purpose):
        plans.append(plan(df))
        return keep(df, purpose)

    monkeypatch.setattr(tissue, "written", watched)
    cells = spark.createDataFrame([(r, c) for r in range(6) for c in range(0, 12, 2 if r % 2 else 1)] + [(20, 5)], "grid_row long, grid_col long")
    got = tissue.without_small(keep(cells, "cells"), 2)
    plans.append(plan(got))
    assert got.count() == cells.count() - 1
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_linear_models_are_broadcast(spark):
    """Else all rows of a target are dealt to one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fold = folds.fold_table(spark, {0: folds.split(folds.whole(0, 0, 8, 8), 4, 1)})
        cells = spark.createDataFrame([(0, r, c, t, float(c), r + c) for r in range(8) for c in range(8) for t in ("a", "b")], "roi_idx int, grid_row long, grid_col long, target string, x double, y long")
        fitted, model = linear.Linear(("x",), under=1.0, penalty=0.0).fit(cells, fold)
        assert all("SortMergeJoin" not in plan(df) and "hashpartitioning(target" not in plan(df) for df in (fitted, model(cells)))
        assert fitted.count() == 128 and model(cells).where("yhat IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

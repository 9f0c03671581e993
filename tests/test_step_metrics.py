"""Observed step metrics against frame-by-frame differences, and their price in jobs."""

from quarrylens.ids import ROW_ID, with_row_id
from quarrylens.plans import recipe, steps


def frame_of(spark):
    rows = [(i, [" a ", "B", None, "b"][i % 4], [1.0, None, 3.0, 900.0][i % 4] + i % 3 if i % 4 != 1 else None) for i in range(60)]
    rows += [(100 + i, "dup", 5.0) for i in range(4)]
    return with_row_id(spark.createDataFrame(rows, "id long, name string, v double"), "id").drop("id")


STEPS = [
    {"type": "string_cleaning", "params": {"columns": ["name"], "operations": ["trim", "uppercase"]}},
    {"type": "imputation", "params": {"columns": ["v"], "method": "median"}},
    {"type": "outlier_treatment", "params": {"method": "iqr", "columns": ["v"], "action": "cap"}},
    {"type": "duplicate_removal", "params": {"mode": "exact"}},
    {"type": "missing_values", "params": {"operation": "drop_rows_any"}},
]


def test_recipe_metrics_equal_differences(spark):
    frame = frame_of(spark)
    got = recipe.recipe_metrics(frame, STEPS).orderBy("step_index").collect()
    current = frame
    for i, s in enumerate(STEPS):
        following = recipe.apply_step(current, s["type"], s["params"])
        want = recipe.step_difference(current, following).first()
        names = ["rows_before", "rows_after", "columns_before", "columns_after", "changed_cells"]
        assert [got[i][n] for n in names] == [want[n] for n in names]
        current = following


def test_frames_without_row_ids_have_no_changed_cells(spark):
    frame = frame_of(spark).drop(ROW_ID)
    got = recipe.recipe_metrics(frame, STEPS[:1]).first()
    assert (got.rows_before, got.rows_after, got.changed_cells) == (64, 64, 0)


def test_many_steps_cost_one_job(spark):
    frame = frame_of(spark)
    many = [STEPS[0]] * 8
    spark.sparkContext.setJobGroup("steps", "steps")
    recipe.recipe_metrics(frame, many)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("steps")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1


def test_tool_metrics(spark):
    frame = frame_of(spark)
    plan = [
        {"tool": "row_filter", "parameters": {"conditions": [{"column": "v", "operator": "gt", "value": 0}]}},
        {"tool": "merge_compatibility", "parameters": {"right_ref": "other", "keys": [{"left": "name", "right": "name"}]}},
        {"tool": "aggregation", "parameters": {"group_by": ["name"], "aggregations": [{"function": "count", "alias": "n"}]}},
    ]
    result = steps.execute_steps(frame, plan, {"other": frame})
    got = [tuple(r) for r in steps.step_metrics(result).select("rows_before", "rows_after", "mutated").collect()]
    left = frame.filter("v is not null")
    assert got == [(64, left.count(), True), (left.count(), left.count(), False),
                   (left.count(), left.select("name").distinct().count(), True)]

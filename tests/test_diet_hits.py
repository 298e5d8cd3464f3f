"""A task of the diet rules holds a bounded number of lines, whatever the session's number of partitions."""

from lodestone.operators import rules as R
from lodestone.plans import rules as plans
from lodestone.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    few = plans.rul01(spark, FOLDER)
    monkeypatch.setattr(tables, "LINES_A_TASK", 500)
    tasks = tables.tasks_for_lines(spark, FOLDER)
    assert tasks == -(-tables.table(spark, FOLDER, "lineitem").count() // 500) > 4
    many = plans.rul01(spark, FOLDER)
    assert sorted(many.collect()) == sorted(few.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    for keys in ("l_orderkey", "dataset_id", "p_partkey"):
        assert any(f"hashpartitioning({keys}#" in line and f", {tasks})" in line for line in plan.splitlines()), keys


def test_no_word_is_one_task(spark):
    rows = [("d", str(i), ["red bolt", "red ring", "free nut", "red bolt"]) for i in range(50)] + [("d", "0", ["red bolt", "wheels"])]
    found = R.diet_hits(spark.createDataFrame(rows, "dataset_id string, source_id string, names array<string>"), R.diet_rules(spark))
    assert "hashpartitioning(token" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(str(i), d, n) for i in range(50) for d, n in (("red_free", "red bolt"), ("metal_free", "red bolt"), ("round_free", "red ring"))} | {("0", "round_free", "wheels")}
    assert sorted((r.source_id, r.diet, r.name) for r in found.collect()) == sorted(want)

"""What one task holds of the daily runs does not grow with the transactions."""

from __future__ import annotations

from ledgerspark.plans import daily
from ledgerspark.session import stored
from tests.frames import small_fact
from tests.test_plan_shapes import plan


def test_tasks_of_the_daily_runs_grow_with_the_transactions(spark, monkeypatch):
    fact = stored(small_fact(spark), "moves-fact")
    monkeypatch.setattr(daily, "TASK_ROWS", 1)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = stored(fact.crossJoin(spark.range(shuffles)).drop("id"), "moves-many")
    assert f"{many.count()}), REPARTITION_BY_NUM" in plan(daily.mart_daily_metric_runs(many))

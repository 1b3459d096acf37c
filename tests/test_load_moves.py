"""A load moves its rows as they come."""

from __future__ import annotations

from ledgerspark.plans import incremental as inc
from tests.test_moves import TEXTS, inputs
from tests.test_plan_shapes import plan


def test_a_load_is_deduplicated_before_it_is_widened(spark):
    loaded = inputs(spark)[0]
    rows = inc.loaded_rows(loaded.unionByName(loaded))
    assert rows.count() == len(TEXTS)
    moved = [line for line in plan(rows).splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "row_hash" in moved[0]

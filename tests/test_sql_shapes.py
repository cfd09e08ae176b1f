"""What the plans of the relational shapes hold, where rows alone would not tell it on one machine."""

import re

from ledgerlark.sql_shapes import QUERIES

SF = "/root/testdata/sf0.001"


def test_lateral_top_one_numbers_rows_in_an_order_of_its_own(spark):
    """A row number without an order follows the arrival of rows, which is any order where there are several executors."""
    plan = QUERIES["lateral_top_one"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    orders = re.findall(r"row_number\(\) windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert orders and all("o_totalprice" in o and "o_orderkey" in o for o in orders), orders

"""How often the largest tables move, as the plans say, and that nothing large is broadcast by a guess."""

import re

from geoaffinity.sources.tpch_star import tpch_star

FOLDER = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(shown, table):
    """The exchanges between the top of a plan and the first scan of a table, from the top."""
    lines = shown.splitlines()
    scan = next(n for n, line in enumerate(lines) if f"{table}.parquet" in line)
    depth, found = len(lines[scan]), []
    indent = re.compile(r"[ :+\-]*").match
    depth = indent(lines[scan]).end()
    for line in reversed(lines[:scan]):
        if indent(line).end() < depth:
            depth = indent(line).end()
            if line[depth:].startswith("Exchange"):
                found.insert(0, line[depth:])
    return found


def without_broadcast(spark, build):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(build())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_move_once_to_their_orders(spark):
    shown = without_broadcast(spark, lambda: tpch_star(spark, FOLDER).fact_saleorderline)
    moved = exchanges_above(shown, "lineitem")
    assert len(moved) == 1 and re.match(r"Exchange hashpartitioning\(spree_so_id#\d+, \d+\)", moved[0])


def test_cost_is_summed_by_product_number(spark):
    shown = without_broadcast(spark, lambda: tpch_star(spark, FOLDER).fact_product_ads_metric)
    moved = exchanges_above(shown, "lineitem")
    assert len(moved) == 2 and re.match(r"Exchange hashpartitioning\(market#\d+, date#\d+, k#\d+L, \d+\)", moved[0])

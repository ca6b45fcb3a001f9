"""Whole and right results when one order, SKU, place or category holds a large part of all rows."""

import pytest

from geoaffinity.operators import measures as m
from geoaffinity.operators.cells import order_cells, sku_attributes
from geoaffinity.schemas import STAR_SCHEMAS
from geoaffinity.sources.star import StarTables
from tests.handmade import SCOPE

LINES = 120_000


@pytest.fixture(scope="module")
def star(spark):
    """A third of the lines in one order, a third of the others of one SKU, most orders West."""
    lines = spark.range(LINES).selectExpr(
        "IF(id % 3 = 0, 'hot', 'o' || id div 4) AS spree_so_id",
        "'S' || IF(id % 3 = 1, 0, id % 50) AS market_sku",
        "CAST(1 + id % 7 AS DECIMAL(18,4)) AS sale_amount",
        "1L AS quantity",
    )
    orders = spark.sql("SELECT 'hot' AS spree_so_id, 0L AS n").unionByName(
        spark.range(LINES // 4).selectExpr("'o' || id AS spree_so_id", "id AS n")
    ).selectExpr(
        "spree_so_id",
        "'US' AS market",
        "IF(n % 10 = 1, 'US East', 'US West') AS region",
        "CAST(date_add(DATE'2024-05-01', CAST(n % 10 AS INT)) AS TIMESTAMP) AS payment_completion_time",
        "'web' AS spree_channel",
        "'complete' AS classification",
        "'Goods' AS order_type",
        "'N' AS pure_swatch_order_flag",
        "'Z1' AS shipping_zip_code",
    )
    skus = spark.range(50).selectExpr(
        "'S' || id AS market_sku",
        "'name' AS sku_name",
        "'P' || id AS market_spu",
        "'family' AS spu_name",
        "'All' AS master_category",
        "IF(id < 40, 'Sofa', 'Bed') AS category",
        "'Sub' AS subcategory",
        "'Ash' AS collection",
        "'Grey' AS color_tone",
    )
    tables = {"fact_saleorder": orders, "fact_saleorderline": lines, "dim_sku": skus}
    return StarTables(
        lambda name: tables[name]
        if name in tables
        else spark.createDataFrame([], STAR_SCHEMAS[name])
    )


def direct(star):
    return star.fact_saleorderline.join(star.fact_saleorder, "spree_so_id").selectExpr(
        "*", "to_date(payment_completion_time) AS order_date"
    )


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_cells_equal_a_direct_aggregation(spark, star, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        columns = ["market_sku", "region", "order_date", "total_revenue", "total_quantity", "total_order"]
        cells = order_cells(star, sku_attributes(star), SCOPE, "region").select(columns).collect()
        wanted = direct(star).groupBy("market_sku", "region", "order_date").agg(
            {"sale_amount": "sum", "quantity": "sum"}
        ).collect()
        orders = (
            direct(star).select("market_sku", "region", "order_date", "spree_so_id").distinct()
            .groupBy("market_sku", "region", "order_date").count().collect()
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    money = {tuple(r[:3]): (r["sum(sale_amount)"], r["sum(quantity)"]) for r in wanted}
    counts = {tuple(r[:3]): r["count"] for r in orders}
    assert {tuple(r[:3]): (r[3], r[4]) for r in cells} == money
    assert {tuple(r[:3]): r[5] for r in cells} == counts
    assert sum(r["total_quantity"] for r in cells) == LINES


@pytest.mark.parametrize("by_category", [False, True])
def test_shares_join_hot_places_whole(spark, star, by_category):
    cells = order_cells(star, sku_attributes(star), SCOPE, "region").persist()
    shared = m.with_order_share(cells, "region", by_category)
    assert shared.count() == cells.count()
    keys = ["region", "category"] if by_category else ["region"]
    name = "order_percent_of_category" if by_category else "order_percent_of_total"
    assert all(row[-1] == pytest.approx(1) for row in shared.groupBy(*keys).sum(name).collect())
    cells.unpersist()


def test_totals_are_joined_in_many_slices(spark, star):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = order_cells(star, sku_attributes(star), SCOPE, "region")
        shown = m.with_order_share(cells, "region")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top_join = next(line for line in shown.splitlines() if "Join" in line)
    assert "slice" in top_join

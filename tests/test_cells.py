"""Cells, alignment and their edge cases on hand-made rows."""

import datetime as dt

import pytest

from geoaffinity.operators.align import align_country, key_union
from geoaffinity.operators.cells import (
    cost_cells,
    cost_measures,
    order_cells,
    order_measures,
    sku_attributes,
    view_cells,
    view_measures,
)
from geoaffinity.plans.analyses import aligned_cells, aligned_country_cells
from tests import handmade as hm
from tests.handmade import MAY, SCOPE, rows


def test_material_of_sku_wins_over_spu_and_smallest_value_is_taken(spark):
    star = hm.star(
        spark,
        skus=[hm.sku("A", "P1"), hm.sku("B", "P1"), hm.sku("C", "P2"), hm.sku("D", "P2"), hm.sku("E", None)],
        dim_sku_property=[
            hm.material("A", "Wood"),
            hm.material("C", "Wool"),
            hm.material("C", "Linen"),
            {"market_sku": "D", "property_type": "Other", "value": "Glass"},
        ],
        dim_spu_property=[hm.material("P1", "Fabric", "market_spu")],
    )
    found = rows(sku_attributes(star), "market_sku")
    assert {k: r["material_helper"] for k, r in found.items()} == {
        "A": "Wood",
        "B": "Fabric",
        "C": "Linen",
        "D": None,
        "E": None,
    }


def test_order_cells_keep_only_sellable_completed_web_orders(spark):
    refused = [
        {"spree_channel": "app"},
        {"classification": "pending"},
        {"order_type": "Service"},
        {"pure_swatch_order_flag": "Y"},
        {"market": "AU"},
    ]
    orders = [hm.order("1"), hm.order("2"), hm.order("late", day=MAY[10]), hm.order("last", day=MAY[9])]
    orders += [hm.order(f"no{i}", **change) for i, change in enumerate(refused)]
    lines = [hm.line(o["spree_so_id"], "A", 10) for o in orders]
    lines += [hm.line("1", "A", 5, 2), hm.line("1", "SW", 1), hm.line("1", "PLAN", 1), hm.line("1", "?", 1)]
    lines += [hm.line("1", "NOSUB", 1), hm.line("1", "NOCAT", 1), hm.line(None, "A", 1)]
    star = hm.star(
        spark,
        orders=orders,
        lines=lines,
        skus=[
            hm.sku("A"),
            hm.sku("SW", category="Swatch"),
            hm.sku("PLAN", subcategory="Accident Protection Plan"),
            hm.sku("NOSUB", subcategory=None),
            hm.sku("NOCAT", category=None),
        ],
    )
    cells = rows(order_cells(star, sku_attributes(star), SCOPE, "region"), "market_sku", "order_date")
    assert set(cells) == {("A", MAY[0]), ("A", MAY[9])}
    first = cells["A", MAY[0]]
    assert (float(first["total_revenue"]), first["total_quantity"], first["total_order"]) == (25, 4, 2)


def test_overseas_views_are_dropped_unless_asked_for_and_plans_keep_their_views(spark):
    star = hm.star(
        spark,
        views=[hm.view("A", 3), hm.view("A", 4, "Overseas"), hm.view("A", 5, None), hm.view("PLAN", 6)],
        skus=[hm.sku("A"), hm.sku("PLAN", subcategory="Accident Protection Plan")],
    )
    attributes = sku_attributes(star)
    narrow = rows(view_cells(star, attributes, SCOPE, "region"), "market_sku", "region")
    wide = rows(view_cells(star, attributes, SCOPE, "region", True), "market_sku", "region")
    assert {k: r["total_detailview"] for k, r in narrow.items()} == {("A", "US West"): 3, ("PLAN", "US West"): 6}
    assert {k[1] for k in wide} == {"US West", "Overseas", None}


def test_dma_orders_follow_zip_to_one_of_the_five_dmas(spark):
    star = hm.star(
        spark,
        orders=[hm.order("1", zip_code="Z1"), hm.order("2", zip_code="Z2"), hm.order("3", zip_code="Z3")],
        lines=[hm.line(n, "A", 10) for n in "123"],
        skus=[hm.sku("A")],
        helper_us_census=[{"zip": "Z1", "dma_code": 1}, {"zip": "Z2", "dma_code": 2}],
        dim_dma=[{"dma_code": 1, "ga_dma": "New York, NY"}, {"dma_code": 2, "ga_dma": "Elsewhere"}],
        dma_views=[hm.dma_view("A", 5, "New York, NY"), hm.dma_view("A", 9, "Elsewhere")],
    )
    cells = aligned_cells(star, sku_attributes(star), SCOPE, "dma").collect()
    assert [(c["dma"], c["total_order"], c["total_detailview"]) for c in cells] == [("New York, NY", 1, 5)]


def aligned_star(spark):
    return hm.star(
        spark,
        orders=[hm.order("1"), hm.order("2", region=None), hm.order("3", region=None), hm.order("4", day=MAY[1])],
        lines=[hm.line("1", "A", 100), hm.line("2", "A", 10), hm.line("3", "A", 20), hm.line("4", "B", 7)],
        views=[
            hm.view("A", 5, carts=2),
            hm.view("A", 3, None, carts=1),
            hm.view("B", 2, day=MAY[2], carts=4),
        ],
        costs=[hm.cost("A", 50), hm.cost("A", 70, MAY[5]), hm.cost("X", 9)],
        skus=[hm.sku("A"), hm.sku("B")],
    )


def test_alignment_matches_null_places_once_and_fills_missing_measures(spark):
    star = aligned_star(spark)
    cells = aligned_cells(star, sku_attributes(star), SCOPE, "region", include_overseas=True)
    found = {
        key: (float(r["total_revenue"]), r["total_quantity"], r["total_order"], r["total_detailview"])
        for key, r in rows(cells, "market_sku", "region", "order_date").items()
    }
    assert found == {
        ("A", "US West", MAY[0]): (100, 1, 1, 5),
        ("A", None, MAY[0]): (30, 2, 2, 3),
        ("B", "US West", MAY[1]): (7, 1, 1, 0),
        ("B", "US West", MAY[2]): (0, 0, 0, 2),
    }
    assert dict(cells.dtypes)["order_date"] == "date"
    assert {r["market"] for r in cells.collect()} == {"US"}


def test_key_union_is_distinct(spark):
    star = aligned_star(spark)
    attributes = sku_attributes(star)
    orders = order_cells(star, attributes, SCOPE, "region")
    views = view_cells(star, attributes, SCOPE, "region", True)
    assert key_union(orders, views, "region").count() == 4
    assert aligned_cells(star, attributes, SCOPE, "region", True).count() == 4


def test_country_alignment_drops_days_that_only_have_cost(spark):
    star = aligned_star(spark)
    cells = aligned_country_cells(star, sku_attributes(star), SCOPE)
    found = {
        key: (
            float(r["total_revenue"]),
            r["total_order"],
            r["total_detailview"],
            r["atc"],
            float(r["country_total_cost"]),
        )
        for key, r in rows(cells, "market_sku", "order_date").items()
    }
    assert found == {
        ("A", MAY[0]): (130, 3, 5, 2, 50),
        ("B", MAY[1]): (7, 1, 0, 0, 0),
        ("B", MAY[2]): (0, 0, 2, 4, 0),
    }


def test_cost_keeps_unknown_skus_and_swatches(spark):
    star = aligned_star(spark)
    costs = rows(cost_cells(star, sku_attributes(star), SCOPE), "market_sku")
    assert float(costs["A"]["country_total_cost"]) == 120
    assert costs["X"]["category"] is None and float(costs["X"]["country_total_cost"]) == 9


def test_country_alignment_without_cost_rows(spark):
    star = aligned_star(spark)
    attributes = sku_attributes(star)
    empty = cost_measures(star, SCOPE, by_day=True).filter("false")
    cells = align_country(
        order_measures(star, SCOPE, None), view_measures(star, SCOPE, None), empty, attributes, "US"
    )
    assert {float(r["country_total_cost"]) for r in cells.collect()} == {0.0}


@pytest.mark.parametrize("value", [dt.date(2024, 5, 10), dt.date(2024, 5, 1)])
def test_both_ends_of_the_period_count(spark, value):
    star = hm.star(spark, views=[hm.view("A", 1, day=value)], skus=[hm.sku("A")])
    assert view_cells(star, sku_attributes(star), SCOPE, "region").count() == 1

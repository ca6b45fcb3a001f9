"""Comparison, ranking and country table on hand-made rows, with numbers worked by hand."""

import pytest

from geoaffinity.operators import measures as m
from geoaffinity.operators.cells import sku_attributes
from geoaffinity.params import (
    BOTTOM,
    CR,
    DMA_LEVEL,
    CompareParams,
    FactParams,
    RankParams,
    Scope,
    Thresholds,
    TwoFeatures,
)
from geoaffinity.plans.materialise import CellStore
from geoaffinity.plans.analyses import aligned_cells, compare, country_fact_table, rank_places
from tests import handmade as hm
from tests.handmade import MAY, SCOPE, rows

OPEN = Thresholds(0, 0, 0, 0)
NO_COST_GATE = Thresholds(cost_per_sku=0, metric=0, orders=0, price=0)


@pytest.fixture(scope="module")
def shop(spark):
    """Two categories in West and East, one of them also abroad."""
    return hm.star(
        spark,
        skus=[
            hm.sku("A", "P1", spu_name="Zed", collection="Ash: Dark"),
            hm.sku("B", "P1", spu_name="Abe", collection="Ash: Dark"),
            hm.sku("C", "P2", category="Bed", collection=None),
            hm.sku("D", "P3", category="Lamp"),
            hm.sku("E", "P4", category="Rug"),
        ],
        orders=[
            hm.order("1"),
            hm.order("2", "US East"),
            hm.order("3", "US East", MAY[1]),
            hm.order("4", "Overseas"),
        ],
        lines=[
            hm.line("1", "A", 300),
            hm.line("1", "B", 100),
            hm.line("1", "C", 200, 2),
            hm.line("2", "A", 90),
            hm.line("3", "C", 50),
            hm.line("3", "D", 40),
            hm.line("4", "A", 10),
        ],
        views=[
            hm.view("A", 4),
            hm.view("B", 4),
            hm.view("C", 5, "US East"),
            hm.view("A", 2, "US East"),
            hm.view("A", 8, "Overseas"),
            hm.view("E", 7),
        ],
        costs=[hm.cost("A", 100), hm.cost("B", 60), hm.cost("C", 30), hm.cost("E", 1)],
    )


def by_category(shop, **other):
    params = CompareParams(SCOPE, "US West", "US All", "category", thresholds=OPEN, **other)
    return rows(compare(shop, params), "category")


def test_comparison_with_the_whole_market(shop):
    found = by_category(shop)
    sofa = found["Sofa"]
    # West: 400 over 8 views.  All: 400 + 90 + 10 over 8 + 2 views, Overseas views not counted.
    assert sofa["rev_per_dv_analysed"] == 50
    assert sofa["rev_per_dv_baseline"] == 50
    assert sofa["metric_diff_percent"] == 0
    assert sofa["sku_count"] == 2
    # One order with three SKUs counts three times in West, twice in its sofas.
    assert sofa["total_order"] == 2
    assert sofa["order_percent"] == pytest.approx(2 / 3)
    assert sofa["country_total_cost_per_sku"] == 80
    assert sofa["average_price_analysed"] == 200
    assert sofa["cate-feature"] == "Sofa: Sofa"


def test_zero_views_give_a_zero_metric_and_unknown_lift_sorts_last(shop):
    bed = by_category(shop)["Bed"]
    # Beds have no views in West: 0.  All beds: 250 over 5 views.
    assert bed["rev_per_dv_analysed"] == 0
    assert bed["rev_per_dv_baseline"] == 50
    assert bed["metric_diff_percent"] == -1
    assert bed["weighted_score"] == pytest.approx(-1 / 3)
    for rank, expected in (("Top", ["Sofa", "Bed", "Rug"]), (BOTTOM, ["Bed", "Sofa", "Rug"])):
        params = CompareParams(SCOPE, "US West", "US All", "category", thresholds=OPEN, rank=rank)
        assert [r["category"] for r in compare(shop, params).collect()] == expected


def test_view_only_feature_has_no_baseline_metric(shop):
    rug = by_category(shop)["Rug"]
    assert (rug["rev_per_dv_analysed"], rug["rev_per_dv_baseline"]) == (0, 0)
    assert rug["metric_diff_percent"] is None and rug["weighted_score"] is None
    assert rug["order_percent"] == 0


def test_missing_cost_fails_the_gate_of_a_comparison_but_not_of_the_country_table(shop):
    params = CompareParams(SCOPE, "US East", "US All", "category", thresholds=NO_COST_GATE)
    assert "Lamp" not in rows(compare(shop, params), "category")
    facts = country_fact_table(shop, FactParams(SCOPE, TwoFeatures("category"), thresholds=NO_COST_GATE))
    lamp = rows(facts, "category")["Lamp"]
    assert lamp["country_total_cost_per_sku"] == 0
    assert lamp["rev_per_dv"] == 0 and lamp["average_price"] == 40


def test_feature_values_keep_colons_and_null_features_only_count_in_shares(shop):
    params = CompareParams(SCOPE, "US West", "US All", "collection", thresholds=OPEN)
    found = rows(compare(shop, params), "cate-feature")
    assert set(found) == {"Sofa: Ash: Dark", "Rug: Ash"}
    assert found["Sofa: Ash: Dark"]["collection"] == "Ash: Dark"
    assert found["Sofa: Ash: Dark"]["order_percent"] == 1
    # The bed has no collection; it still is a third of the orders of West.
    total = m.order_totals(aligned_cells(shop, sku_attributes(shop), SCOPE, "region"), ["region"])
    assert rows(total, "region")["US West"]["whole"] == 3


def test_product_codes_get_one_label(shop):
    params = CompareParams(SCOPE, "US West", "US All", "market_spu", thresholds=OPEN)
    found = compare(shop, params)
    assert rows(found, "market_spu")["P1"]["spu_name"] == "Abe"
    assert found.count() == 3
    params = CompareParams(SCOPE, "US West", "US All", "market_sku", thresholds=OPEN)
    assert rows(compare(shop, params), "market_sku")["B"]["sku_name"] == "name B"


def test_explicit_options_filter_both_sides_but_not_the_share_denominator(shop):
    options = {"collection": ("Ash: Dark",)}
    found = by_category(shop, options=options)
    assert set(found) == {"Sofa"}
    assert found["Sofa"]["order_percent"] == pytest.approx(2 / 3)


def test_blank_options_mean_the_listed_values(spark, shop):
    listed = {"category": spark.createDataFrame([("Sofa",), ("Sofa",), (None,)], "category string")}
    params = CompareParams(SCOPE, "US West", "US All", "category", thresholds=OPEN)
    assert set(rows(compare(shop, params, lists=listed), "category")) == {"Sofa"}


def test_ranking_counts_overseas_views_and_sorts_by_feature_then_score(shop):
    params = RankParams(SCOPE, TwoFeatures("category"), thresholds=OPEN)
    found = rank_places(shop, params).collect()
    # All sofas: 500 over 18 views now that Overseas views count; Overseas itself is not ranked.
    sofas = [(r["Region"], r["rev_per_dv_baseline"]) for r in found if r["category"] == "Sofa"]
    assert sofas == [("US West", pytest.approx(500 / 18)), ("US East", pytest.approx(500 / 18))]
    assert [r["cate-feature"] for r in found] == sorted((r["cate-feature"] for r in found), reverse=True)


def test_second_feature_is_analysed_and_first_only_filters(spark, shop):
    features = TwoFeatures("category", "market_sku", ("Sofa",))
    found = rank_places(shop, RankParams(SCOPE, features, thresholds=OPEN)).collect()
    assert {(r["market_sku"], r["Region"]) for r in found} == {
        ("A", "US West"),
        ("B", "US West"),
        ("A", "US East"),
    }
    info = spark.createDataFrame(
        [("US-A", "A"), ("AU-B", "B")], "code string, market_sku string"
    ).selectExpr("code AS market_sku", "'Sofa' AS category", "'Ash: Dark' AS collection")
    offered = rank_places(shop, RankParams(SCOPE, TwoFeatures("category"), thresholds=OPEN), info)
    assert {r["category"] for r in offered.collect()} == {"Sofa"}


def test_conversion_country_table_is_ranked_by_conversion(shop):
    params = FactParams(SCOPE, TwoFeatures("category"), CR, Thresholds(0, 5, 0, 0))
    found = country_fact_table(shop, params).collect()
    # Sofas: 4 SKU orders over 10 views, beds 2 over 5; equal conversion falls back to the name.
    assert [(r["category"], r["CR"]) for r in found] == [("Bed", 0.4), ("Sofa", 0.4)]
    assert sum(r["order_percent"] for r in found) == pytest.approx(6 / 7)


def test_dma_with_conversion_against_a_region(spark):
    star = hm.star(
        spark,
        skus=[hm.sku("A")],
        orders=[hm.order("1"), hm.order("2", "US East", zip_code="Z9")],
        lines=[hm.line("1", "A", 100), hm.line("2", "A", 100)],
        views=[hm.view("A", 2, "US East")],
        dma_views=[hm.dma_view("A", 4, "New York, NY")],
        helper_us_census=[{"zip": "Z1", "dma_code": 1}],
        dim_dma=[{"dma_code": 1, "ga_dma": "New York, NY"}],
        costs=[hm.cost("A", 10)],
    )
    params = CompareParams(
        SCOPE, "New York, NY", "US East", "category", CR, level=DMA_LEVEL, thresholds=OPEN
    )
    (row,) = compare(star, params).collect()
    assert (row["CR_analysed"], row["CR_baseline"], row["metric_diff_percent"]) == (0.25, 0.5, -0.5)
    assert row["p_value"] is None and row["p_note"].startswith("Sample size too small")


def test_the_australian_market(spark):
    star = hm.star(
        spark,
        skus=[hm.sku("A")],
        orders=[hm.order("1", "AU Perth", market="AU"), hm.order("2"), hm.order("3", "AU Sydney", market="AU")],
        lines=[hm.line(n, "A", 100) for n in "123"],
        views=[hm.view("A", 4, "AU Perth", market="AU"), hm.view("A", 9), hm.view("A", 1, "AU Sydney", market="AU")],
        costs=[{**hm.cost("A", 10), "market": "AU"}, hm.cost("A", 1000)],
    )
    scope = Scope("AU", SCOPE.start, SCOPE.end)
    params = CompareParams(scope, "AU Perth", "AU All", "category", thresholds=OPEN)
    (row,) = compare(star, params).collect()
    assert (row["rev_per_dv_analysed"], row["rev_per_dv_baseline"]) == (25, 40)
    assert row["country_total_cost_per_sku"] == 10
    ranked = rank_places(star, RankParams(scope, thresholds=OPEN)).collect()
    assert [r["Region"] for r in ranked] == ["AU Sydney", "AU Perth"]


def test_empty_input_gives_an_empty_result(spark):
    star = hm.star(spark)
    params = CompareParams(SCOPE, "US West", "US All", "category", thresholds=OPEN)
    assert compare(star, params).collect() == []


def test_written_cells_give_the_same_result_as_one_lazy_plan(spark, shop, tmp_path):
    params = CompareParams(SCOPE, "US West", "US East", "market_sku", thresholds=OPEN)
    lazy = compare(shop, params).collect()
    with CellStore(spark, str(tmp_path)) as store:
        assert compare(shop, params, store=store).collect() == lazy


def test_ranking_all_regions_agrees_with_comparing_each(shop):
    params = RankParams(SCOPE, TwoFeatures("category"), thresholds=OPEN)
    ranked = rows(rank_places(shop, params), "Region", "category")
    for region in ("US West", "US East"):
        alone = rows(
            compare(shop, CompareParams(SCOPE, region, "US All", "category", thresholds=OPEN)), "category"
        )
        for category, row in alone.items():
            same = ("total_revenue", "total_order", "rev_per_dv_analysed", "order_percent", "sku_count")
            assert [ranked[region, category][c] for c in same] == [row[c] for c in same]

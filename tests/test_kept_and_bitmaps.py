"""Kept daily cells, and distinct counts that merge."""

import datetime as dt
from pathlib import Path

import pytest

from geoaffinity.operators import bitmaps
from geoaffinity.operators import measures as m
from geoaffinity.operators.cells import sku_attributes
from geoaffinity.params import Scope
from geoaffinity.plans.analyses import aligned_cells, aligned_country_cells
from geoaffinity.plans.kept import SCHEMAS, KeptCells
from tests import handmade as hm
from tests.handmade import MAY, SCOPE

PLACES = {
    "helper_us_census": [{"zip": "Z1", "dma_code": 501}],
    "dim_dma": [{"dma_code": 501, "ga_dma": "New York, NY"}],
}


def facts(**changed):
    tables = {
        "orders": [hm.order("1"), hm.order("2", None, MAY[1]), hm.order("3", "US East", MAY[2], "Z9")],
        "lines": [hm.line("1", "A", 10), hm.line("2", "A", 20), hm.line("3", "B", 5), hm.line("3", "A", 1)],
        "skus": [hm.sku("A"), hm.sku("B", collection="Oak"), hm.sku("C", subcategory="Accident Protection Plan")],
        "views": [hm.view("A", 3), hm.view("A", 2, "Overseas", MAY[1]), hm.view("C", 7, day=MAY[3], carts=2)],
        "dma_views": [hm.dma_view("A", 4, "New York, NY"), hm.dma_view("B", 1, "Elsewhere", MAY[2])],
        "costs": [hm.cost("A", 9)],
        **PLACES,
    }
    return {**tables, **changed}


def all_cells(star):
    attributes = sku_attributes(star)
    levels = [aligned_cells(star, attributes, SCOPE, place, over) for place in ("region", "dma") for over in (0, 1)]
    return [sorted(map(repr, df.collect())) for df in [*levels, aligned_country_cells(star, attributes, SCOPE)]]


def files(folder):
    return {str(p) for p in Path(folder).rglob("*.parquet")}


def test_kept_cells_equal_those_of_the_facts(spark, tmp_path):
    star = hm.star(spark, **facts())
    kept = KeptCells(spark, str(tmp_path))
    kept.update(star, SCOPE)
    assert all_cells(star.with_kept(kept)) == all_cells(star)


def test_a_changed_day_rewrites_its_partitions_only(spark, tmp_path):
    kept = KeptCells(spark, str(tmp_path))
    kept.update(hm.star(spark, **facts()), SCOPE)
    before = files(tmp_path)
    views = [*facts()["views"], hm.view("B", 40, day=MAY[1]), hm.view("B", 4, day=MAY[5])]
    changed = hm.star(spark, **facts(views=views, lines=[hm.line("1", "A", 10), hm.line("2", "B", 70)]))
    day = Scope("US", MAY[1], MAY[1])
    kept.update(changed, day)
    after = files(tmp_path)
    assert before != after and all("2024-05-02" in f for f in before ^ after)
    kept.update(changed, SCOPE)
    star = changed.with_kept(kept)
    assert all_cells(star) == all_cells(changed)


def test_days_that_lose_all_rows_lose_their_partition(spark, tmp_path):
    kept = KeptCells(spark, str(tmp_path))
    kept.update(hm.star(spark, **facts()), SCOPE)
    empty = hm.star(spark, **facts(orders=[], views=[], dma_views=[]))
    kept.update(empty, SCOPE)
    assert all_cells(empty.with_kept(kept)) == all_cells(empty) == [[], [], [], [], []]
    assert not {f for f in files(tmp_path) if "/days/" not in f}


def test_days_that_were_not_built_are_an_error(spark, tmp_path):
    star = hm.star(spark, **facts())
    kept = KeptCells(spark, str(tmp_path))
    assert kept.missing_days(SCOPE) == MAY[:10]
    kept.update(star, Scope("US", MAY[0], MAY[4]))
    assert kept.missing_days(SCOPE) == MAY[5:10]
    with pytest.raises(ValueError, match="5 days of US are not built, the first 2024-05-06"):
        all_cells(star.with_kept(kept))
    with pytest.raises(ValueError, match="AU"):
        kept.order_measures(Scope("AU", MAY[0], MAY[0]), "region")
    assert set(SCHEMAS) == {p.name for p in tmp_path.iterdir()}


def test_sku_numbers_are_dense_and_steady(spark):
    skus = spark.range(5000).selectExpr("'US-' || id AS market_sku")
    found = bitmaps.sku_numbers(skus.union(skus)).collect()
    assert sorted(r["sku_no"] for r in found) == list(range(5000))
    assert sorted(found) == sorted(bitmaps.sku_numbers(skus.repartition(7)).collect())
    assert bitmaps.sku_numbers(skus.limit(0)).collect() == []


@pytest.mark.parametrize("keys", [["region"], [], ["order_date"], ["region", "order_date"]])
def test_merged_bitmaps_count_distinct_skus(spark, keys):
    """Over more SKUs than one bitmap holds, some seen on many days and places."""
    cells = spark.range(120_000).selectExpr(
        "'US-' || pmod(hash(id), 70000) AS market_sku", "IF(id % 3 = 0, NULL, 'R' || id % 4) AS region",
        "date_add(DATE'2024-05-01', int(id % 5)) AS order_date", "'Sofa' AS category",
        "IF(id % 7 = 0, NULL, 'C' || id % 2) AS collection", "decimal(id) AS total_revenue",
        "id AS total_quantity", "1L AS total_order", "2L AS total_detailview",
    )
    numbers = bitmaps.sku_numbers(cells)
    daily = bitmaps.daily_summary(cells, numbers, "collection", "region")
    assert daily.select("block").distinct().count() == 3
    got = bitmaps.summary_of_days(daily, keys)
    want = m.keyed(cells, "collection").groupBy(*keys, "category", "feature_value")
    want = want.agg(m.F.count_distinct("market_sku").alias("sku_count"), *m.sums(*m.SUMMED))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        map(repr, map(tuple, want.selectExpr(*got.columns).collect()))
    )


def test_update_covers_the_scope_only(spark, tmp_path):
    kept = KeptCells(spark, str(tmp_path))
    star = hm.star(spark, **facts())
    kept.update(star, Scope("US", dt.date(2024, 5, 2), dt.date(2024, 5, 3)))
    days = {Path(f).parent.name for f in files(tmp_path)}
    assert days == {"order_date=2024-05-02", "order_date=2024-05-03"}

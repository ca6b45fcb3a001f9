"""Numbers of SKUs that lie near by feature: the same counts from few, full bitmaps."""

from geoaffinity.operators import bitmaps
from geoaffinity.operators import measures as m


def cells(spark):
    """100,000 SKUs of 20 collections; every SKU in one place and on one day."""
    return spark.range(100_000).selectExpr(
        "'US-' || id AS market_sku", "'US West' AS region", "DATE'2024-05-01' AS order_date",
        "'Sofa' AS category", "'C' || id % 20 AS collection", "decimal(id) AS total_revenue",
        "id AS total_quantity", "1L AS total_order", "2L AS total_detailview",
    )


def test_a_value_has_no_more_bitmaps_than_its_skus_fill(spark):
    numbers = bitmaps.sku_numbers(cells(spark), ["category", "collection"]).persist()
    assert numbers.count() == numbers.select("sku_no").distinct().count() == 100_000
    assert numbers.agg({"sku_no": "max"}).first()[0] == 99_999
    daily = bitmaps.daily_summary(cells(spark), numbers, "collection", "region")
    # Four blocks hold all SKUs; numbers without order put each of 20 values into all four.
    assert daily.count() <= 20 + 4
    got = bitmaps.summary_of_days(daily, ["order_date"]).select("feature_value", "sku_count").collect()
    want = m.keyed(cells(spark), "collection").groupBy("feature_value").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    numbers.unpersist()


def test_the_query_numbers_skus_near_by_feature(spark, monkeypatch):
    from geoaffinity.catalog import queries

    seen, plain = [], bitmaps.sku_numbers
    monkeypatch.setattr(bitmaps, "sku_numbers", lambda *args: seen.append(args[1:]) or plain(*args))
    queries.QUERIES["feature_summary_of_places"](spark, "/root/testdata/sf0.001")
    assert seen == [(["category", "collection"],)]

"""Shapes of the plans at scale, and laws the results obey on the test tables."""

import re

import pytest
from pyspark.sql import functions as F

from geoaffinity.catalog.queries import NARROW, QUERIES, SCOPE, Fixture
from geoaffinity.operators import measures as m
from geoaffinity.operators.cells import order_cells, sales_orders, sku_attributes
from geoaffinity.operators.compare import compare_features
from geoaffinity.operators.welch import both_moments, with_moments
from geoaffinity.params import CompareParams, RankParams, Thresholds, TwoFeatures
from geoaffinity.plans.analyses import compare, compare_sides, rank_places
from geoaffinity.schemas import STAR_SCHEMAS
from geoaffinity.sources.star import StarTables, read_catalog_star, read_parquet_star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixture(spark):
    return Fixture(spark, FOLDER)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["compare_sku_labels", "rank_dmas_rev", "country_fact_cr", "order_share_country"])
def test_no_python_no_window_no_nested_loop(spark, name):
    shown = plan(QUERIES[name](spark, FOLDER))
    for node in ("Python", "Pandas", "Window", "NestedLoop", "CartesianProduct", "SinglePartition, ENSURE"):
        assert node not in shown


def test_alignment_needs_no_further_shuffle_and_joins_attributes_once(spark, fixture):
    """Both measures arrive partitioned by their keys, so the union folds in place, in narrow rows."""
    shown = plan(fixture.cells("region"))
    above_union = shown[: shown.index("Union")]
    assert "Exchange" not in above_union and above_union.count("Join") == 1
    fold = next(line for line in above_union.splitlines() if "HashAggregate" in line)
    assert "sku_name" not in fold and "collection" not in fold


def test_attributes_nobody_reads_are_not_carried(spark, fixture):
    shown = plan(m.feature_summary(fixture.cells("region"), "collection", "region"))
    assert "sku_name" not in shown and "color_tone" not in shown.replace("p_name", "")


def test_analysed_places_and_whole_market_come_from_one_pass(spark, fixture):
    """Summary, baseline and moments of a comparison with the whole market: one Expand each."""
    params = RankParams(SCOPE, TwoFeatures("category"))
    sides = fixture.rank_sides(params)
    assert sides.places == params.places
    levels = m.summary_with_baseline(sides.baseline, "category", "CR", sides.place, sides.places)
    one = plan(levels)
    two = plan(
        m.feature_summary(sides.analysed, "category", "region").join(
            m.baseline_metric(sides.baseline, "category", "CR"), ["category", "feature_value"], "left"
        )
    )
    assert one.count("Expand") == 1 and one.count("lineitem.parquet") == 1 and two.count("lineitem.parquet") == 2
    assert plan(both_moments(sides, "category", "CR")).count("lineitem.parquet") == 1
    region = CompareParams(SCOPE, "US West", "US East", "category")
    assert fixture.compare_sides(region).places == ()


@pytest.mark.parametrize("literal", [False, True])
def test_one_pass_equals_two(spark, fixture, literal):
    from dataclasses import replace

    params = RankParams(SCOPE, TwoFeatures("collection"))
    sides = fixture.rank_sides(params)
    found = []
    for way in (sides, replace(sides, places=())):
        rows = compare_features(way, fixture.costs(), "collection", "CR")
        rows = with_moments(rows, way, "collection", "CR", literal)
        names = ["region", "category", "feature_value", "sku_count", "n_a", "n_b", "CR_baseline", "order_percent"]
        found.append(sorted(map(tuple, rows.select(*names).collect())))
    assert found[0] == found[1] and found[0]


def test_lines_are_shuffled_once_and_only_as_needed(spark, fixture, tmp_path):
    star = fixture.star
    for name in ("fact_saleorder", "fact_saleorderline", "dim_sku", "dim_sku_property", "dim_spu_property"):
        getattr(star, name).write.parquet(f"{tmp_path}/{name}")
    stored = read_parquet_star(spark, str(tmp_path))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(order_cells(stored, sku_attributes(stored), SCOPE, "region"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", shown)
    fact_keys = [re.sub(r"#\d+", "", k) for k in keys if "spree_so_id" in k]
    assert fact_keys == ["spree_so_id", "spree_so_id"]  # the lines and the orders, once each
    assert "PushedFilters: [IsNotNull(spree_channel)" in shown
    scan = next(line for line in shown.splitlines() if "FileScan" in line and "sale_amount" in line)
    assert "ReadSchema: struct<spree_so_id:string,market_sku:string,sale_amount:decimal(18,4),quantity:bigint>" in scan


def test_bucketed_facts_are_not_shuffled_by_order(spark, fixture):
    star = fixture.star
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed_star")
    for name in ("fact_saleorder", "fact_saleorderline"):
        getattr(star, name).write.mode("overwrite").bucketBy(4, "spree_so_id").saveAsTable(f"bucketed_star.{name}")
    for name in ("dim_sku", "dim_sku_property", "dim_spu_property"):
        getattr(star, name).write.mode("overwrite").saveAsTable(f"bucketed_star.{name}")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = read_catalog_star(spark, "bucketed_star")
        shown = plan(order_cells(stored, sku_attributes(stored), SCOPE, "region"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP DATABASE bucketed_star CASCADE")
    assert not [k for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", shown) if "spree_so_id" in k]


def test_products_are_not_cut(spark):
    skus = QUERIES["sku_attributes"](spark, FOLDER).count()
    assert skus == 2 * spark.read.parquet(f"{FOLDER}/part.parquet").count()


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Sydney"])
def test_zoned_order_times_give_equal_cells_in_any_session_zone(spark, fixture, zone):
    """Instants of the warehouse's own day bounds, an hour before and after each."""
    local = "convert_timezone('{}', 'UTC', CAST(payment_completion_time AS TIMESTAMP_NTZ) + {})"
    moved = "make_interval(0, 0, 0, 0, int(pmod(hash(spree_so_id), 24)))"

    def orders(name):
        table = getattr(fixture.star, name)
        if name != "fact_saleorder":
            return table
        return table.withColumn("payment_completion_time", F.expr(local.format(zone, moved)))

    plain = StarTables(
        lambda name: orders(name)
        if name != "fact_saleorder"
        else getattr(fixture.star, name).withColumn("payment_completion_time", F.expr(f"payment_completion_time + {moved}"))
    )
    instants = StarTables(
        lambda name: orders(name).withColumn(
            "payment_completion_time",
            F.expr("timestamp_micros(unix_micros(CAST(payment_completion_time || ' UTC' AS TIMESTAMP)))"),
        )
        if name == "fact_saleorder"
        else orders(name),
        zone,
    )
    expected = sorted(map(tuple, sales_orders(plain, NARROW).collect()))
    assert len({row[1] for row in expected}) == 16
    try:
        for session in ("UTC", "America/Los_Angeles", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", session)
            assert sorted(map(tuple, sales_orders(instants, NARROW).collect())) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zoned_period_reaches_the_scan_as_a_half_open_range(spark, fixture, tmp_path):
    orders = fixture.star.fact_saleorder
    orders.withColumn("payment_completion_time", F.col("payment_completion_time").cast("timestamp")).write.parquet(
        f"{tmp_path}/fact_saleorder"
    )
    stored = StarTables(lambda name: spark.read.parquet(f"{tmp_path}/{name}"), "America/New_York")
    shown = plan(sales_orders(stored, NARROW))
    assert "GreaterThanOrEqual(payment_completion_time,2024-01-05 05:00:00.0)" in shown
    assert "LessThan(payment_completion_time,2024-01-21 05:00:00.0)" in shown


def test_stored_lines_are_pruned_by_market_and_day_and_not_shuffled(spark, fixture):
    stored = fixture.stored
    shown = plan(order_cells(stored, sku_attributes(stored), NARROW, "region"))
    scan = next(line for line in shown.splitlines() if "FileScan" in line and "sale_amount" in line)
    assert "order_day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "dynamicpruning" in scan and "market" in scan.split("PartitionFilters")[1]
    assert "SubqueryAdaptiveBroadcast dynamicpruning" in shown
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    try:
        shown = plan(order_cells(stored, sku_attributes(stored), NARROW, "region"))
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    exchanged = [k for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", shown) if "spree_so_id" in k]
    assert not [k for k in exchanged if "market_sku" not in k]  # partial cells only
    scan = next(line for line in shown.splitlines() if "FileScan" in line and "sale_amount" in line)
    assert "2024-01-05" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    lines = stored.fact_saleorderline
    assert lines.count() == fixture.star.fact_saleorderline.count()
    with pytest.raises(ValueError, match="stored by"):
        StarTables(stored._read, order_partitions=("region",))


def test_only_the_compared_places_are_read(spark, fixture, tmp_path):
    star = fixture.star
    for name in STAR_SCHEMAS:
        getattr(star, name).write.parquet(f"{tmp_path}/{name}")
    stored = read_parquet_star(spark, str(tmp_path))
    params = CompareParams(SCOPE, "US West", "US East", "category")
    whole = CompareParams(SCOPE, "US West", "US All", "category")
    for asked, filtered in ((params, True), (whole, False)):
        sides = compare_sides(stored, sku_attributes(stored), asked)
        optimised = sides.baseline._jdf.queryExecution().optimizedPlan().toString()
        for fact in ("shipping_zip_code", "add_to_cart"):
            above = optimised[: optimised.index(fact)].splitlines()[-2]
            assert ("US East" in above) == filtered


def test_date_range_reaches_the_scan(spark, fixture, tmp_path):
    fixture.star.fact_saleorder.write.parquet(f"{tmp_path}/fact_saleorder")
    filtered = spark.read.parquet(f"{tmp_path}/fact_saleorder").filter(
        "to_date(payment_completion_time) BETWEEN DATE'2024-01-05' AND DATE'2024-01-20'"
    )
    assert "GreaterThanOrEqual(payment_completion_time" in plan(filtered)
    optimised = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert "< 2024-01-21 00:00:00" in optimised


def test_shares_of_each_place_sum_to_one(spark, fixture):
    cells = fixture.cells("region")
    total = m.with_order_share(cells, "region").groupBy("region").sum("order_percent_of_total")
    assert all(row[1] == pytest.approx(1) for row in total.collect())
    shares = m.with_order_share(cells, "region", by_category=True)
    total = shares.filter("total_order > 0").groupBy("region", "category").sum("order_percent_of_category")
    assert all(row[2] == pytest.approx(1) for row in total.collect())


def test_alignment_loses_and_invents_nothing(spark, fixture):
    orders = fixture.orders("region").selectExpr("sum(total_revenue)", "sum(total_order)").first()
    views = fixture.views("region").selectExpr("sum(total_detailview)").first()
    cells = fixture.cells("region").selectExpr(
        "sum(total_revenue)", "sum(total_order)", "sum(total_detailview)"
    ).first()
    assert tuple(cells) == (*tuple(orders), *tuple(views))


def test_top_and_bottom_are_the_ends_of_one_ranking(spark, fixture):
    gate = Thresholds(0, 0, 1, 0)

    def codes(rank, limit):
        params = CompareParams(SCOPE, "US West", "US All", "market_sku", rank=rank, limit=limit, thresholds=gate)
        return [r["weighted_score"] for r in compare(fixture.star, params).collect()]

    full = codes("Top", 100)
    known = [score for score in full if score is not None]
    assert known == sorted(known, reverse=True)
    assert codes("Top", 5) == full[:5]
    assert codes("Bottom", 5) == sorted(known)[:5]


def test_ranking_of_places_has_every_place_once_per_feature(spark, fixture):
    params = RankParams(SCOPE, TwoFeatures("category"), thresholds=Thresholds(0, 0, 0, 0))
    found = rank_places(fixture.star, params, fixture.product_info).collect()
    pairs = [(r["Region"], r["category"]) for r in found]
    assert len(pairs) == len(set(pairs)) == 20

"""One named query per operator, over the star derived from the test tables.

Results are made comparable across engines: money becomes double, and the few doubles that depend
on the order of additions are rounded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from geoaffinity.functions.ratios import guarded_ratio
from geoaffinity.functions.student_t import two_sided_p
from geoaffinity.operators import bitmaps
from geoaffinity.operators import measures as m
from geoaffinity.operators.align import key_union
from geoaffinity.operators.cells import (
    COUNTRY,
    DMA,
    REGION,
    cost_cells,
    order_cells,
    sales_orders,
    sku_attributes,
    view_cells,
)
from geoaffinity.operators.compare import Sides, compare_features, gated
from geoaffinity.operators.present import format_basic, format_two_feature
from geoaffinity.operators.welch import (
    KEYS,
    daily_metric,
    moments,
    welch_table,
    with_test_statistics,
)
from geoaffinity.params import (
    BOTTOM,
    COMMON_OPTIONS,
    CR,
    DMA_LEVEL,
    DMAS,
    FEATURES,
    REGIONAL,
    REV_PER_DV,
    TOP,
    CompareParams,
    FactParams,
    RankParams,
    Scope,
    Thresholds,
    TwoFeatures,
)
from geoaffinity.plans import analyses
from geoaffinity.plans.kept import KeptCells
from geoaffinity.sources.shared import shared_folder
from geoaffinity.plans.star_store import write_star
from geoaffinity.sources.product_lists import of_market, option_lists, read_product_info
from geoaffinity.sources.reports import numbered, read_report, report_name, write_report
from geoaffinity.sources.star import StarTables
from geoaffinity.sources.tpch_star import tpch_product_info, tpch_star

Query = Callable[[SparkSession, str], DataFrame]

SCOPE = Scope("US", dt.date(2024, 1, 1), dt.date(2024, 1, 30))
AU_SCOPE = Scope("AU", SCOPE.start, SCOPE.end)
OPEN = Thresholds(0, 0, 1, 0)
NARROW = Scope("US", dt.date(2024, 1, 5), dt.date(2024, 1, 20))
WEST, EAST, ALL = "US West", "US East", "US All"
NEW_YORK, LOS_ANGELES = DMAS[0], DMAS[1]
CHOSEN = {"category": ("SMALL", "LARGE"), "subcategory": (), "collection": ("widget", "bolt")}
TWO = TwoFeatures("category", "collection")
TWO_CHOSEN = TwoFeatures("category", "collection", ("SMALL", "LARGE"))


class Fixture:
    """The star of one data folder with everything the queries share."""

    def __init__(self, spark: SparkSession, folder: str, whole: bool = False):
        self.spark = spark
        self.folder = folder
        self.star = tpch_star(spark, folder, whole)

    @cached_property
    def whole(self) -> Fixture:
        """The same over the star whose every order, place and product counts."""
        return Fixture(self.spark, self.folder, whole=True)

    @cached_property
    def attributes(self) -> DataFrame:
        return sku_attributes(self.star)

    @cached_property
    def product_info(self) -> DataFrame:
        return tpch_product_info(self.attributes)

    @cached_property
    def us_lists(self) -> dict[str, DataFrame]:
        return option_lists(of_market(self.product_info, "US"), FEATURES)

    def orders(self, place) -> DataFrame:
        return order_cells(self.star, self.attributes, SCOPE, place)

    def views(self, place, include_overseas: bool = False) -> DataFrame:
        return view_cells(self.star, self.attributes, SCOPE, place, include_overseas)

    def costs(self, by_day: bool = False) -> DataFrame:
        return cost_cells(self.star, self.attributes, SCOPE, by_day)

    def cells(self, place, include_overseas: bool = False) -> DataFrame:
        if place == COUNTRY:
            return analyses.aligned_country_cells(self.star, self.attributes, SCOPE)
        return analyses.aligned_cells(self.star, self.attributes, SCOPE, place, include_overseas)

    @cached_property
    def stored(self) -> StarTables:
        """The star written as partitioned and bucketed catalog tables, and read from there."""
        folder = shared_folder(self.spark, "star")
        return write_star(self.star, f"star_{folder[-32:]}", 8, folder)

    @cached_property
    def kept(self) -> StarTables:
        """The star with kept cells; the last days are built first and part of them once more."""
        cells = KeptCells(self.spark, shared_folder(self.spark, "kept"))
        cells.update(self.star, NARROW)
        cells.update(self.star, SCOPE)
        return self.star.with_kept(cells)

    def compare_sides(self, params: CompareParams) -> Sides:
        return analyses.compare_sides(self.star, self.attributes, params)

    def rank_sides(self, params: RankParams) -> Sides:
        return analyses.rank_sides(self.star, self.attributes, params)


# Digits of the results that depend on the order of floating-point additions; all others are
# single operations on exact sums and equal to the last bit.
_DIGITS = {"order_percent": 9, "weighted_score": 9, "p_value": 6}


def settled(df: DataFrame) -> DataFrame:
    """Money as double, order-dependent doubles rounded."""

    def text(name: str, kind: str) -> str:
        if name in _DIGITS and kind == "double":
            return f"round({name}, {_DIGITS[name]}) AS {name}"
        return f"double({name}) AS {name}" if kind.startswith("decimal") else f"`{name}`"

    return df.selectExpr(*[text(name, kind) for name, kind in df.dtypes])


def _compare_params(analysed: str, baseline: str, feature: str, metric: str, **other):
    by_dma = analysed in DMAS
    return CompareParams(
        SCOPE,
        analysed,
        baseline,
        feature,
        metric,
        level=DMA_LEVEL if by_dma else REGIONAL,
        baseline_level=DMA_LEVEL if baseline in DMAS else "Country & Regional Level",
        **other,
    )


def _compare(*args, **other):
    params = _compare_params(*args, **other)
    return lambda fx: analyses.compare(fx.star, params)


def _compare_listed(*args, **other):
    """With option filters on both sides; a blank option means all values of the US products."""
    params = _compare_params(*args, **other)
    return lambda fx: analyses.compare(fx.star, params, fx.us_lists)


def _rank(level: str, metric: str, features: TwoFeatures = TwoFeatures()):
    params = RankParams(SCOPE, features, metric, level)
    return lambda fx: analyses.rank_places(fx.star, params, fx.product_info)


def _fact(metric: str, features: TwoFeatures):
    params = FactParams(SCOPE, features, metric)
    return lambda fx: analyses.country_fact_table(fx.star, params, fx.product_info)


def _welch_compare(analysed: str, baseline: str, feature: str, metric: str):
    params = _compare_params(analysed, baseline, feature, metric)
    return lambda fx: welch_table(fx.compare_sides(params), feature, metric)


def _welch_rank(level: str, metric: str, feature: str):
    params = RankParams(SCOPE, TwoFeatures(feature), metric, level)
    return lambda fx: welch_table(fx.rank_sides(params), feature, metric)


def _order_share_country(fx: Fixture) -> DataFrame:
    shared = m.with_order_share(fx.cells(COUNTRY), "market")
    return m.with_order_share(shared, "market", by_category=True).select(
        "market_sku", "order_date", "total_order", "order_percent_of_total", "order_percent_of_category"
    )


def _order_share(by_category: bool):
    name = "order_percent_of_category" if by_category else "order_percent_of_total"
    return lambda fx: m.with_order_share(fx.cells(REGION), REGION, by_category).select(
        "market_sku", "region", "order_date", "category", "total_order", name
    )


def _option_list(fx: Fixture) -> DataFrame:
    pairs = ", ".join(f"'{dimension}', {dimension}" for dimension in FEATURES)
    return (
        of_market(fx.product_info, "US")
        .selectExpr(f"stack({len(FEATURES)}, {pairs}) AS (dimension, value)")
        .filter("value IS NOT NULL")
        .distinct()
    )


def _ratios(fx: Fixture) -> DataFrame:
    return m.feature_summary(fx.cells(REGION), "subcategory", REGION).selectExpr(
        "region",
        "category",
        "feature_value",
        f"{m.metric_value(REV_PER_DV)} AS rev_per_dv",
        f"{m.metric_value(CR)} AS CR",
        f"{guarded_ratio('total_revenue', 'total_quantity')} AS average_price",
    )


def _comparison(fx: Fixture, feature: str) -> DataFrame:
    params = _compare_params(WEST, ALL, feature, REV_PER_DV)
    rows = compare_features(fx.compare_sides(params), fx.costs(), feature, REV_PER_DV)
    return gated(rows, Thresholds(), REV_PER_DV)


def _ranked(rank: str):
    return lambda fx: m.best(
        _comparison(fx, "market_sku"), rank, 10, "category", "feature_value"
    ).select("category", "feature_value", "weighted_score")


def _daily_metric(fx: Fixture) -> DataFrame:
    sides = fx.compare_sides(_compare_params(WEST, ALL, "category", REV_PER_DV))
    columns = [*KEYS, "order_date", "value"]
    tagged = [
        daily_metric(cells, "category", REV_PER_DV).selectExpr(f"'{name}' AS `group`", *columns)
        for name, cells in (
            ("region_analysed", sides.analysed),
            ("region_baseline", sides.baseline),
        )
    ]
    return tagged[0].unionByName(tagged[1])


def _welch_pvalue(fx: Fixture) -> DataFrame:
    sides = fx.rank_sides(RankParams(SCOPE, TwoFeatures("market_sku")))
    a = daily_metric(sides.analysed, "market_sku", REV_PER_DV, REGION)
    b = daily_metric(sides.baseline, "market_sku", REV_PER_DV)
    joined = moments(a, [REGION, *KEYS], "a").join(moments(b, KEYS, "b"), list(KEYS), "left")
    return (
        with_test_statistics(joined)
        .filter("t_squared IS NOT NULL")
        .select(REGION, "feature_value", "n_a", "n_b", two_sided_p("t_squared", "df").alias("p_value"))
    )


def _welch_small_sample(fx: Fixture) -> DataFrame:
    sides = fx.compare_sides(_compare_params(WEST, ALL, "market_spu", REV_PER_DV))
    return welch_table(sides, "market_spu", REV_PER_DV).filter("p_value IS NULL")


def _format_basic(fx: Fixture) -> DataFrame:
    params = _compare_params(WEST, ALL, "color_tone", REV_PER_DV)
    return format_basic(analyses.compare(fx.star, params), "color_tone")


def _format_two_feature(fx: Fixture) -> DataFrame:
    params = RankParams(SCOPE, TWO, CR)
    return format_two_feature(analyses.rank_places(fx.star, params, fx.product_info), TWO)


def _stored_orders(place):
    return lambda fx: order_cells(fx.stored, fx.attributes, SCOPE, place)


def _kept_cells(place):
    if place == COUNTRY:
        return lambda fx: analyses.aligned_country_cells(fx.kept, fx.attributes, SCOPE)
    return lambda fx: analyses.aligned_cells(fx.kept, fx.attributes, SCOPE, place)


def _kept_compare(fx: Fixture) -> DataFrame:
    return analyses.compare(fx.kept, _compare_params(WEST, ALL, "category", REV_PER_DV))


def _au_compare(analysed: str, baseline: str, feature: str, metric: str):
    params = CompareParams(AU_SCOPE, analysed, baseline, feature, metric, thresholds=OPEN)
    return lambda fx: analyses.compare(fx.star, params)


def _au_rank(fx: Fixture) -> DataFrame:
    params = RankParams(AU_SCOPE, TwoFeatures(), thresholds=OPEN)
    return analyses.rank_places(fx.star, params, fx.product_info)


def _au_fact(fx: Fixture) -> DataFrame:
    return analyses.country_fact_table(fx.star, FactParams(AU_SCOPE), fx.product_info)


def _literal_compare(fx: Fixture) -> DataFrame:
    params = _compare_params(WEST, ALL, "category", REV_PER_DV)
    return analyses.compare(fx.star, params, literal_days=True)


def _literal_rank(fx: Fixture) -> DataFrame:
    params = RankParams(SCOPE, TwoFeatures(), CR)
    return analyses.rank_places(fx.star, params, fx.product_info, literal_days=True)


def _literal_welch(fx: Fixture) -> DataFrame:
    sides = fx.compare_sides(_compare_params(WEST, ALL, "collection", REV_PER_DV))
    return welch_table(sides, "collection", REV_PER_DV, literal_days=True)


def _in_order(build: Callable[[Fixture], DataFrame], *columns: str):
    """The keys of a result, numbered in the order that it comes in."""
    return lambda fx: numbered(build(fx), shared_folder(fx.spark, "ordered")).select("Row", *columns)


def _product_list(fx: Fixture) -> DataFrame:
    """The product file as an analyst stores it: other columns first, in another order."""
    folder = shared_folder(fx.spark, "products")
    columns = ["sku_name", *reversed(fx.product_info.columns)]
    fx.attributes.select(*columns).write.option("header", True).csv(folder)
    return read_product_info(fx.spark, folder)


def _report(fx: Fixture) -> DataFrame:
    params = _compare_params(WEST, ALL, "color_tone", REV_PER_DV)
    shown = format_basic(analyses.compare(fx.star, params), "color_tone")
    return read_report(fx.spark, write_report(shown, shared_folder(fx.spark, "reports"), report_name(params)))


def _summary_of_days(*keys: str):
    def build(fx: Fixture) -> DataFrame:
        numbers = bitmaps.sku_numbers(fx.attributes, ["category", "collection"])
        daily = bitmaps.daily_summary(fx.cells(REGION), numbers, "collection", REGION)
        return bitmaps.summary_of_days(daily, keys)

    return build


_BUILDERS: dict[str, Callable[[Fixture], DataFrame]] = {
    # cells
    "sku_attributes": lambda fx: fx.attributes,
    "order_cells_region": lambda fx: fx.whole.orders(REGION),
    "order_cells_dma": lambda fx: fx.whole.orders(DMA),
    "order_cells_country": lambda fx: fx.whole.orders(COUNTRY),
    "view_cells_region": lambda fx: fx.views(REGION),
    "view_cells_incl_overseas": lambda fx: fx.views(REGION, include_overseas=True),
    "view_cells_dma": lambda fx: fx.views(DMA),
    "view_cells_country": lambda fx: fx.views(COUNTRY),
    "cost_by_sku": lambda fx: fx.costs(),
    "cost_by_sku_day": lambda fx: fx.costs(by_day=True),
    "date_range": lambda fx: sales_orders(fx.star, NARROW).select("spree_so_id", "order_date"),
    "option_list": _option_list,
    # alignment
    "key_union": lambda fx: key_union(fx.whole.orders(REGION), fx.whole.views(REGION), REGION),
    "align_region": lambda fx: fx.cells(REGION),
    "align_dma": lambda fx: fx.cells(DMA),
    "align_country": lambda fx: fx.cells(COUNTRY),
    # measures
    "feature_key": lambda fx: m.with_feature(fx.whole.cells(REGION), "material_helper").select(
        "market_sku", "region", "order_date", "feature_value", "cate-feature"
    ),
    "order_share_total": _order_share(by_category=False),
    "order_share_category": _order_share(by_category=True),
    "order_share_country": _order_share_country,
    "filter_options": lambda fx: m.filter_options(
        fx.cells(REGION), fx.attributes, CHOSEN, {n: fx.us_lists[n] for n in COMMON_OPTIONS}
    ),
    "two_feature_filter": lambda fx: m.filter_options(
        fx.cells(REGION, include_overseas=True), fx.attributes, TWO_CHOSEN.options, fx.us_lists
    ),
    "feature_summary": lambda fx: m.feature_summary(fx.cells(REGION), "collection", REGION),
    "baseline_summary": lambda fx: m.baseline_metric(fx.cells(REGION), "color_tone", REV_PER_DV),
    "cost_by_feature": lambda fx: m.cost_by_feature(fx.costs(), "material_helper"),
    "ratios": _ratios,
    "threshold_gate": lambda fx: _comparison(fx, "subcategory"),
    "top_k": _ranked(TOP),
    "bottom_k": _ranked(BOTTOM),
    "daily_metric": _daily_metric,
    # comparisons
    "compare_region_vs_all_rev": _compare(WEST, ALL, "category", REV_PER_DV),
    "compare_region_vs_all_cr": _compare(WEST, ALL, "collection", CR),
    "compare_region_vs_region_rev": _compare(WEST, EAST, "subcategory", REV_PER_DV),
    "compare_region_vs_region_cr": _compare(WEST, EAST, "material_helper", CR, rank=BOTTOM),
    "compare_dma_vs_dma_rev": _compare(NEW_YORK, LOS_ANGELES, "category", REV_PER_DV),
    "compare_dma_vs_dma_cr": _compare(NEW_YORK, LOS_ANGELES, "collection", CR),
    "compare_dma_vs_region_rev": _compare(NEW_YORK, EAST, "color_tone", REV_PER_DV),
    "compare_dma_vs_region_cr": _compare(NEW_YORK, EAST, "category", CR),
    "compare_dma_vs_all_rev": _compare(NEW_YORK, ALL, "material_helper", REV_PER_DV),
    "compare_dma_vs_all_cr": _compare(NEW_YORK, ALL, "category", CR),
    "compare_sku_labels": _compare(WEST, ALL, "market_sku", REV_PER_DV, limit=100),
    "compare_spu_labels": _compare(WEST, ALL, "market_spu", REV_PER_DV, limit=100),
    "compare_region_options": _compare_listed(WEST, ALL, "category", REV_PER_DV, options=CHOSEN),
    "compare_color_tone_options": _compare_listed(WEST, EAST, "color_tone", CR, options=CHOSEN),
    "compare_dma_region_options": _compare_listed(NEW_YORK, EAST, "category", CR, options=CHOSEN),
    "compare_blank_options": _compare_listed(WEST, ALL, "material_helper", REV_PER_DV),
    # tests
    "welch_region_rev": _welch_compare(WEST, ALL, "collection", REV_PER_DV),
    "welch_region_cr": _welch_compare(WEST, EAST, "collection", CR),
    "welch_dma_rev": lambda fx: _welch_compare(NEW_YORK, LOS_ANGELES, "color_tone", REV_PER_DV)(fx.whole),
    "welch_dma_cr": _welch_compare(NEW_YORK, ALL, "color_tone", CR),
    "welch_all_regions_rev": _welch_rank(REGIONAL, REV_PER_DV, "collection"),
    "welch_all_regions_cr": _welch_rank(REGIONAL, CR, "color_tone"),
    "welch_all_dmas_rev": _welch_rank(DMA_LEVEL, REV_PER_DV, "material_helper"),
    "welch_all_dmas_cr": _welch_rank(DMA_LEVEL, CR, "category"),
    "welch_pvalue": _welch_pvalue,
    "welch_small_sample": _welch_small_sample,
    # rankings of places
    "rank_regions_rev": _rank(REGIONAL, REV_PER_DV),
    "rank_regions_cr": _rank(REGIONAL, CR, TwoFeatures("collection", "market_spu")),
    "rank_dmas_rev": _rank(DMA_LEVEL, REV_PER_DV, TWO_CHOSEN),
    "rank_dmas_cr": _rank(DMA_LEVEL, CR),
    # country facts
    "country_fact_rev": _fact(REV_PER_DV, TwoFeatures("category")),
    "country_fact_cr": _fact(CR, TwoFeatures("market_sku")),
    "country_fact_two_features": _fact(REV_PER_DV, TWO_CHOSEN),
    # the stored star, kept cells and mergeable counts
    "stored_order_cells_region": _stored_orders(REGION),
    "stored_order_cells_dma": _stored_orders(DMA),
    "kept_align_region": _kept_cells(REGION),
    "kept_align_dma": _kept_cells(DMA),
    "kept_align_country": _kept_cells(COUNTRY),
    "kept_compare_region_vs_all": _kept_compare,
    "feature_summary_of_days": _summary_of_days(REGION),
    "feature_summary_of_places": _summary_of_days("order_date"),
    # the other market
    "au_order_cells_region": lambda fx: order_cells(fx.star, fx.attributes, AU_SCOPE, REGION),
    "au_align_country": lambda fx: analyses.aligned_country_cells(fx.star, fx.attributes, AU_SCOPE),
    "au_compare_region_vs_all_rev": _au_compare("AU Sydney", "AU All", "category", REV_PER_DV),
    "au_compare_region_vs_region_cr": _au_compare("AU Sydney", "AU Perth", "collection", CR),
    "au_rank_regions_rev": _au_rank,
    "au_country_fact_rev": _au_fact,
    # cells without orders as days of their own
    "literal_days_compare": _literal_compare,
    "literal_days_rank_cr": _literal_rank,
    "literal_days_welch": _literal_welch,
    # thresholds that are not the usual ones
    "thresholds_cr_percent": _compare(WEST, ALL, "collection", CR, thresholds=Thresholds(20, 250, 5, 10)),
    "thresholds_rev_per_dv": _compare(
        WEST, ALL, "subcategory", REV_PER_DV, thresholds=Thresholds(50, 70000, 3, 200)
    ),
    # results in their order
    "ordered_compare": _in_order(
        _compare(WEST, ALL, "collection", REV_PER_DV), "category", "collection"
    ),
    "ordered_rank_regions": _in_order(_rank(REGIONAL, REV_PER_DV), "cate-feature", "Region"),
    "ordered_country_fact": _in_order(
        _fact(REV_PER_DV, TwoFeatures("category")), "category", "rev_per_dv"
    ),
    # files
    "product_list_from_csv": _product_list,
    "report_read_back": _report,
    # presentation
    "format_basic": _format_basic,
    "format_two_feature": _format_two_feature,
}


def _query(build: Callable[[Fixture], DataFrame]) -> Query:
    return lambda spark, folder: settled(build(Fixture(spark, folder)))


QUERIES: dict[str, Query] = {name: _query(build) for name, build in _BUILDERS.items()}

"""Compare, rank and country fact table: from star tables and parameters to a result table.

Each analysis reduces the facts to aligned daily cells and derives everything else from them.
With a ``store`` the cells are written there first, by a job of their own, so that facts are read
once; without one the whole analysis is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.operators import measures as m
from geoaffinity.operators.align import align, align_country
from geoaffinity.operators.cells import (
    COUNTRY,
    DMA,
    REGION,
    cost_cells,
    cost_measures,
    order_measures,
    sku_attributes,
    view_measures,
)
from geoaffinity.operators.compare import Sides, compare_features, gated, result_columns
from geoaffinity.operators.facttable import fact_table
from geoaffinity.operators.welch import with_moments, with_p_value
from geoaffinity.params import (
    DMA_LEVEL,
    CompareParams,
    FactParams,
    RankParams,
    Scope,
    option_dimensions,
)
from geoaffinity.plans.materialise import CellStore
from geoaffinity.sources.product_lists import of_market, option_lists
from geoaffinity.sources.star import StarTables


def aligned_cells(
    star: StarTables,
    attributes: DataFrame,
    scope: Scope,
    place: str,
    include_overseas: bool = False,
) -> DataFrame:
    """Aligned region or DMA cells of one market and period."""
    return align(
        order_measures(star, scope, place),
        view_measures(star, scope, place, include_overseas),
        attributes,
        scope.market,
        place,
    )


def aligned_country_cells(star: StarTables, attributes: DataFrame, scope: Scope) -> DataFrame:
    """Aligned country cells with cart additions and cost."""
    return align_country(
        order_measures(star, scope, COUNTRY),
        view_measures(star, scope, COUNTRY),
        cost_measures(star, scope, by_day=True),
        attributes,
        scope.market,
    )


def compare_sides(
    star: StarTables,
    attributes: DataFrame,
    params: CompareParams,
    lists: Mapping[str, DataFrame] | None = None,
    store: CellStore | None = None,
) -> Sides:
    """Analysed and baseline cells of a comparison, option filters applied."""
    place = DMA if params.level == DMA_LEVEL else REGION
    baseline_place = (
        DMA if params.level == DMA_LEVEL and params.baseline_level == DMA_LEVEL else REGION
    )
    whole_market = params.baseline == params.scope.all_name
    wanted: dict[str, set[str] | None] = {place: {params.analysed}}
    if whole_market:
        wanted[baseline_place] = None
    else:
        wanted.setdefault(baseline_place, set()).add(params.baseline)
    cells = _kept_cells(star, attributes, params.scope, wanted, store)
    chosen = {name: params.options.get(name, ()) for name in option_dimensions(params.feature)}
    return Sides.build(
        cells[place],
        cells[baseline_place],
        place,
        [params.analysed],
        lambda df: m.filter_options(df, attributes, chosen, lists),
        baseline_place,
        None if whole_market else params.baseline,
    )


def compare(
    star: StarTables,
    params: CompareParams,
    lists: Mapping[str, DataFrame] | None = None,
    store: CellStore | None = None,
    literal_days: bool = False,
) -> DataFrame:
    """Features of one place ranked by weighted lift over the baseline, with p-values."""
    feature, metric = params.feature, params.metric
    attributes = sku_attributes(star)
    sides = compare_sides(star, attributes, params, lists, store)
    costs = cost_cells(star, attributes, params.scope)
    rows = gated(compare_features(sides, costs, feature, metric), params.thresholds, metric)
    rows = m.with_label(rows, attributes, feature)
    rows = with_moments(rows, sides, feature, metric, literal_days)
    ranked = m.best(rows, params.rank, params.limit, "category", "feature_value")
    tail = [*result_columns(metric), "p_value", "p_note"]
    return m.arrange(with_p_value(ranked), feature, tail)


def rank_sides(
    star: StarTables,
    attributes: DataFrame,
    params: RankParams,
    product_info: DataFrame | None = None,
    store: CellStore | None = None,
) -> Sides:
    """Cells of every place against those of the whole market, feature filters applied."""
    place = DMA if params.level == DMA_LEVEL else REGION
    wanted = {place: set(params.places), REGION: None}
    cells = _kept_cells(star, attributes, params.scope, wanted, store, True)
    in_scope = _feature_filter(attributes, params, product_info)
    return Sides.build(cells[place], cells[REGION], place, params.places, in_scope)


def rank_places(
    star: StarTables,
    params: RankParams,
    product_info: DataFrame | None = None,
    store: CellStore | None = None,
    literal_days: bool = False,
) -> DataFrame:
    """Every place's features against the whole market, grouped by feature, best place first."""
    feature, metric = params.features.analysed, params.metric
    attributes = sku_attributes(star)
    sides = rank_sides(star, attributes, params, product_info, store)
    costs = cost_cells(star, attributes, params.scope)
    rows = gated(compare_features(sides, costs, feature, metric), params.thresholds, metric)
    rows = m.with_label(rows, attributes, feature)
    rows = with_p_value(with_moments(rows, sides, feature, metric, literal_days))
    place = "DMA" if params.level == DMA_LEVEL else "Region"
    rows = rows.withColumnRenamed(sides.place, place)
    result = m.arrange(rows, feature, [*result_columns(metric), place, "p_value", "p_note"])
    return result.orderBy(
        F.col("cate-feature").desc(), F.col("weighted_score").desc_nulls_last(), place
    )


def country_fact_table(
    star: StarTables,
    params: FactParams,
    product_info: DataFrame | None = None,
    store: CellStore | None = None,
) -> DataFrame:
    """Country-wide facts of the chosen features in descending order of the metric."""
    attributes = sku_attributes(star)
    cells = aligned_country_cells(star, attributes, params.scope)
    if store is not None:
        cells = store.write(cells)
    in_scope = _feature_filter(attributes, params, product_info)
    return fact_table(cells, attributes, params, in_scope)


def _feature_filter(attributes: DataFrame, params: RankParams | FactParams, product_info):
    """Filter on the values of both features; without values, those of the market's products."""
    options = params.features.options
    lists = (
        option_lists(of_market(product_info, params.scope.market), options)
        if product_info is not None
        else None
    )
    return lambda df: m.filter_options(df, attributes, options, lists)


def _kept_cells(
    star: StarTables,
    attributes: DataFrame,
    scope: Scope,
    wanted: Mapping[str, set[str] | None],
    store: CellStore | None,
    include_overseas: bool = False,
) -> dict[str, DataFrame]:
    """Aligned cells of each place level, written once if there is a store.

    Levels of which only some places are wanted are filtered before anything is read: the filter
    is on a grouping key, so Spark takes it down to the scans.  None stands for the whole market.
    """
    cells = {}
    for place, names in wanted.items():
        cells[place] = aligned_cells(star, attributes, scope, place, include_overseas)
        if names is not None:
            cells[place] = cells[place].filter(F.col(place).isin(*sorted(names)))
    return cells if store is None else store.write_levels(cells)

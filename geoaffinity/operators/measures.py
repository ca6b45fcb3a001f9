"""Feature summaries, order shares, scope filters, gates and rankings over aligned cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaffinity.functions.ratios import feature_key, guarded_ratio, share
from geoaffinity.params import TOP, Thresholds
from geoaffinity.sources.product_lists import option_values

SUMMED = ("total_revenue", "total_quantity", "total_order", "total_detailview")
COUNTRY_SUMMED = (*SUMMED, "atc", "country_total_cost")
NUMERATORS = {"Rev per DV": "total_revenue", "CR": "total_order"}
METRIC_NAMES = {"Rev per DV": "rev_per_dv", "CR": "CR"}


def with_feature(cells: DataFrame, feature: str) -> DataFrame:
    """Add the analysed feature's value and the 'category: feature' key."""
    return cells.selectExpr(
        "*", f"{feature} AS feature_value", f"{feature_key('category', feature)} AS `cate-feature`"
    )


def keyed(cells: DataFrame, feature: str) -> DataFrame:
    """Cells that have a category and a value of the analysed feature."""
    return cells.filter(f"category IS NOT NULL AND {feature} IS NOT NULL").selectExpr(
        "*", f"{feature} AS feature_value"
    )


def metric_value(metric: str) -> str:
    """Revenue or orders per product view, 0 where undefined."""
    return guarded_ratio(NUMERATORS[metric], "total_detailview")


def sums(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


# --- order shares -------------------------------------------------------------------------


def order_totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Orders per place, or per place and category, before any scope filter."""
    return cells.groupBy(*keys).agg(F.sum("total_order").alias("whole"))


def join_totals(
    rows: DataFrame, totals: DataFrame, keys: Sequence[str], spread_by: str, slices: int = 64
) -> DataFrame:
    """Left-join a short table of totals to many rows with few, possibly hot keys.

    Each key is cut into ``slices`` by a hash of ``spread_by`` and every total is repeated once
    per slice.  A broadcast is then not needed for balance: it happens only when Spark measures
    the totals as small, and beyond that the shuffle is even.
    """
    sliced = totals.selectExpr("*", f"explode(sequence(0, {slices - 1})) AS slice")
    spread = rows.selectExpr("*", f"pmod(hash({spread_by}), {slices}) AS slice")
    return spread.join(sliced, [*keys, "slice"], "left").drop("slice")


def with_order_share(cells: DataFrame, place: str, by_category: bool = False) -> DataFrame:
    """Each cell's share of the orders of its place, or of its place and category."""
    keys = [place, "category"] if by_category else [place]
    name = "order_percent_of_category" if by_category else "order_percent_of_total"
    joined = join_totals(cells, order_totals(cells, keys), keys, "market_sku")
    return joined.selectExpr(*cells.columns, f"{share('total_order', 'whole')} AS {name}")


# --- scope filters ------------------------------------------------------------------------


def filter_options(
    cells: DataFrame,
    attributes: DataFrame,
    options: Mapping[str, Sequence[str]],
    lists: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Keep cells whose attributes lie in the chosen option values; null never does.

    An option without chosen values means every value its list offers, or no restriction if
    there is no list.  Lists are matched on the SKU dimension and only the surviving SKUs meet
    the cells, so no cell is shuffled by a hot attribute value.
    """
    listed = {}
    for dimension, values in options.items():
        if values:
            cells = cells.filter(F.col(dimension).isin(*values))
        elif lists and dimension in lists:
            listed[dimension] = lists[dimension]
    if not listed:
        return cells
    skus = attributes
    for dimension, offered in listed.items():
        skus = skus.join(option_values(offered, dimension), dimension, "left_semi")
    return cells.join(skus.select("market_sku"), "market_sku", "left_semi")


# --- summaries ----------------------------------------------------------------------------


def feature_summary(
    cells: DataFrame, feature: str, place: str | None = None, measures: Sequence[str] = SUMMED
) -> DataFrame:
    """SKU count and summed measures per category and feature value (and place)."""
    keys = [*([place] if place else []), "category", "feature_value"]
    return (
        keyed(cells, feature)
        .groupBy(*keys)
        .agg(F.count_distinct("market_sku").alias("sku_count"), *sums(*measures))
    )


def with_order_percent(summary: DataFrame, cells: DataFrame, feature: str, place: str) -> DataFrame:
    """Share of the place's orders for categories, of the category's orders for other features.

    The sum of cell shares equals the share of the summed orders, so only summary rows meet the
    totals.  ``cells`` are the cells before the scope filters.
    """
    keys = [place] if feature == "category" else [place, "category"]
    joined = join_totals(summary, order_totals(cells, keys), keys, "feature_value")
    return joined.selectExpr(
        *summary.columns, f"{guarded_ratio('total_order', 'whole')} AS order_percent"
    )


def baseline_metric(cells: DataFrame, feature: str, metric: str) -> DataFrame:
    """Metric per category and feature value over the baseline's cells."""
    return (
        keyed(cells, feature)
        .groupBy("category", "feature_value")
        .agg(*sums(NUMERATORS[metric], "total_detailview"))
        .selectExpr("category", "feature_value", f"{metric_value(metric)} AS metric_baseline")
    )


def both_levels(
    rows: DataFrame, keys: Sequence[str], place: str, aggregates: Sequence[Column], more: Sequence[str] = ()
) -> DataFrame:
    """Aggregates per place and keys, and per keys over all places, in one pass over the rows.

    Grouping sets give both; ``whole`` marks the rows of all places, whose place is null. ``more``
    names columns that group both levels besides.
    """
    every = [place, *keys, *more]
    return (
        rows.groupingSets([every, every[1:]], *every)
        .agg(*aggregates, F.grouping(place).cast("boolean").alias("whole"))
    )


def beside_whole(
    levels: DataFrame, keys: Sequence[str], place: str, places: Sequence[str], of_whole: Mapping[str, Column]
) -> DataFrame:
    """The rows of the named places, each beside columns of the row of all places with its keys.

    A key has one row for each place at most, so these are gathered by key, without a join that
    would derive the levels a second time.
    """
    own = [name for name in levels.columns if name not in (*keys, "whole")]
    named = ~F.col("whole") & F.col(place).isin(*places)
    gathered = levels.groupBy(*keys).agg(
        F.collect_list(F.when(named, F.struct(*own))).alias("of_places"),
        *[F.max(F.when(F.col("whole"), column)).alias(name) for name, column in of_whole.items()],
    )
    return gathered.select(*keys, *of_whole, F.inline("of_places"))


def summary_with_baseline(
    cells: DataFrame, feature: str, metric: str, place: str, places: Sequence[str]
) -> DataFrame:
    """``feature_summary`` of the named places with ``baseline_metric`` of all cells, in one pass."""
    keys = ["category", "feature_value"]
    aggregates = [F.count_distinct("market_sku").alias("sku_count"), *sums(*SUMMED)]
    levels = both_levels(keyed(cells, feature), keys, place, aggregates)
    return beside_whole(
        levels, keys, place, places, {"metric_baseline": F.expr(metric_value(metric))}
    )


def cost_by_feature(costs: DataFrame, feature: str) -> DataFrame:
    """Advertising cost of the market per category and feature value."""
    return (
        keyed(costs, feature).groupBy("category", "feature_value").agg(*sums("country_total_cost"))
    )


# --- gate and rank ------------------------------------------------------------------------


def gate(rows: DataFrame, thresholds: Thresholds, metric: str, metric_column: str, price: str) -> DataFrame:
    """Rows that reach all four thresholds; an unknown value reaches none."""
    return rows.filter(
        f"""country_total_cost_per_sku >= {float(thresholds.cost_per_sku)}D
        AND {metric_column} >= {float(thresholds.metric_floor(metric))}D
        AND total_order >= {float(thresholds.orders)}D
        AND {price} >= {float(thresholds.price)}D"""
    )


def best(rows: DataFrame, rank: str, limit: int, *ties: str) -> DataFrame:
    """The first rows by weighted score, unknown scores last, ties by key."""
    score = F.col("weighted_score")
    first = score.desc_nulls_last() if rank == TOP else score.asc_nulls_last()
    return rows.orderBy(first, *ties).limit(limit)


def spu_names(attributes: DataFrame) -> DataFrame:
    """One name per SPU: the smallest of those in use."""
    return (
        attributes.filter("market_spu IS NOT NULL")
        .groupBy("market_spu")
        .agg(F.min("spu_name").alias("spu_name"))
    )


def with_label(rows: DataFrame, attributes: DataFrame, feature: str) -> DataFrame:
    """Add the product name where the feature is a product code."""
    if feature == "market_sku":
        labels = attributes.selectExpr("market_sku AS feature_value", "sku_name")
    elif feature == "market_spu":
        labels = spu_names(attributes).withColumnRenamed("market_spu", "feature_value")
    else:
        return rows
    return rows.join(labels, "feature_value", "left")


def arrange(rows: DataFrame, feature: str, tail: Sequence[str]) -> DataFrame:
    """Final column order: key, feature, its label, SKU count, category, then ``tail``."""
    key = f"{feature_key('category', 'feature_value')} AS `cate-feature`"
    label = {"market_sku": ["sku_name"], "market_spu": ["spu_name"]}.get(feature, [])
    if feature == "category":
        head = [key, "category", "sku_count"]
    else:
        head = [key, f"feature_value AS {feature}", *label, "sku_count", "category"]
    return rows.selectExpr(*head, *tail)

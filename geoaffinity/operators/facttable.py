"""Country-wide performance of features: no baseline, no test, no limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.functions.ratios import guarded_ratio
from geoaffinity.operators import measures as m
from geoaffinity.params import CR, REV_PER_DV, FactParams

RESULT_COLUMNS = (
    "total_revenue",
    "total_quantity",
    "average_price",
    "total_order",
    "total_detailview",
    "atc",
    "country_total_cost_per_sku",
    "rev_per_dv",
    "CR",
    "order_percent",
)


def country_facts(
    cells: DataFrame, feature: str, in_scope: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Both metrics, price, share and cost per category and feature value.

    The market is the only place, so order shares are those of the whole country.
    """
    summary = m.feature_summary(in_scope(cells), feature, "market", m.COUNTRY_SUMMED)
    return m.with_order_percent(summary, cells, feature, "market").selectExpr(
        "category",
        "feature_value",
        "sku_count",
        "double(total_revenue) AS total_revenue",
        "total_quantity",
        "total_order",
        "total_detailview",
        "atc",
        "order_percent",
        f"{guarded_ratio('total_revenue', 'total_quantity')} AS average_price",
        f"{guarded_ratio('country_total_cost', 'sku_count')} AS country_total_cost_per_sku",
        f"{m.metric_value(REV_PER_DV)} AS rev_per_dv",
        f"{m.metric_value(CR)} AS CR",
    )


def fact_table(
    cells: DataFrame,
    attributes: DataFrame,
    params: FactParams,
    in_scope: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Gated, labelled country facts in descending order of the chosen metric."""
    feature = params.features.analysed
    metric = m.METRIC_NAMES[params.metric]
    facts = country_facts(cells, feature, in_scope)
    kept = m.gate(facts, params.thresholds, params.metric, metric, "average_price")
    labelled = m.with_label(kept, attributes, feature)
    ranked = labelled.orderBy(F.col(metric).desc(), "category", "feature_value")
    return m.arrange(ranked, feature, RESULT_COLUMNS)

"""Compare the features of one or many places with a baseline.

The place is a grouping key, so comparing one region, ranking all regions and ranking all DMAs
are the same plan: there is no loop over places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.functions.ratios import guarded_ratio, lift, share
from geoaffinity.operators import measures as m
from geoaffinity.params import Thresholds


@dataclass(frozen=True)
class Sides:
    """Aligned cells of both sides, before and after the scope filters.

    ``everything`` holds all cells of the analysed places and only feeds the share
    denominators; ``analysed`` and ``baseline`` are the cells that are compared. Where the
    baseline is the whole market at the analysed level, ``places`` names the analysed ones among
    its cells, so that both sides can be had from one pass over them.
    """

    everything: DataFrame
    analysed: DataFrame
    baseline: DataFrame
    place: str
    places: tuple[str, ...] = ()

    @classmethod
    def build(
        cls,
        cells: DataFrame,
        baseline_cells: DataFrame,
        place: str,
        places: Sequence[str],
        in_scope: Callable[[DataFrame], DataFrame],
        baseline_place: str | None = None,
        baseline_name: str | None = None,
    ) -> Sides:
        """A baseline without name is the whole market, analysed places and null included."""
        everything = cells.filter(F.col(place).isin(*places))
        one_pass = baseline_name is None and baseline_cells is cells
        if baseline_name is not None:
            baseline_cells = baseline_cells.filter(F.col(baseline_place) == baseline_name)
        return cls(
            everything, in_scope(everything), in_scope(baseline_cells), place, tuple(places) if one_pass else ()
        )


def compare_features(sides: Sides, costs: DataFrame, feature: str, metric: str) -> DataFrame:
    """Metrics, lift, order share, score and cost per (place, category, feature value)."""
    keys = ["category", "feature_value"]
    if sides.places:
        summary = m.summary_with_baseline(sides.baseline, feature, metric, sides.place, sides.places)
    else:
        summary = m.feature_summary(sides.analysed, feature, sides.place)
        summary = summary.join(m.baseline_metric(sides.baseline, feature, metric), keys, "left")
    summary = m.with_order_percent(summary, sides.everything, feature, sides.place)
    joined = summary.join(m.cost_by_feature(costs, feature), keys, "left")
    name = m.METRIC_NAMES[metric]
    analysed, baseline = f"{name}_analysed", f"{name}_baseline"
    return joined.selectExpr(
        sides.place,
        *keys,
        "sku_count",
        "double(total_revenue) AS total_revenue",
        "total_quantity",
        "total_order",
        "total_detailview",
        "order_percent",
        f"{guarded_ratio('total_revenue', 'total_quantity')} AS average_price_analysed",
        f"{share('country_total_cost', 'sku_count')} AS country_total_cost_per_sku",
        f"{m.metric_value(metric)} AS {analysed}",
        f"coalesce(metric_baseline, 0D) AS {baseline}",
    ).selectExpr(
        "*",
        f"{lift(analysed, baseline)} AS metric_diff_percent",
        "metric_diff_percent * order_percent AS weighted_score",
    )


def gated(rows: DataFrame, thresholds: Thresholds, metric: str) -> DataFrame:
    """Apply the thresholds to a comparison."""
    column = f"{m.METRIC_NAMES[metric]}_analysed"
    return m.gate(rows, thresholds, metric, column, "average_price_analysed")


def result_columns(metric: str) -> list[str]:
    """Measure columns of a comparison, in their final order."""
    name = m.METRIC_NAMES[metric]
    return [
        "total_revenue",
        "total_quantity",
        "average_price_analysed",
        "total_order",
        "total_detailview",
        "country_total_cost_per_sku",
        f"{name}_analysed",
        f"{name}_baseline",
        "metric_diff_percent",
        "order_percent",
        "weighted_score",
    ]

"""Welch's test of daily metric values, analysed against baseline, for every feature at once.

Two groups reduce Welch's ANOVA to F = t^2 with 1 and v degrees of freedom, which needs only
the number, mean and variance of each group: grouped moments, no loop and no Python function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.functions.student_t import two_sided_p
from geoaffinity.functions.text import SMALL_SAMPLE_NOTE
from geoaffinity.operators.compare import Sides
from geoaffinity.operators.measures import NUMERATORS, beside_whole, both_levels, keyed, metric_value, sums

KEYS = ("category", "feature_value")
_MOMENTS = ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")


def daily_metric(
    cells: DataFrame,
    feature: str,
    metric: str,
    place: str | None = None,
    literal_days: bool = False,
) -> DataFrame:
    """Metric per (place,) category, feature value and day; undefined values are 0.

    With ``literal_days`` the cells that only have views form an observation of their own, so
    that one day can count twice.
    """
    keys = [*([place] if place else []), *KEYS, "order_date"]
    grouping = [*keys, F.expr("total_order = 0").alias("is_view_only")] if literal_days else keys
    return (
        keyed(cells, feature)
        .groupBy(*grouping)
        .agg(*sums(NUMERATORS[metric], "total_detailview"))
        .selectExpr(*keys, f"{metric_value(metric)} AS value")
    )


def moments(daily: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Size, mean and sample variance per key; a constant group has variance 0 exactly."""
    return daily.groupBy(*keys).agg(
        F.count("value").alias(f"n_{side}"),
        F.avg("value").alias(f"mean_{side}"),
        F.expr(
            f"IF(min(value) = max(value), IF(count(value) > 1, 0D, NULL), var_samp(value)) AS var_{side}"
        ),
    )


def both_moments(sides: Sides, feature: str, metric: str, literal_days: bool = False) -> DataFrame:
    """Moments of both groups per place, category and feature value of the analysed cells."""
    placed = [sides.place, *KEYS]
    if not sides.places:
        analysed = daily_metric(sides.analysed, feature, metric, sides.place, literal_days)
        baseline = daily_metric(sides.baseline, feature, metric, None, literal_days)
        return moments(analysed, placed, "a").join(moments(baseline, KEYS, "b"), list(KEYS), "left")
    cells, days = keyed(sides.baseline, feature), ["order_date"]
    if literal_days:
        cells, days = cells.selectExpr("*", "total_order = 0 AS is_view_only"), [*days, "is_view_only"]
    daily = both_levels(cells, KEYS, sides.place, sums(NUMERATORS[metric], "total_detailview"), days)
    daily = daily.selectExpr(*placed, "whole", f"{metric_value(metric)} AS value")
    levels = moments(daily, [*placed, "whole"], "a")
    of_whole = {f"{name}_b": F.col(f"{name}_a") for name in ("n", "mean", "var")}
    return beside_whole(levels, list(KEYS), sides.place, sides.places, of_whole)


def with_moments(
    rows: DataFrame, sides: Sides, feature: str, metric: str, literal_days: bool = False
) -> DataFrame:
    """Left-join both groups' moments to rows keyed by place, category and feature value."""
    found = both_moments(sides, feature, metric, literal_days)
    return rows.join(found, [sides.place, *KEYS], "left")


def with_test_statistics(rows: DataFrame) -> DataFrame:
    """Add t^2 and the degrees of freedom to joined moments.

    The test is undefined, hence null, if a group is missing, has one value or is constant.
    """
    return (
        rows.selectExpr(
            "*",
            "n_a >= 2 AND n_b >= 2 AND var_a > 0 AND var_b > 0 AS possible",
            "var_a / n_a AS error_a",
            "var_b / n_b AS error_b",
        )
        .selectExpr(
            *rows.columns,
            "IF(possible, pow(mean_a - mean_b, 2) / (error_a + error_b), NULL) AS t_squared",
            """IF(possible, pow(error_a + error_b, 2)
                / (pow(error_a, 2) / (n_a - 1) + pow(error_b, 2) / (n_b - 1)), NULL) AS df""",
        )
    )


def with_p_value(rows: DataFrame) -> DataFrame:
    """Turn joined moments into ``p_value`` and ``p_note``."""
    kept = [name for name in rows.columns if name not in _MOMENTS]
    return (
        with_test_statistics(rows)
        .select(*kept, two_sided_p("t_squared", "df").alias("p_value"))
        .selectExpr("*", f"IF(p_value IS NULL, '{SMALL_SAMPLE_NOTE}', NULL) AS p_note")
    )


def welch_table(
    sides: Sides, feature: str, metric: str, literal_days: bool = False
) -> DataFrame:
    """p-value of every (place, category, feature value) present in the analysed cells."""
    found = with_p_value(both_moments(sides, feature, metric, literal_days))
    return found.select(sides.place, *KEYS, "p_value", "p_note")

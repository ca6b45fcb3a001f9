"""Welch's test and the Student-t tail against direct numerical work."""

import math
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoaffinity.functions.student_t import two_sided_p
from geoaffinity.operators.compare import Sides
from geoaffinity.operators.welch import daily_metric, welch_table
from tests.handmade import MAY


def integrated_p(t_squared: float, df: float, points: int = 200_001) -> float:
    """Tail of the t density by Simpson's rule after x = sqrt(df) * tan(angle)."""
    angle = math.atan2(math.sqrt(df), math.sqrt(t_squared))
    power = max(1.0, 6.0 / df)
    w = np.linspace(0, 1, points)
    values = np.zeros(points)
    phi = angle * w[1:] ** power
    values[1:] = np.sin(phi) ** (df - 1) * angle * power * w[1:] ** (power - 1)
    weights = np.ones(points)
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    area = float((weights * values).sum()) / (3 * (points - 1))
    return 2 * area / (math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2)))


def test_tail_agrees_with_integration(spark):
    cases = [
        (t2, df)
        for t2 in (1e-8, 1e-3, 0.1, 0.5, 1.0, 2.228**2, 9.0, 30.0, 81.0, 400.0)
        for df in (1.0, 1.3, 2.0, 2.5, 7.7, 10.0, 60.0, 350.0, 5000.0)
    ]
    frame = spark.createDataFrame(cases, "t2 double, df double")
    for row in frame.withColumn("p", two_sided_p("t2", "df")).collect():
        assert row["p"] == pytest.approx(integrated_p(row["t2"], row["df"]), rel=1e-8), row


def test_tail_at_known_points_and_nulls(spark):
    frame = spark.createDataFrame(
        [(2.228138852**2, 10.0), (1.0, 1.0), (0.0, 5.0), (None, 5.0), (1.0, None)], "t2 double, df double"
    )
    p = [row["p"] for row in frame.withColumn("p", two_sided_p("t2", "df")).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-9)
    assert p[1] == pytest.approx(0.5, abs=1e-12)
    assert p[2:] == [1.0, None, None]


def series(spark, analysed, baseline):
    """Sides whose daily revenue per view of one category is the given list of values."""

    def cells(values):
        data = [("W", "A", "Sofa", MAY[i], float(v), 1, 1) for i, v in enumerate(values)]
        return spark.createDataFrame(
            data,
            "region string, market_sku string, category string, order_date date, "
            "total_revenue double, total_order long, total_detailview long",
        )

    everything = cells(analysed)
    return Sides(everything, everything, cells(baseline), "region")


def row_of(spark, analysed, baseline):
    found = welch_table(series(spark, analysed, baseline), "category", "Rev per DV").collect()
    return found[0] if found else None


def by_hand(a, b):
    """Welch's two-sample p-value from its textbook formula."""
    ea, eb = statistics.variance(a) / len(a), statistics.variance(b) / len(b)
    t2 = (statistics.fmean(a) - statistics.fmean(b)) ** 2 / (ea + eb)
    df = (ea + eb) ** 2 / (ea**2 / (len(a) - 1) + eb**2 / (len(b) - 1))
    return integrated_p(t2, df)


def test_two_ordinary_groups(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8]
    row = row_of(spark, a, b)
    assert row["p_value"] == pytest.approx(by_hand(a, b), rel=1e-9)
    assert row["p_note"] is None


@pytest.mark.parametrize(
    ("analysed", "baseline"),
    [([1], [1, 2, 3]), ([2, 2, 2], [1, 2, 3]), ([1, 2, 3], []), ([1, 2, 3], [5, 5]), ([1, 2], [4])],
)
def test_undefined_tests_carry_a_note(spark, analysed, baseline):
    row = row_of(spark, analysed, baseline)
    assert row["p_value"] is None
    assert row["p_note"] == "Sample size too small to conduct ANOVA"


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.integers(0, 50), min_size=3, max_size=8, unique=True),
    st.lists(st.integers(0, 50), min_size=3, max_size=8, unique=True),
)
def test_symmetric_and_free_of_scale(spark, a, b):
    p = row_of(spark, a, b)["p_value"]
    assert row_of(spark, b, a)["p_value"] == pytest.approx(p, rel=1e-9)
    scaled = row_of(spark, [8 * x for x in a], [8 * x for x in b])["p_value"]
    assert scaled == pytest.approx(p, rel=1e-9)
    assert p == pytest.approx(by_hand(a, b), rel=1e-7)


def test_view_only_cells_can_form_days_of_their_own(spark):
    cells = spark.createDataFrame(
        [("A", "Sofa", MAY[0], 100.0, 2, 10), ("B", "Sofa", MAY[0], 0.0, 0, 40)],
        "market_sku string, category string, order_date date, total_revenue double, "
        "total_order long, total_detailview long",
    )
    plain = [r["value"] for r in daily_metric(cells, "category", "Rev per DV").collect()]
    literal = [r["value"] for r in daily_metric(cells, "category", "Rev per DV", literal_days=True).collect()]
    assert plain == [2.0]
    assert sorted(literal) == [0.0, 10.0]

import datetime as dt

import pytest

from geoaffinity.params import (
    CR,
    DMA_LEVEL,
    REV_PER_DV,
    CompareParams,
    RankParams,
    Scope,
    Thresholds,
    TwoFeatures,
    option_dimensions,
)

SCOPE = Scope("US", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
AU = Scope("AU", dt.date(2024, 1, 1), dt.date(2024, 1, 2))


def test_end_before_start_is_refused():
    with pytest.raises(ValueError, match="end date"):
        Scope("US", dt.date(2024, 1, 2), dt.date(2024, 1, 1))


def test_times_are_refused_as_dates():
    with pytest.raises(ValueError, match="plain dates"):
        Scope("US", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))


def test_default_period_starts_with_the_year():
    assert Scope().start == dt.date(dt.date.today().year, 1, 1)
    assert Scope().end == dt.date.today()


@pytest.mark.parametrize(
    "arguments",
    [
        {"analysed": "AU Perth", "baseline": "US All"},
        {"analysed": "US West", "baseline": "AU All"},
        {"analysed": "US West", "baseline": "US All", "feature": "price"},
        {"analysed": "US West", "baseline": "US All", "metric": "Views"},
        {"analysed": "US West", "baseline": "US All", "limit": 0},
        {"analysed": "US West", "baseline": "US All", "limit": 101},
        {"analysed": "US West", "baseline": "US All", "rank": "Middle"},
        {"analysed": "US West", "baseline": "US All", "level": DMA_LEVEL},
        {"analysed": "New York, NY", "baseline": "US All", "level": DMA_LEVEL, "baseline_level": DMA_LEVEL},
        {"analysed": "US West", "baseline": "US All", "options": {"color_tone": ("Grey",)}},
    ],
)
def test_comparison_parameters_are_checked(arguments):
    with pytest.raises(ValueError):
        CompareParams(SCOPE, **arguments)


def test_australia_has_no_dma_level():
    with pytest.raises(ValueError, match="level"):
        RankParams(AU, level=DMA_LEVEL)
    assert RankParams(AU).places == ("AU Sydney", "AU Melbourne", "AU Perth")


def test_second_feature_depends_on_the_first_and_becomes_the_analysed_one():
    with pytest.raises(ValueError, match="second feature"):
        TwoFeatures("market_spu", "category")
    assert TwoFeatures("collection", "market_sku").analysed == "market_sku"
    assert TwoFeatures("collection").analysed == "collection"
    assert TwoFeatures("market_sku").options == {"market_sku": ()}


def test_conversion_threshold_is_a_percentage():
    assert Thresholds(metric=0.08).metric_floor(CR) == pytest.approx(0.0008)
    assert Thresholds(metric=0.08).metric_floor(REV_PER_DV) == 0.08
    with pytest.raises(ValueError):
        Thresholds(orders=-1)


def test_option_dimensions():
    assert option_dimensions("color_tone")[-1] == "color_tone"
    assert option_dimensions("market_sku") == ("category", "subcategory", "collection")

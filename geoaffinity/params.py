"""Validated parameters of the three analyses."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

# The markets, places, features and metrics a user can name.
MARKETS = ("US", "AU")
REGIONS = {
    "US": ("US West", "US East", "US Southeast", "US Northwest"),
    "AU": ("AU Sydney", "AU Melbourne", "AU Perth"),
}
DMAS = (
    "New York, NY",
    "Los Angeles CA",
    "Washington DC (Hagerstown MD)",
    "San Francisco-Oakland-San Jose CA",
    "Seattle-Tacoma WA",
)
FEATURES = (
    "market_sku",
    "market_spu",
    "category",
    "subcategory",
    "collection",
    "color_tone",
    "material_helper",
)
SECOND_FEATURES = {
    "category": (
        "market_sku",
        "market_spu",
        "subcategory",
        "collection",
        "color_tone",
        "material_helper",
    ),
    "subcategory": ("market_sku", "market_spu", "collection", "color_tone", "material_helper"),
    "collection": (
        "category",
        "subcategory",
        "market_sku",
        "market_spu",
        "color_tone",
        "material_helper",
    ),
    "market_spu": ("market_sku",),
    "color_tone": ("market_sku",),
    "material_helper": ("market_sku",),
    "market_sku": (),
}
REV_PER_DV = "Rev per DV"
CR = "CR"
METRICS = (REV_PER_DV, CR)
REGIONAL = "Regional Level"
DMA_LEVEL = "DMA Level"
COUNTRY_AND_REGIONAL = "Country & Regional Level"
NO_SELECTION = "No Selection"
TOP, BOTTOM = "Top", "Bottom"

# Option lists offered whatever the feature is; color_tone and material_helper lists are
# offered only when they are the analysed feature.
COMMON_OPTIONS = ("category", "subcategory", "collection")


def _one_of(name: str, value: str, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")


def _this_year() -> dt.date:
    return dt.date(dt.date.today().year, 1, 1)


@dataclass(frozen=True)
class Thresholds:
    """Minimum values of the four control metrics.

    ``metric`` is in the unit a user enters: a plain ratio for revenue per view and a
    percentage for conversion.
    """

    cost_per_sku: float = 100
    metric: float = 0
    orders: float = 10
    price: float = 100

    def __post_init__(self):
        if min(self.cost_per_sku, self.metric, self.orders, self.price) < 0:
            raise ValueError("thresholds must not be negative")

    def metric_floor(self, metric: str) -> float:
        return self.metric / 100.0 if metric == CR else self.metric


@dataclass(frozen=True)
class Scope:
    """Market and inclusive date range every analysis needs."""

    market: str = "US"
    start: dt.date = field(default_factory=_this_year)
    end: dt.date = field(default_factory=dt.date.today)

    def __post_init__(self):
        _one_of("market", self.market, MARKETS)
        if type(self.start) is not dt.date or type(self.end) is not dt.date:
            raise ValueError("start and end must be plain dates")
        if self.end < self.start:
            raise ValueError("end date must not be before start date")

    @property
    def all_name(self) -> str:
        return f"{self.market} All"


@dataclass(frozen=True)
class CompareParams:
    """Which features does one place prefer against a baseline?"""

    scope: Scope
    analysed: str
    baseline: str
    feature: str = "market_sku"
    metric: str = REV_PER_DV
    level: str = REGIONAL
    baseline_level: str = COUNTRY_AND_REGIONAL
    rank: str = TOP
    limit: int = 30
    thresholds: Thresholds = Thresholds()
    options: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        market = self.scope.market
        _one_of("metric", self.metric, METRICS)
        _one_of("feature", self.feature, FEATURES)
        _one_of("rank", self.rank, (TOP, BOTTOM))
        _one_of("level", self.level, _levels(market))
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must lie between 1 and 100")
        regional_baselines = (self.scope.all_name, *REGIONS[market])
        if self.level == REGIONAL:
            _one_of("analysed", self.analysed, REGIONS[market])
            _one_of("baseline", self.baseline, regional_baselines)
        else:
            _one_of("analysed", self.analysed, DMAS)
            _one_of("baseline_level", self.baseline_level, (COUNTRY_AND_REGIONAL, DMA_LEVEL))
            by_dma = self.baseline_level == DMA_LEVEL
            _one_of("baseline", self.baseline, DMAS if by_dma else regional_baselines)
        for dimension in self.options:
            _one_of("options", dimension, option_dimensions(self.feature))


@dataclass(frozen=True)
class TwoFeatures:
    """A first feature that filters and an optional second one that is then analysed."""

    first: str = "category"
    second: str = NO_SELECTION
    first_values: tuple[str, ...] = ()
    second_values: tuple[str, ...] = ()

    def __post_init__(self):
        _one_of("first feature", self.first, FEATURES)
        _one_of("second feature", self.second, (NO_SELECTION, *SECOND_FEATURES[self.first]))

    @property
    def analysed(self) -> str:
        return self.first if self.second == NO_SELECTION else self.second

    @property
    def options(self) -> dict[str, tuple[str, ...]]:
        chosen = {self.first: tuple(self.first_values)}
        if self.second != NO_SELECTION:
            chosen[self.second] = tuple(self.second_values)
        return chosen


@dataclass(frozen=True)
class RankParams:
    """Which place prefers the chosen features?"""

    scope: Scope
    features: TwoFeatures = TwoFeatures()
    metric: str = REV_PER_DV
    level: str = REGIONAL
    thresholds: Thresholds = Thresholds()

    def __post_init__(self):
        _one_of("metric", self.metric, METRICS)
        _one_of("level", self.level, _levels(self.scope.market))

    @property
    def places(self) -> tuple[str, ...]:
        return REGIONS[self.scope.market] if self.level == REGIONAL else DMAS


@dataclass(frozen=True)
class FactParams:
    """How do the chosen features perform in the whole country?"""

    scope: Scope
    features: TwoFeatures = TwoFeatures()
    metric: str = REV_PER_DV
    thresholds: Thresholds = Thresholds()

    def __post_init__(self):
        _one_of("metric", self.metric, METRICS)


def _levels(market: str) -> tuple[str, ...]:
    return (REGIONAL, DMA_LEVEL) if market == "US" else (REGIONAL,)


def option_dimensions(feature: str) -> tuple[str, ...]:
    """Dimensions whose option lists apply when ``feature`` is analysed."""
    extra = (feature,) if feature in ("color_tone", "material_helper") else ()
    return COMMON_OPTIONS + extra

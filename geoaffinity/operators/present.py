"""Result tables as an analyst reads them: formatted numbers under display names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoaffinity.functions import text
from geoaffinity.params import TwoFeatures

# How each column is formatted and named.
_FORMATS = {
    text.thousands: ("sku_count", "total_quantity", "total_order", "total_detailview", "atc"),
    text.dollars: (
        "total_revenue",
        "average_price_analysed",
        "average_price",
        "country_total_cost_per_sku",
    ),
    text.two_decimals: ("rev_per_dv_analysed", "rev_per_dv_baseline", "rev_per_dv"),
    text.p_value: ("p_value",),
    text.percent: (
        "CR_analysed",
        "CR_baseline",
        "CR",
        "metric_diff_percent",
        "order_percent",
        "weighted_score",
    ),
}
_DISPLAY_NAMES = {
    "market_sku": "Market SKU",
    "sku_name": "SKU Name",
    "market_spu": "Market SPU",
    "spu_name": "SPU Name",
    "category": "Category",
    "collection": "Collection",
    "subcategory": "Subcategory",
    "color_tone": "Color Tone",
    "material_helper": "Material Helper",
    "cate-feature": "Category: Feature",
    "sku_count": "SKU Count",
    "total_revenue": "Revenue_Analysed",
    "total_quantity": "Quantity_Analysed",
    "average_price_analysed": "Ave. Price_Analysed",
    "average_price": "Ave. Price",
    "total_order": "Order_Analysed",
    "total_detailview": "Detailview_Analysed",
    "atc": "ATC_Analysed",
    "country_total_cost_per_sku": "Country Average Cost per SKU",
    "rev_per_dv_analysed": "Rev/DV_Analysed",
    "rev_per_dv_baseline": "Rev/DV_Baseline",
    "rev_per_dv": "Rev/DV",
    "CR_analysed": "CR_Analysed",
    "CR_baseline": "CR_Baseline",
    "CR": "CR",
    "metric_diff_percent": "%Metric Difference",
    "order_percent": "%Order",
    "weighted_score": "Weighted Score",
    "p_value": "P-Value",
}
_KEY_DROPPED_FOR = ("market_sku", "market_spu", "category", "subcategory", "collection")


def format_basic(result: DataFrame, feature: str) -> DataFrame:
    """Format numbers and rename columns; unknown numbers stay null.

    The combined key is dropped where the feature column alone says as much.
    """
    formats = {name: make for make, names in _FORMATS.items() for name in names}
    shown = [
        name
        for name in result.columns
        if name != "p_note" and not (name == "cate-feature" and feature in _KEY_DROPPED_FOR)
    ]
    return result.selectExpr(
        *[
            f"{formats[name](name) if name in formats else f'`{name}`'}"
            f" AS `{_DISPLAY_NAMES.get(name, name)}`"
            for name in shown
        ]
    )


def format_two_feature(result: DataFrame, features: TwoFeatures) -> DataFrame:
    """The same for a two-feature analysis: the second feature decides if there is one."""
    return format_basic(result, features.analysed)

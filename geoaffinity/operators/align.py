"""Bring order, view and cost measures onto one row per (market SKU, place, day).

A full outer join on nullable keys is written as a tagged union folded by one aggregation:
null places meet each other exactly once, the measures of a missing side are 0, and map-side sums
replace the join. The fold is of narrow rows; attributes are joined once, to what it leaves, and
only those that a caller reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.schemas import ATTRIBUTES, PROTECTION_SUBCATEGORY, SWATCH_CATEGORY

ORDER_MEASURES = ("total_revenue", "total_quantity", "total_order")


def key_union(orders: DataFrame, views: DataFrame, place: str | None) -> DataFrame:
    """Distinct keys seen in either cell set."""
    keys = ["market_sku", *([place] if place else []), "order_date"]
    return orders.select(keys).unionByName(views.select(keys)).distinct()


def align(
    orders: DataFrame, views: DataFrame, attributes: DataFrame, market: str, place: str
) -> DataFrame:
    """Cells of one place level from its order and view measures."""
    keys = [place, "market_sku", "order_date"]
    folded = _fold([(orders, "sold"), (views, "seen")], keys)
    return _cells(folded, attributes, market, keys, "total_detailview")


def align_country(
    orders: DataFrame, views: DataFrame, costs: DataFrame, attributes: DataFrame, market: str
) -> DataFrame:
    """Country cells with the cost of their SKU and day.

    Cost of a SKU and day without orders and views drops out, as a left join would do.
    """
    keys = ["market_sku", "order_date"]
    folded = _fold([(orders, "sold"), (views, "seen"), (costs, None)], keys)
    return _cells(folded, attributes, market, keys, "total_detailview", "atc", "country_total_cost")


def _cells(folded: DataFrame, attributes: DataFrame, market: str, keys: list[str], *others: str) -> DataFrame:
    """Goods that were sold or seen; protection plans and goods without subcategory are not sold."""
    sold = f"(sold AND coalesce(subcategory <> '{PROTECTION_SUBCATEGORY}', false))"
    measures = [f"IF({sold}, {name}, 0) AS {name}" for name in ORDER_MEASURES]
    kinds = dict(folded.dtypes)
    return (
        folded.join(attributes, "market_sku")
        .filter(f"category <> '{SWATCH_CATEGORY}' AND ({sold} OR seen)")
        .selectExpr(f"'{market}' AS market", *keys, *ATTRIBUTES, *measures, *others)
        .selectExpr(
            "market", *keys, *ATTRIBUTES, *[f"CAST({n} AS {kinds[n]}) AS {n}" for n in (*ORDER_MEASURES, *others)]
        )
    )


def _fold(parts: list[tuple[DataFrame, str | None]], keys: list[str]) -> DataFrame:
    """Union the parts, zero-filling the measures a part lacks, and sum per key.

    The flags ``sold`` and ``seen`` say whether the part so named holds the key.
    """
    kinds = {name: kind for part, _ in parts for name, kind in part.dtypes if name not in keys}

    def widen(part: DataFrame, flag: str | None) -> DataFrame:
        zero = [
            name if name in part.columns else f"CAST(0 AS {kind}) AS {name}"
            for name, kind in kinds.items()
        ]
        return part.selectExpr(*keys, *zero, f"{flag == 'sold'} AS sold", f"{flag == 'seen'} AS seen")

    union = widen(*parts[0])
    for part in parts[1:]:
        union = union.union(widen(*part))
    sums = [F.expr(f"coalesce(sum({name}), 0) AS {name}") for name in kinds]
    return union.groupBy(*keys).agg(*sums, F.expr("bool_or(sold) AS sold"), F.expr("bool_or(seen) AS seen"))

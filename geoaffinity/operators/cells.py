"""Daily cells: facts aggregated to (market SKU, place, day).

Facts are reduced to cells before any dimension is joined.  A cell table has at most
SKUs x places x days rows, so the dimension joins never shuffle fact rows, and a SKU or place
that holds a large part of the fact is folded by the partial aggregation on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from geoaffinity.params import DMAS, Scope
from geoaffinity.schemas import (
    ATTRIBUTES,
    MATERIAL_PROPERTY,
    ORDER_DAY,
    OVERSEAS_REGION,
    PROTECTION_SUBCATEGORY,
    SWATCH_CATEGORY,
)
from geoaffinity.sources.fetch import fetch
from geoaffinity.sources.star import StarTables

REGION, DMA, COUNTRY = "region", "dma", None
_DAY_MICROS = 86_400_000_000


def sku_attributes(star: StarTables) -> DataFrame:
    """One row per SKU with its nine attributes.

    The material comes from the SKU's own property, else from its SPU's; where a property is
    stored more than once the smallest value is taken, so sales are never multiplied.
    """

    def material(table: DataFrame, key: str, alias: str) -> DataFrame:
        return (
            table.filter(f"property_type = '{MATERIAL_PROPERTY}'")
            .groupBy(key)
            .agg(F.min("value").alias(alias))
        )

    # By SKU last: cells join the result by SKU, then without another exchange of it.
    return (
        star.dim_sku.join(material(star.dim_spu_property, "market_spu", "of_spu"), "market_spu", "left")
        .join(material(star.dim_sku_property, "market_sku", "of_sku"), "market_sku", "left")
        .selectExpr(
            "market_sku", *ATTRIBUTES[:-1], "coalesce(of_sku, of_spu) AS material_helper"
        )
    )


def order_day(star: StarTables) -> tuple[str, str]:
    """A paid order's day in the warehouse's time zone, and a scope's condition on its time.

    Times without zone are the warehouse's own. Zoned ones are instants: the condition compares
    them with the instants at which the zone's days begin, so it reaches the scan, and the day is
    counted from the zone's offset at that instant; neither depends on the session's zone.
    """
    time = "payment_completion_time"
    if not isinstance(star.fact_saleorder.schema[time].dataType, TimestampType):
        day = f"to_date({time})"
        return day, f"{day} BETWEEN :start AND :end"
    local = f"unix_micros(from_utc_timestamp({time}, '{star.zone}'))"
    day = f"date_from_unix_date(int(({local} - pmod({local}, {_DAY_MICROS})) div {_DAY_MICROS}))"
    begins = f"CAST(date_format({{}}, 'yyyy-MM-dd') || ' 00:00:00 {star.zone}' AS TIMESTAMP)"
    return day, (
        f"{time} >= {begins.format(':start')} AND {time} < {begins.format('date_add(:end, 1)')}"
    )


def sales_orders(star: StarTables, scope: Scope) -> DataFrame:
    """Completed web orders for goods of one market and period."""
    day, in_period = order_day(star)
    stored = [name for name in star.order_partitions if name != "market"]
    if ORDER_DAY in stored:
        in_period += f" AND {ORDER_DAY} BETWEEN :start AND :end"
    return fetch(
        f"""SELECT spree_so_id, {day} AS order_date, market, region, shipping_zip_code
        {"".join(f", {name}" for name in stored)}
        FROM {{facts}}
        WHERE spree_channel = 'web' AND market = :market
          AND classification = 'complete' AND order_type = 'Goods'
          AND pure_swatch_order_flag = 'N' AND {in_period}""",
        star.fact_saleorder,
        scope,
    )


def place_orders(star: StarTables, orders: DataFrame, place: str | None) -> DataFrame:
    """Reduce orders to number, day and place; DMA orders outside the five DMAs drop out."""
    if place == DMA:
        dmas = star.dim_dma.filter(_is_dma("ga_dma"))
        zips = star.helper_us_census.join(dmas, "dma_code").selectExpr(
            "zip AS shipping_zip_code", f"ga_dma AS {DMA}"
        )
        orders = orders.join(zips, "shipping_zip_code")
    return orders.select(
        "spree_so_id", *star.order_partitions, "order_date", *_place_columns(place)
    )


def order_measures(star: StarTables, scope: Scope, place: str | None) -> DataFrame:
    """Revenue, quantity and number of orders per SKU, place and day, without attributes.

    Lines meet their orders first, in one shuffle by order number (none if both are bucketed by
    it), so lines of other periods and markets go no further. Where both are stored by market and
    day these join too: lines of other markets and days are then not even read. Spark splits the
    partition of an order that holds a large part of all lines. Kept cells are read instead of
    facts where the star has them.
    """
    if star.kept is not None:
        return star.kept.order_measures(scope, place)
    placed = place_orders(star, sales_orders(star, scope), place)
    return (
        star.fact_saleorderline.join(placed, ["spree_so_id", *star.order_partitions])
        .groupBy("market_sku", *_place_columns(place), "order_date")
        .agg(*_order_sums())
    )


def order_levels(star: StarTables, scope: Scope) -> DataFrame:
    """``order_measures`` of all regions and of the five DMAs, from one pass over the lines.

    ``level`` says which of the two ``place`` is. An order has the list of its zip's DMAs, which is
    short, so a line that meets its order once counts at both levels.
    """
    dmas = star.dim_dma.filter(_is_dma("ga_dma"))
    of_zip = star.helper_us_census.join(dmas, "dma_code").groupBy("zip").agg(
        F.collect_list("ga_dma").alias("dmas")
    )
    orders = sales_orders(star, scope)
    placed = orders.join(of_zip, orders.shipping_zip_code == of_zip.zip, "left").select(
        "spree_so_id", *star.order_partitions, "order_date", REGION, "dmas"
    )
    levels = f"""inline(concat(
        array(named_struct('level', '{REGION}', 'place', {REGION})),
        transform(coalesce(dmas, array()), dma -> named_struct('level', '{DMA}', 'place', dma))))"""
    return (
        star.fact_saleorderline.join(placed, ["spree_so_id", *star.order_partitions])
        .selectExpr("spree_so_id", "market_sku", "order_date", "sale_amount", "quantity", levels)
        .groupBy("market_sku", "level", "place", "order_date")
        .agg(*_order_sums())
    )


def order_cells(
    star: StarTables, attributes: DataFrame, scope: Scope, place: str | None
) -> DataFrame:
    """Order cells of sellable goods with their attributes."""
    goods = _real_goods(attributes).filter(f"subcategory <> '{PROTECTION_SUBCATEGORY}'")
    return (
        order_measures(star, scope, place)
        .join(goods, "market_sku")
        .selectExpr(
            *_keys(place, scope), *ATTRIBUTES, "total_revenue", "total_quantity", "total_order"
        )
    )


def view_measures(
    star: StarTables, scope: Scope, place: str | None, include_overseas: bool = False
) -> DataFrame:
    """Product views per SKU, place and day, without attributes; the country also counts cart additions."""
    measures = _view_columns(place)
    if star.kept is not None:
        views = star.kept.views(scope, place)
    elif place == DMA:
        views = fetch(
            f"""SELECT market_sku, metro AS {DMA}, date AS order_date, product_view FROM {{facts}}
            WHERE market = :market AND date BETWEEN :start AND :end""",
            star.fact_dma_product_daily_onsite_metric,
            scope,
        )
    else:
        views = fetch(
            """SELECT market_sku, region, date AS order_date, product_view, add_to_cart FROM {facts}
            WHERE market = :market AND date BETWEEN :start AND :end""",
            star.fact_region_product_daily_onsite_metric,
            scope,
        )
    if place == DMA:
        views = views.filter(_is_dma(DMA))
    elif not include_overseas:
        views = views.filter(f"region <> '{OVERSEAS_REGION}'")
    return views.groupBy("market_sku", *_place_columns(place), "order_date").agg(
        *[F.sum(column).alias(name) for name, column in measures.items()]
    )


def view_cells(
    star: StarTables,
    attributes: DataFrame,
    scope: Scope,
    place: str | None,
    include_overseas: bool = False,
) -> DataFrame:
    """View cells of goods with their attributes."""
    return (
        view_measures(star, scope, place, include_overseas)
        .join(_real_goods(attributes), "market_sku")
        .selectExpr(*_keys(place, scope), *ATTRIBUTES, *_view_columns(place))
    )


def cost_measures(star: StarTables, scope: Scope, by_day: bool = False) -> DataFrame:
    """Advertising cost per SKU (and day), without attributes."""
    costs = fetch(
        """SELECT market_sku, date AS order_date, cost FROM {facts}
        WHERE market = :market AND date BETWEEN :start AND :end""",
        star.fact_product_ads_metric,
        scope,
    )
    return costs.groupBy("market_sku", *(["order_date"] if by_day else [])).agg(
        F.sum("cost").alias("country_total_cost")
    )


def cost_cells(
    star: StarTables, attributes: DataFrame, scope: Scope, by_day: bool = False
) -> DataFrame:
    """Advertising cost per SKU (and day) of the whole market, swatches and all."""
    costs = cost_measures(star, scope, by_day)
    return costs.join(attributes, "market_sku", "left").select(
        *costs.columns[:-1], *ATTRIBUTES, "country_total_cost"
    )


def _order_sums() -> list[Column]:
    return [
        F.sum("sale_amount").alias("total_revenue"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("spree_so_id").alias("total_order"),
    ]


def _view_columns(place: str | None) -> dict[str, str]:
    views = {"total_detailview": "product_view"}
    return views if place else {**views, "atc": "add_to_cart"}


def _real_goods(attributes: DataFrame) -> DataFrame:
    """Swatches and SKUs without category are out."""
    return attributes.filter(f"category <> '{SWATCH_CATEGORY}'")


def _is_dma(column: str) -> str:
    return f"{column} IN ({', '.join(repr(name) for name in DMAS)})"


def _place_columns(place: str | None) -> list[str]:
    return [place] if place else []


def _keys(place: str | None, scope: Scope) -> list[str]:
    return [f"'{scope.market}' AS market", *_place_columns(place), "market_sku", "order_date"]

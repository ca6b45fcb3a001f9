"""A small hand-made star whose expected numbers can be worked out on paper."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from geoaffinity.params import Scope
from geoaffinity.schemas import STAR_SCHEMAS
from geoaffinity.sources.star import StarTables

MAY = [dt.date(2024, 5, day) for day in range(1, 32)]
SCOPE = Scope("US", MAY[0], MAY[9])


def sku(code, spu="P1", category="Sofa", subcategory="Fabric Sofa", collection="Ash", name=None, **other):
    return {
        "market_sku": code,
        "sku_name": name or f"name {code}",
        "market_spu": spu,
        "spu_name": other.pop("spu_name", f"family {spu}"),
        "master_category": "All",
        "category": category,
        "subcategory": subcategory,
        "collection": collection,
        "color_tone": other.pop("color_tone", "Grey"),
    }


def order(number, region="US West", day=MAY[0], zip_code="Z1", **other):
    return {
        "spree_so_id": number,
        "market": "US",
        "region": region,
        "payment_completion_time": dt.datetime.combine(day, dt.time(23, 59, 59)),
        "spree_channel": "web",
        "classification": "complete",
        "order_type": "Goods",
        "pure_swatch_order_flag": "N",
        "shipping_zip_code": zip_code,
        **other,
    }


def line(number, code, amount, quantity=1):
    return {
        "spree_so_id": number,
        "market_sku": code,
        "sale_amount": Decimal(str(amount)),
        "quantity": quantity,
    }


def view(code, views, region="US West", day=MAY[0], carts=0, market="US"):
    return {
        "market": market,
        "date": day,
        "region": region,
        "market_sku": code,
        "product_view": views,
        "add_to_cart": carts,
    }


def dma_view(code, views, metro, day=MAY[0]):
    return {"market": "US", "date": day, "metro": metro, "market_sku": code, "product_view": views}


def cost(code, amount, day=MAY[0]):
    return {"market": "US", "date": day, "market_sku": code, "cost": Decimal(str(amount))}


def material(code, value, key="market_sku"):
    return {key: code, "property_type": "Material Helper", "value": value}


def star(spark, **tables) -> StarTables:
    """Tables given by their full or short name; the others are empty."""
    short = {
        "orders": "fact_saleorder",
        "lines": "fact_saleorderline",
        "skus": "dim_sku",
        "views": "fact_region_product_daily_onsite_metric",
        "dma_views": "fact_dma_product_daily_onsite_metric",
        "costs": "fact_product_ads_metric",
    }
    named = {short.get(name, name): rows for name, rows in tables.items()}

    def read(name):
        schema = STAR_SCHEMAS[name]
        rows = [tuple(row.get(f) for f in schema.fieldNames()) for row in named.get(name, [])]
        return spark.createDataFrame(rows, schema)

    return StarTables(read)


def rows(df, *keys):
    """Rows as dicts, keyed by the given columns."""
    found = [row.asDict() for row in df.collect()]
    return {tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]: row for row in found}

"""Declared schemas of the retail star and the fixed names the engine works with."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 4)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()

# Names printed on an order line are not declared: attributes always come from the SKU
# dimension, so that one SKU has one set of attributes.
STAR_SCHEMAS = {
    "fact_saleorder": _struct(
        spree_so_id=_STRING,
        market=_STRING,
        region=_STRING,
        payment_completion_time=T.TimestampType(),
        spree_channel=_STRING,
        classification=_STRING,
        order_type=_STRING,
        pure_swatch_order_flag=_STRING,
        shipping_zip_code=_STRING,
    ),
    "fact_saleorderline": _struct(
        spree_so_id=_STRING, market_sku=_STRING, sale_amount=_MONEY, quantity=_LONG
    ),
    "dim_sku": _struct(
        market_sku=_STRING,
        sku_name=_STRING,
        market_spu=_STRING,
        spu_name=_STRING,
        master_category=_STRING,
        category=_STRING,
        subcategory=_STRING,
        collection=_STRING,
        color_tone=_STRING,
    ),
    "dim_sku_property": _struct(market_sku=_STRING, property_type=_STRING, value=_STRING),
    "dim_spu_property": _struct(market_spu=_STRING, property_type=_STRING, value=_STRING),
    "helper_us_census": _struct(zip=_STRING, dma_code=_INT),
    "dim_dma": _struct(dma_code=_INT, ga_dma=_STRING),
    "fact_region_product_daily_onsite_metric": _struct(
        market=_STRING,
        date=T.DateType(),
        region=_STRING,
        market_sku=_STRING,
        product_view=_LONG,
        add_to_cart=_LONG,
    ),
    "fact_dma_product_daily_onsite_metric": _struct(
        market=_STRING, date=T.DateType(), metro=_STRING, market_sku=_STRING, product_view=_LONG
    ),
    "fact_product_ads_metric": _struct(
        market=_STRING, date=T.DateType(), market_sku=_STRING, cost=_MONEY
    ),
}

# Columns that orders and lines may be stored by besides; an order and its lines share them. The
# day is that of the payment, in the warehouse's time zone.
ORDER_DAY = "order_day"
ORDER_PARTITIONS = {"market": _STRING, ORDER_DAY: T.DateType()}
ORDER_TABLES = ("fact_saleorder", "fact_saleorderline")

FACT_TABLES = tuple(name for name in STAR_SCHEMAS if name.startswith("fact_"))

PRODUCT_INFO_SCHEMA = _struct(
    market_sku=_STRING,
    market_spu=_STRING,
    category=_STRING,
    subcategory=_STRING,
    collection=_STRING,
    color_tone=_STRING,
    material_helper=_STRING,
)

# One option sheet per entry, with the columns it offers.
OPTION_SHEET_SCHEMAS = {
    "category_subcategory": _struct(category=_STRING, subcategory=_STRING),
    "collection": _struct(collection=_STRING),
    "color_tone": _struct(color_tone=_STRING),
    "material_helper": _struct(material_helper=_STRING),
}

# The attributes of a product, by the names stored in the warehouse.
ATTRIBUTES = (
    "sku_name",
    "market_spu",
    "spu_name",
    "master_category",
    "category",
    "subcategory",
    "collection",
    "color_tone",
    "material_helper",
)

# Names that must equal those stored in the warehouse.
MATERIAL_PROPERTY = "Material Helper"
SWATCH_CATEGORY = "Swatch"
PROTECTION_SUBCATEGORY = "Accident Protection Plan"
OVERSEAS_REGION = "Overseas"


def table_schema(name: str, order_partitions=()) -> T.StructType:
    """A table's declared columns, with those that orders and lines are stored by."""
    declared = STAR_SCHEMAS[name]
    if name not in ORDER_TABLES:
        return declared
    more = {n: ORDER_PARTITIONS[n] for n in order_partitions if n not in declared.fieldNames()}
    return T.StructType([*declared.fields, *_struct(**more).fields])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns, casting only where the stored type differs.

    A timestamp without time zone is accepted as it is: only its date is ever used.
    """
    stored = {field.name: field.dataType for field in df.schema.fields}
    missing = [name for name in schema.fieldNames() if name not in stored]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def column(field: T.StructField) -> str:
        kind = stored[field.name]
        same = kind == field.dataType or (
            isinstance(kind, T.TimestampNTZType) and isinstance(field.dataType, T.TimestampType)
        )
        return field.name if same else f"CAST({field.name} AS {field.dataType.simpleString()}) AS {field.name}"

    return df.selectExpr(*[column(field) for field in schema.fields])

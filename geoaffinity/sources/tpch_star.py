"""Retail star derived from the TPC-H-like test tables (the mapping of FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaffinity.schemas import PRODUCT_INFO_SCHEMA
from geoaffinity.sources.star import StarTables

# Where the nations and world regions of the test tables are placed.
_US_REGIONS = {
    "AFRICA": "US West",
    "AMERICA": "US East",
    "ASIA": "US Southeast",
    "EUROPE": "US Northwest",
    "MIDDLE EAST": "Overseas",
}
_AU_REGIONS = {"AFRICA": "AU Sydney", "AMERICA": "AU Melbourne", "ASIA": "AU Perth"}
_NATION_DMAS = {
    1: "New York, NY",
    0: "Los Angeles CA",
    6: "Washington DC (Hagerstown MD)",
    5: "San Francisco-Oakland-San Jose CA",
    3: "Seattle-Tacoma WA",
}
# The nation whose customers have no region.
_NOWHERE = 7
# The views name one of this many products; they are spread over all products by user.
_VIEWED_NUMBERS = 100
_PERIOD_DAYS = 30
_MONEY = "CAST(CAST({} AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4))"


def tpch_star(spark: SparkSession, folder: str, whole: bool = False) -> StarTables:
    """The ten star tables over ``<folder>/*.parquet``, all lazy.

    whole: no order is a service or a swatch order, every place has its region and every product
    its collection, so that no row of the test tables drops out by values made up for it.
    """
    source = _Source(spark, folder, whole)
    return StarTables(lambda name: getattr(source, name))


def tpch_product_info(attributes: DataFrame) -> DataFrame:
    """The product file of the test data: the SKU dimension itself."""
    return attributes.select(*PRODUCT_INFO_SCHEMA.fieldNames())


def _case(key: str, mapping: dict, default: str) -> str:
    branches = " ".join(f"WHEN {value!r} THEN '{name}'" for value, name in mapping.items())
    return f"CASE {key} {branches} ELSE {default} END"


def _code(number: str) -> str:
    return f"market || '-' || CAST({number} AS STRING)"


class _Source:
    def __init__(self, spark: SparkSession, folder: str, whole: bool = False):
        self._read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
        self._markets = spark.sql("SELECT * FROM VALUES ('US'), ('AU') AS m(market)")
        self._made_up = lambda condition: "false" if whole else condition

    @cached_property
    def _places(self) -> DataFrame:
        us = _case("r_name", _US_REGIONS, "'Overseas'")
        au = _case("r_name", _AU_REGIONS, "'Overseas'")
        return (
            self._read("nation")
            .join(self._read("region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "n_nationkey",
                "IF(n_nationkey < 20, 'US', 'AU') AS market",
                f"IF({self._made_up(f'n_nationkey = {_NOWHERE}')}, NULL, IF(n_nationkey < 20, {us}, {au})) AS region",
                "'Z' || n_nationkey AS zip",
                "n_nationkey + 500 AS dma_code",
                f"{_case('n_nationkey', _NATION_DMAS, 'NULL')} AS metro",
            )
        )

    @cached_property
    def _customers(self) -> DataFrame:
        return (
            self._read("customer")
            .join(self._places, F.expr("c_nationkey = n_nationkey"))
            .select("c_custkey", "market", "region", "zip", "metro")
        )

    @cached_property
    def fact_saleorder(self) -> DataFrame:
        days = f"pmod(datediff(o_orderdate, DATE'1995-01-01'), {_PERIOD_DAYS})"
        return (
            self._read("orders")
            .join(self._customers, F.expr("o_custkey = c_custkey"))
            .selectExpr(
                "CAST(o_orderkey AS STRING) AS spree_so_id",
                "market",
                "region",
                f"CAST(date_add(DATE'2024-01-01', {days}) AS TIMESTAMP_NTZ) AS payment_completion_time",
                "IF(o_orderpriority = '5-LOW', 'app', 'web') AS spree_channel",
                "IF(o_orderstatus = 'P', 'pending', 'complete') AS classification",
                f"IF({self._made_up('o_custkey % 11 = 0')}, 'Service', 'Goods') AS order_type",
                f"IF({self._made_up('o_orderkey % 13 = 0')}, 'Y', 'N') AS pure_swatch_order_flag",
                "zip AS shipping_zip_code",
            )
        )

    @cached_property
    def _sold(self) -> DataFrame:
        """Lines with their order's market and day.

        Lines move once, by order number, and what meets them by it next needs no exchange: they
        are not summed per order and product before, which would deal them twice and hardly make
        them fewer. Money is counted in whole hundredths of a cent, which is exact.
        """
        cents, percent = "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(round({} * 100) AS BIGINT)"
        lines = (
            self._read("lineitem")
            .selectExpr(
                "CAST(l_orderkey AS STRING) AS spree_so_id",
                "l_partkey AS k",
                f"{cents} * (100 - {percent.format('l_discount')}) AS sale_amount",
                "CAST(l_quantity AS BIGINT) AS quantity",
                f"{cents} * {percent.format('l_tax')} AS cost",
            )
        )
        return lines.join(self.fact_saleorder, "spree_so_id").selectExpr(
            "spree_so_id",
            "k",
            "market",
            "payment_completion_time",
            f"{_MONEY.format('sale_amount')} AS sale_amount",
            "quantity",
            "cost",
        )

    @cached_property
    def fact_saleorderline(self) -> DataFrame:
        return self._sold.selectExpr(
            "spree_so_id", f"{_code('k')} AS market_sku", "sale_amount", "quantity"
        )

    @cached_property
    def fact_product_ads_metric(self) -> DataFrame:
        """Cost is summed as whole numbers per product number; names and money come after."""
        return (
            self._sold.selectExpr("market", "to_date(payment_completion_time) AS date", "k", "cost")
            .groupBy("market", "date", "k")
            .agg(F.sum("cost").alias("cost"))
            .selectExpr("market", "date", f"{_code('k')} AS market_sku", f"{_MONEY.format('cost')} AS cost")
        )

    @cached_property
    def _onsite(self) -> DataFrame:
        """Views and clicks per user, product and day, then placed by the user's home.

        A user's views of number k are views of product k + 100 j, where j depends on the user, so
        that every product has views at every scale.
        """
        spread = max(1, self._read("part").count() // _VIEWED_NUMBERS)
        return (
            self._read("events")
            .filter("event_type IN ('view', 'click')")
            .selectExpr(
                "user_id",
                f"CAST(get_json_object(props, '$.k') AS INT) + {_VIEWED_NUMBERS} * pmod(user_id, {spread}) AS k",
                "to_date(ts) AS date",
                "event_type",
            )
            .groupBy("user_id", "k", "date")
            .agg(
                F.expr("count_if(event_type = 'view') AS product_view"),
                F.expr("count_if(event_type = 'click') AS add_to_cart"),
            )
            .join(self._customers, F.expr("user_id = c_custkey"))
            .selectExpr(
                "market",
                "date",
                "region",
                "metro",
                f"{_code('k')} AS market_sku",
                "product_view",
                "add_to_cart",
            )
        )

    @cached_property
    def fact_region_product_daily_onsite_metric(self) -> DataFrame:
        return self._onsite.groupBy("market", "date", "region", "market_sku").agg(
            F.sum("product_view").alias("product_view"), F.sum("add_to_cart").alias("add_to_cart")
        )

    @cached_property
    def fact_dma_product_daily_onsite_metric(self) -> DataFrame:
        return (
            self._onsite.filter("metro IS NOT NULL")
            .groupBy("market", "date", "metro", "market_sku")
            .agg(F.sum("product_view").alias("product_view"))
        )

    @cached_property
    def dim_sku(self) -> DataFrame:
        """Every product once per market.

        As a join its size is not taken for that of the small file it is read from, so Spark
        broadcasts it where it measures it to be small and not by a guess.
        """
        return (
            self._read("part")
            .crossJoin(self._markets)
            .selectExpr("*", "p_partkey div 4 AS spu")
            .selectExpr(
                "p_size",
                "spu",
                f"{_code('p_partkey')} AS market_sku",
                "p_name || ' ' || p_partkey AS sku_name",
                "market || '-SPU-' || spu AS market_spu",
                "'Family ' || spu AS spu_name",
                "'All' AS master_category",
                "IF(p_type = 'PROMO', 'Swatch', p_type) AS category",
                "IF(p_brand = 'Brand#25', 'Accident Protection Plan', p_brand) AS subcategory",
                f"IF({self._made_up('p_partkey % 19 = 0')}, NULL, split_part(p_name, ' ', 2)) AS collection",
                "split_part(p_name, ' ', 1) AS color_tone",
            )
        )

    @cached_property
    def dim_sku_property(self) -> DataFrame:
        return self.dim_sku.filter("p_size % 3 < 2").selectExpr(
            "market_sku",
            "'Material Helper' AS property_type",
            "IF(p_size % 3 = 0, 'Wood', 'Metal') AS value",
        )

    @cached_property
    def dim_spu_property(self) -> DataFrame:
        return (
            self.dim_sku.filter("spu % 2 = 0")
            .selectExpr("market_spu", "'Material Helper' AS property_type", "'Fabric' AS value")
            .distinct()
        )

    @cached_property
    def helper_us_census(self) -> DataFrame:
        return self._places.select("zip", "dma_code")

    @cached_property
    def dim_dma(self) -> DataFrame:
        return self._places.filter("metro IS NOT NULL").selectExpr("dma_code", "metro AS ga_dma")

"""Write the star as catalog tables in the layout that the plans read best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.operators.cells import order_day
from geoaffinity.schemas import ORDER_DAY, ORDER_PARTITIONS, ORDER_TABLES, STAR_SCHEMAS
from geoaffinity.sources.star import StarTables, read_catalog_star

ORDER_NUMBER = "spree_so_id"


def with_order_partitions(star: StarTables) -> dict[str, DataFrame]:
    """Orders and lines with the market and the day that they are stored by.

    A line takes those of its order. Lines without order and orders without payment keep a null
    day; an order number that is stored twice with the same market and day counts once here.
    """
    day, _ = order_day(star)
    orders = star.fact_saleorder.withColumn(ORDER_DAY, F.expr(day))
    of_orders = orders.select(ORDER_NUMBER, *ORDER_PARTITIONS).distinct()
    lines = star.fact_saleorderline.drop(*ORDER_PARTITIONS).join(of_orders, ORDER_NUMBER, "left")
    return {"fact_saleorder": orders, "fact_saleorderline": lines}


def write_star(star: StarTables, database: str, buckets: int = 64, location: str | None = None) -> StarTables:
    """Write all tables of a star to a catalog database and return the star that reads them.

    Orders and lines are partitioned by market and order day, and bucketed and sorted by order
    number into the same buckets, so that their join needs no exchange and reads the asked days
    only. Views and cost are partitioned by market and date. Rows are dealt by partition and bucket
    before they are written, and partitions that grow beyond the advisory size are split, so files
    are neither tiny nor written by one task. Tables of the same names are replaced.
    """
    spark = star.dim_sku.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    placed = with_order_partitions(star)
    for name, schema in STAR_SCHEMAS.items():
        if name in ORDER_TABLES:
            bucket = F.pmod(F.hash(ORDER_NUMBER), F.lit(buckets)).alias("bucket")
            dealt = placed[name].select("*", bucket).hint("rebalance", *ORDER_PARTITIONS, "bucket").drop("bucket")
            writer = dealt.write.partitionBy(*ORDER_PARTITIONS)
            writer = writer.bucketBy(buckets, ORDER_NUMBER).sortBy(ORDER_NUMBER)
        elif "date" in schema.fieldNames():
            dealt = getattr(star, name).hint("rebalance", "market", "date")
            writer = dealt.write.partitionBy("market", "date")
        else:
            writer = getattr(star, name).write
        writer.mode("overwrite").saveAsTable(f"{database}.{name}")
    return read_catalog_star(spark, database, star.zone, tuple(ORDER_PARTITIONS))

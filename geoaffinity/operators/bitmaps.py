"""Distinct SKU counts that add up: sets of SKUs as bitmaps that merge over days and places.

A count of distinct SKUs of a month cannot be had from the counts of its days, so it needs the
cells. The union of the days' sets can: SKUs are numbered densely, and each block of 32,768 numbers
is a bitmap of 4 KB. Daily rows of sums and bitmaps answer any period and any set of places without
the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoaffinity.operators.measures import SUMMED, keyed, sums

#: SKUs are numbered within so many hashed groups, so that no task sorts them all.
_GROUPS = 1024
#: Groups that the SKUs of one value are dealt to, where numbers are kept near.
_OF_VALUE = 64


def sku_numbers(attributes: DataFrame, near: Sequence[str] = ()) -> DataFrame:
    """Rows (market_sku, sku_no): the numbers 0, 1, 2, ... without gaps, the same in every run.

    Numbers within a group follow its SKUs' order; a group's first number is the sum of the groups
    before, over one row for each of the groups. ``near`` names attributes whose values' SKUs get
    numbers next to each other, but for values of equal hash: a value's bitmaps are then few and
    full, instead of one for every block of all SKUs.
    """
    if near:
        skus = attributes.groupBy("market_sku").agg(*[F.min(name).alias(name) for name in near])
        value = F.pmod(F.hash(*near), F.lit(_GROUPS))
        part = value * _OF_VALUE + F.pmod(F.hash("market_sku"), F.lit(_OF_VALUE))
    else:
        skus = attributes.select("market_sku").distinct()
        part = F.pmod(F.hash("market_sku"), F.lit(_GROUPS))
    grouped = skus.select("market_sku", part.alias("part"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("market_sku"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    return (
        grouped.withColumn("within", within)
        .join(starts, "part")
        .selectExpr("market_sku", "start + within - 1 AS sku_no")
    )


def daily_summary(
    cells: DataFrame, numbers: DataFrame, feature: str, place: str, measures: Sequence[str] = SUMMED
) -> DataFrame:
    """Per place, category, feature value, day and block of SKU numbers: summed measures and a bitmap.

    A SKU lies in one block, so measures add up over blocks. With numbers near by category and
    feature a value has no more blocks than its SKUs fill, so rows don't grow with all SKUs times
    all values.
    """
    return (
        keyed(cells, feature)
        .join(numbers, "market_sku")
        .groupBy(place, "category", "feature_value", "order_date", F.expr("bitmap_bucket_number(sku_no)").alias("block"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(sku_no))").alias("skus"), *sums(*measures))
    )


def summary_of_days(
    daily: DataFrame, keys: Sequence[str], measures: Sequence[str] = SUMMED
) -> DataFrame:
    """SKU count and summed measures per category, feature value and ``keys`` (a place, a day, nothing)."""
    blocks = daily.groupBy(*keys, "category", "feature_value", "block").agg(
        F.expr("bitmap_or_agg(skus)").alias("skus"), *sums(*measures)
    )
    return blocks.groupBy(*keys, "category", "feature_value").agg(
        F.expr("sum(bitmap_count(skus))").alias("sku_count"), *sums(*measures)
    )

"""Daily cells kept in a folder, rebuilt by day.

Facts of past days rarely change, so analyses need not aggregate them anew. Kept are the measures
of orders and views per SKU, place and day, without attributes: a product that changes its
category needs no rebuilding.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaffinity.operators.cells import DMA, REGION, order_levels
from geoaffinity.params import Scope
from geoaffinity.sources.shared import file_system, hadoop_path, remove
from geoaffinity.sources.fetch import fetch
from geoaffinity.sources.star import StarTables

_ORDERS = "total_revenue DECIMAL(28,4), total_quantity BIGINT, total_order BIGINT"
_KEYS = "build STRING, market STRING, order_date DATE"
SCHEMAS = {
    "orders": f"market_sku STRING, place STRING, {_ORDERS}, level STRING, {_KEYS}",
    "views_region": f"market_sku STRING, region STRING, product_view BIGINT, add_to_cart BIGINT, {_KEYS}",
    "views_dma": f"market_sku STRING, dma STRING, product_view BIGINT, {_KEYS}",
    "days": _KEYS,
}


class KeptCells:
    """Cells below a shared folder, partitioned by market and day, orders by level of place before.

    ``update`` rebuilds the days of a scope and touches no other; one update at a time.
    ``star.with_kept(cells)`` makes a star whose analyses read them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self.folder = folder.rstrip("/")

    def update(self, star: StarTables, scope: Scope) -> None:
        """Rebuild every day of the scope's period for its market, from the star's facts.

        Written partitions replace those of the same day (dynamic overwrite); days of the scope
        that no longer hold rows lose theirs. The table of days is written last, so that a failed
        update of new days leaves them unknown rather than empty.
        """
        star = star.with_kept(None)
        frames = {
            "orders": order_levels(star, scope),
            "views_region": fetch(
                """SELECT market_sku, region, date AS order_date, sum(product_view) AS product_view,
                  sum(add_to_cart) AS add_to_cart
                FROM {facts} WHERE market = :market AND date BETWEEN :start AND :end
                GROUP BY market_sku, region, date""",
                star.fact_region_product_daily_onsite_metric,
                scope,
            ),
            "views_dma": fetch(
                """SELECT market_sku, metro AS dma, date AS order_date, sum(product_view) AS product_view
                FROM {facts} WHERE market = :market AND date BETWEEN :start AND :end
                GROUP BY market_sku, metro, date""",
                star.fact_dma_product_daily_onsite_metric,
                scope,
            ),
            "days": self._spark.range((scope.end - scope.start).days + 1).select(
                F.date_add(F.lit(scope.start), F.col("id").cast("int")).alias("order_date")
            ),
        }
        build = uuid.uuid4().hex
        for name, frame in frames.items():
            self._replace(name, frame, scope, build)

    def _replace(self, name: str, frame: DataFrame, scope: Scope, build: str) -> None:
        path = f"{self.folder}/{name}"
        parts = [*(["level"] if "level" in frame.columns else []), "market", "order_date"]
        rows = frame.hint("rebalance", "order_date")
        (
            rows.select("*", F.lit(build).alias("build"), F.lit(scope.market).alias("market"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(path)
        )
        old = self._read(name, scope).filter(F.col("build") != build).select(*parts).distinct()
        for row in old.collect():  # at most the levels and days of the scope
            remove(self._spark, "/".join([path, *[f"{part}={row[part]}" for part in parts]]))

    def _read(self, name: str, scope: Scope) -> DataFrame:
        stored = self._spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        return fetch(
            "SELECT * FROM {facts} WHERE market = :market AND order_date BETWEEN :start AND :end", stored, scope
        )

    def missing_days(self, scope: Scope) -> list[dt.date]:
        """Days of the scope that have not been built."""
        every = [scope.start + dt.timedelta(n) for n in range((scope.end - scope.start).days + 1)]
        path = f"{self.folder}/days"
        if not file_system(self._spark, path).exists(hadoop_path(self._spark, path)):
            return every
        built = {row["order_date"] for row in self._read("days", scope).select("order_date").collect()}
        return [day for day in every if day not in built]

    def _rows(self, name: str, scope: Scope) -> DataFrame:
        missing = self.missing_days(scope)
        if missing:
            raise ValueError(f"{len(missing)} days of {scope.market} are not built, the first {missing[0]}")
        return self._read(name, scope).drop("build", "market")

    def order_measures(self, scope: Scope, place: str | None) -> DataFrame:
        """Revenue, quantity and orders per SKU, place and day; an order has one region, so
        regions add up to the country."""
        level = DMA if place == DMA else REGION
        rows = self._rows("orders", scope).filter(F.col("level") == level).drop("level")
        rows = rows.withColumnRenamed("place", level)
        if place:
            return rows
        sums = [F.sum(n).alias(n) for n in ("total_revenue", "total_quantity", "total_order")]
        return rows.groupBy("market_sku", "order_date").agg(*sums)

    def views(self, scope: Scope, place: str | None) -> DataFrame:
        """Views per SKU, region or DMA, and day; all places, as the facts hold them."""
        return self._rows("views_dma" if place == DMA else "views_region", scope)

"""The retail star as a bundle of lazy DataFrames, read from files, a catalog or JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from geoaffinity.schemas import FACT_TABLES, ORDER_PARTITIONS, STAR_SCHEMAS, conform, table_schema
from geoaffinity.sources.fetch import covering_predicates


class StarTables:
    """The star's tables by name; a table is opened when it is first asked for.

    zone: the warehouse's time zone, in which zoned order times are turned into days.
    order_partitions: columns (market, order_day) that orders and lines are both stored by; they
    are then read, filtered and joined besides the order number, so that lines are pruned.
    kept: daily cells that are read instead of the facts they were made of.
    """

    def __init__(
        self,
        read: Callable[[str], DataFrame],
        zone: str = "UTC",
        order_partitions: Sequence[str] = (),
        kept=None,
    ):
        unknown = set(order_partitions) - set(ORDER_PARTITIONS)
        if unknown:
            raise ValueError(f"orders cannot be stored by {', '.join(sorted(unknown))}")
        self._read = read
        self.zone = zone
        self.order_partitions = tuple(order_partitions)
        self.kept = kept
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STAR_SCHEMAS:
            raise AttributeError(name)
        if name not in self._opened:
            self._opened[name] = conform(self._read(name), table_schema(name, self.order_partitions))
        return self._opened[name]

    def with_kept(self, kept) -> StarTables:
        """The same star, reading kept cells instead of orders, lines and views."""
        return StarTables(self._read, self.zone, self.order_partitions, kept)


def read_parquet_star(
    spark: SparkSession, folder: str, zone: str = "UTC", order_partitions: Sequence[str] = ()
) -> StarTables:
    """Tables stored as ``<folder>/<table>`` or ``<folder>/<table>.parquet``."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}{{,.parquet}}")

    return StarTables(read, zone, order_partitions)


def read_catalog_star(
    spark: SparkSession,
    database: str | None = None,
    zone: str = "UTC",
    order_partitions: Sequence[str] = (),
) -> StarTables:
    """Tables of a catalog database; bucketing by order number saves the order join's shuffle."""
    prefix = f"{database}." if database else ""
    return StarTables(lambda name: spark.table(prefix + name), zone, order_partitions)


def read_jdbc_star(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    fact_predicates: Mapping[str, Sequence[str]] | None = None,
    fact_days: Mapping[str, tuple[str, int]] | None = None,
    zone: str = "UTC",
) -> StarTables:
    """Tables of a SQL warehouse.

    Every fact table needs its list of disjoint SQL predicates, or the name of its day column and a
    number of days: its bounds are then asked for and each piece of so many days becomes one
    partition. So no fact is drawn through a single connection.
    """
    written, by_day = dict(fact_predicates or {}), dict(fact_days or {})
    unsplit = [name for name in FACT_TABLES if not written.get(name) and name not in by_day]
    if unsplit:
        raise ValueError(f"fact tables without predicates: {', '.join(unsplit)}")

    def planned(name: str) -> list[str]:
        column, days = by_day[name]
        query = f"(SELECT CAST(min({column}) AS DATE) AS a, CAST(max({column}) AS DATE) AS z FROM {name}) bounds"
        return covering_predicates(column, *spark.read.jdbc(url, query, properties=dict(properties)).first(), days)

    def read(name: str) -> DataFrame:
        predicates = written.get(name) or (planned(name) if name in by_day else None)
        return spark.read.jdbc(
            url,
            name,
            predicates=list(predicates) if predicates else None,
            properties=dict(properties),
        )

    return StarTables(read, zone)

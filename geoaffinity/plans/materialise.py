"""Cells written to a folder that the caller names, read by several branches of an analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geoaffinity.sources.shared import remove


class CellStore:
    """Writes cell tables as Parquet below a folder that all executors share.

    Unlike a cache a written table survives the loss of executors, is read by column, and has a
    known size from which Spark can tell whether a broadcast pays.  Writing starts a job when the
    analysis is called.  Use it as a context manager around the writing of the result: its tables
    are removed at the end.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self.path = f"{folder.rstrip('/')}/cells-{uuid.uuid4().hex}"
        self._tables = 0

    def __enter__(self) -> CellStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()

    def remove(self) -> None:
        """Delete the store's own tables; the folder itself stays."""
        remove(self._spark, self.path)

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        self._tables += 1
        path = f"{self.path}/{self._tables}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def write_levels(self, levels: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write the cells of several place levels, keyed by their place column, in one job.

        As parts of one plan the levels share what they have in common, above all the shuffle of
        the order lines, which then is read and moved once for all of them.
        """
        tagged = [
            cells.withColumnRenamed(place, "place").selectExpr("*", f"'{place}' AS level")
            for place, cells in levels.items()
        ]
        union = tagged[0]
        for part in tagged[1:]:
            union = union.unionByName(part)
        written = self.write(union, "level")
        return {
            place: written.filter(f"level = '{place}'").drop("level").withColumnRenamed("place", place)
            for place in levels
        }

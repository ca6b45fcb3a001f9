"""CSV sink of the presented tables."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaffinity.params import CompareParams, FactParams, RankParams
from geoaffinity.sources.shared import file_system, hadoop_path, remove

MANIFEST = "manifest.json"
_PLACE, _PART, _START = "_report_place", "_report_part", "_report_start"


def report_name(params: CompareParams | RankParams | FactParams) -> str:
    """Report name made of the parameters, as the analyst's download is named."""
    scope = params.scope
    period = f"{scope.start} to {scope.end}"
    if isinstance(params, CompareParams):
        parts = (f"{params.analysed} vs. {params.baseline}", params.feature, params.metric, period)
    elif isinstance(params, RankParams):
        features = params.features
        parts = (features.first, features.second, params.level, params.metric, period)
    else:
        parts = (params.features.first, params.features.second, period)
    return "_".join(parts) + ".csv"


def numbered(rows: DataFrame, folder: str) -> DataFrame:
    """The rows with their place in their order, from 1 on, as first column ``Row``.

    The ordered rows are written below ``folder``, with a number that rises within and across
    partitions; the rows of earlier partitions are then counted, so no task holds all rows.
    """
    spark = rows.sparkSession
    path = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.withColumn(_PLACE, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn(_PART, F.shiftright(_PLACE, 33))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).select(
        _PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_START)
    )
    place = F.col(_START) + F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return stored.join(starts, _PART).select(place.alias("Row"), *[F.col(f"`{name}`") for name in rows.columns])


def write_report(formatted: DataFrame, folder: str, name: str) -> str:
    """Write the formatted table, in its order, as CSV with a header; returns the path written.

    A first column ``Row`` numbers the rows. The report is written beside its place, with a
    manifest of its parts, and then takes the place by renaming, so a reader never sees part of
    it. An earlier report there is replaced; a folder without manifest is not a report, and refused.
    """
    spark = formatted.sparkSession
    folder = folder.rstrip("/")
    path, fresh = f"{folder}/{name}", f"{folder}/.{uuid.uuid4().hex}"
    files = file_system(spark, path)
    at = lambda *parts: hadoop_path(spark, "/".join(parts))
    if files.exists(at(path)) and not files.exists(at(path, MANIFEST)):
        raise ValueError(f"{path} exists and is not a report")
    try:
        rows = numbered(formatted, f"{fresh}/staged")
        rows.orderBy("Row").write.option("header", True).csv(f"{fresh}/report")
        parts = sorted(
            status.getPath().getName()
            for status in files.listStatus(at(fresh, "report"))
            if status.getPath().getName().startswith("part-")
        )
        manifest = {"columns": rows.columns, "rows": rows.count(), "parts": parts}
        out = files.create(at(fresh, "report", MANIFEST))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(at(path)):
            files.rename(at(path), at(fresh, "replaced"))
        if not files.rename(at(fresh, "report"), at(path)):
            raise OSError(f"could not move the report to {path}")
    finally:
        remove(spark, fresh)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report in its stored order: ``Row`` as a number, all else as text."""
    try:
        manifest = spark.read.json(f"{path}/{MANIFEST}", multiLine=True).first()
    except AnalysisException as error:
        raise ValueError(f"{path} is not a report") from error
    schema = ", ".join(f"`{name}` {'BIGINT' if name == 'Row' else 'STRING'}" for name in manifest["columns"])
    parts = [f"{path}/{part}" for part in manifest["parts"]]
    return spark.read.schema(schema).option("header", True).csv(parts).orderBy("Row")

"""Product lists that say which option values exist."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaffinity.schemas import OPTION_SHEET_SCHEMAS, PRODUCT_INFO_SCHEMA

_LINE = "_malformed_line"


def read_product_info(spark: SparkSession, path: str) -> DataFrame:
    """The product file: a CSV with a header naming ``market_sku`` and the feature columns.

    Lines that ``rejected_lines`` returns are left out.
    """
    return _sorted_out(spark, path, PRODUCT_INFO_SCHEMA).filter("reason IS NULL").select(
        *PRODUCT_INFO_SCHEMA.fieldNames()
    )


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (line, reason) of a product file that cannot be used: to be written to a quarantine."""
    return _sorted_out(spark, path, PRODUCT_INFO_SCHEMA).filter("reason IS NOT NULL").select("line", "reason")


def read_option_sheets(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Option sheets exported to CSV, one path per sheet name, keyed by dimension.

    The columns of a sheet are lists of their own and end where they end: a short line lacks the
    last ones.
    """
    lists: dict[str, DataFrame] = {}
    for sheet, path in paths.items():
        schema = OPTION_SHEET_SCHEMAS[sheet]
        df = _sorted_out(spark, path, schema)
        lists.update({name: df.filter(f"{name} IS NOT NULL").select(name) for name in schema.fieldNames()})
    return lists


def of_market(product_info: DataFrame, market: str) -> DataFrame:
    """Products whose SKU code carries the market prefix."""
    return product_info.filter(F.col("market_sku").contains(f"{market}-"))


def option_lists(product_info: DataFrame, dimensions) -> dict[str, DataFrame]:
    """One column of the product file per dimension."""
    return {name: product_info.select(name) for name in dimensions}


def option_values(product_list: DataFrame, dimension: str) -> DataFrame:
    """The distinct values on offer for one dimension."""
    return product_list.select(dimension).filter(F.col(dimension).isNotNull()).distinct()


def _sorted_out(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The declared columns of every line with the line and the reason to reject it, if any.

    Columns are found by header name: a file may hold others, in any order, but all files of a path
    have the same header. Blank values are null.
    """
    names = spark.read.option("header", True).csv(path).columns
    missing = [name for name in schema.fieldNames() if name not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    declared = {field.name: field.dataType for field in schema.fields}
    stored = T.StructType([T.StructField(name, declared.get(name, T.StringType())) for name in names])
    read = (
        spark.read.options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE)
        # A line that is cut to the columns asked for would not show that it has others.
        .options(ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, columnPruning=False)
        .schema(stored.add(_LINE, T.StringType()))
        .csv(path)
    )
    key = schema.fieldNames()[0]
    return read.selectExpr(
        *schema.fieldNames(),
        f"coalesce({_LINE}, to_csv(struct({', '.join(f'`{n}`' for n in names)}))) AS line",
        f"""CASE WHEN {_LINE} IS NOT NULL THEN 'number of columns'
            WHEN {key} IS NULL THEN 'no {key}' END AS reason""",
    )

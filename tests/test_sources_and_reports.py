"""Readers, product lists, number formats and the CSV sink."""

import csv
import datetime as dt
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoaffinity.functions import text
from geoaffinity.operators.present import format_basic, format_two_feature
from geoaffinity.params import CompareParams, FactParams, RankParams, TwoFeatures
from geoaffinity.plans.analyses import compare
from geoaffinity.plans.materialise import CellStore
from geoaffinity.schemas import STAR_SCHEMAS
from geoaffinity.sources.fetch import covering_predicates, fetch
from geoaffinity.sources.product_lists import (
    of_market,
    option_lists,
    option_values,
    read_option_sheets,
    read_product_info,
    rejected_lines,
)
from geoaffinity.sources.reports import read_report, report_name, write_report
from geoaffinity.sources.star import StarTables, read_catalog_star, read_jdbc_star, read_parquet_star
from tests import handmade as hm
from tests.handmade import SCOPE


def small_star(spark):
    return hm.star(
        spark,
        skus=[hm.sku("US-A"), hm.sku("US-B", category="Bed")],
        orders=[hm.order("1"), hm.order("2", "US East")],
        lines=[hm.line("1", "US-A", 1234.5), hm.line("2", "US-A", 100), hm.line("1", "US-B", 10)],
        views=[hm.view("US-A", 4), hm.view("US-A", 1, "US East"), hm.view("US-B", 3)],
        costs=[hm.cost("US-A", 500), hm.cost("US-B", 700)],
    )


PARAMS = CompareParams(SCOPE, "US West", "US All", "category")


def open_params():
    from geoaffinity.params import Thresholds

    return CompareParams(SCOPE, "US West", "US All", "category", thresholds=Thresholds(0, 0, 0, 0))


def test_stars_written_as_files_and_as_catalog_tables_read_the_same(spark, tmp_path):
    star = small_star(spark)
    expected = compare(star, open_params()).collect()
    for name in STAR_SCHEMAS:
        table = getattr(star, name)
        suffix = ".parquet" if name.startswith("dim_") else ""
        table.write.parquet(f"{tmp_path}/star/{name}{suffix}")
        table.createOrReplaceTempView(name)
    assert compare(read_parquet_star(spark, f"{tmp_path}/star"), open_params()).collect() == expected
    assert compare(read_catalog_star(spark), open_params()).collect() == expected


def test_tables_are_cast_to_their_declared_types_and_must_be_complete(spark):
    def read(name):
        if name == "dim_dma":
            return spark.sql("SELECT '501' AS dma_code, 'New York, NY' AS ga_dma, 1 AS other")
        return spark.sql("SELECT 'Z1' AS zip")

    star = StarTables(read)
    assert star.dim_dma.dtypes == [("dma_code", "int"), ("ga_dma", "string")]
    with pytest.raises(ValueError, match="dma_code"):
        star.helper_us_census
    with pytest.raises(AttributeError):
        star.no_such_table


def test_jdbc_facts_need_predicates(spark):
    with pytest.raises(ValueError, match="fact_product_ads_metric"):
        read_jdbc_star(spark, "jdbc:none", {}, {"fact_saleorder": ["1 = 1"]})


def test_product_lists_from_csv(spark, tmp_path):
    info = tmp_path / "info.csv"
    info.write_text(
        "color_tone,market_sku,market_spu,category,subcategory,collection,material_helper,extra\n"
        "Grey,US-1,P1,Sofa,Fabric Sofa,Ash,Wood,x\nRed,AU-1,P1,Bed,Low Bed,Oak,,y\nGrey,US-2,P2,Sofa,,Ash,,z\n"
    )
    us = of_market(read_product_info(spark, str(info)), "US")
    assert us.count() == 2
    lists = option_lists(us, ("category", "subcategory", "material_helper"))
    values = {name: [r[0] for r in option_values(df, name).collect()] for name, df in lists.items()}
    assert values == {"category": ["Sofa"], "subcategory": ["Fabric Sofa"], "material_helper": ["Wood"]}
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("category,subcategory\nSofa,Fabric Sofa\nSofa,Leather Sofa\n")
    sheets = read_option_sheets(spark, {"category_subcategory": str(sheet)})
    assert option_values(sheets["subcategory"], "subcategory").count() == 2
    assert option_values(sheets["category"], "category").count() == 1


def test_malformed_lines_of_a_product_file_are_set_aside(spark, tmp_path):
    info = tmp_path / "info.csv"
    info.write_text(
        "market_sku,extra,market_spu,category,subcategory,collection,color_tone,material_helper\n"
        "US-1,x,P1,Sofa,Low,Ash,Grey,Wood\n"
        "US-2,x,P1,Sofa\n"
        "US-3,x,P1,Sofa,Low,Ash,Grey,Wood,more\n"
        ",x,P1,Sofa,Low,Ash,Grey,Wood\n"
        'US-4,"a,b\tc",P1, ,Low,Ash,Grey,\n'
    )
    found = read_product_info(spark, str(info)).collect()
    assert [(r["market_sku"], r["category"], r["material_helper"]) for r in found] == [
        ("US-1", "Sofa", "Wood"), ("US-4", None, None)
    ]
    rejected = {r["line"]: r["reason"] for r in rejected_lines(spark, str(info)).collect()}
    assert rejected == {
        "US-2,x,P1,Sofa": "number of columns",
        "US-3,x,P1,Sofa,Low,Ash,Grey,Wood,more": "number of columns",
        ",x,P1,Sofa,Low,Ash,Grey,Wood": "no market_sku",
    }
    other = tmp_path / "other.csv"
    other.write_text("market_sku,category\nUS-1,Sofa\n")
    with pytest.raises(ValueError, match="market_spu"):
        read_product_info(spark, str(other))


def test_files_with_columns_in_another_order_are_an_error(spark, tmp_path):
    names = "market_sku,market_spu,category,subcategory,collection,color_tone,material_helper".split(",")
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join("abcdefg") + "\n")
    (tmp_path / "b.csv").write_text(",".join(names[::-1]) + "\n" + ",".join("abcdefg") + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_product_info(spark, str(tmp_path)).collect()


def test_columns_of_an_option_sheet_end_where_they_end(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("category,subcategory\nSofa,Low\nBed,\nChair\n,High\n")
    sheets = read_option_sheets(spark, {"category_subcategory": str(sheet)})
    values = {name: sorted(r[0] for r in option_values(df, name).collect()) for name, df in sheets.items()}
    assert values == {"category": ["Bed", "Chair", "Sofa"], "subcategory": ["High", "Low"]}


def test_covering_predicates_hold_for_every_row_once(spark):
    day = dt.date
    days = [None, day(2023, 12, 1), *[day(2024, 1, n) for n in range(1, 32)], day(2025, 1, 1)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    for first, last, width in ((days[2], days[-2], 7), (days[2], days[2], 1), (days[2], days[-2], 100), (None, None, 5)):
        pieces = covering_predicates("d", first, last, width)
        counts = [frame.filter(piece).count() for piece in pieces]
        assert sum(counts) == len(days) and len(set(pieces)) == len(pieces)
    assert len(covering_predicates("d", days[2], days[-2], 7)) == 6
    with pytest.raises(ValueError):
        covering_predicates("d", None, None, 0)


def test_jdbc_reads_are_planned_from_the_bounds_of_their_days(spark, monkeypatch):
    """The reader itself is a stand-in: no database runs here."""
    from pyspark.sql import DataFrameReader

    star, asked = small_star(spark), []

    def jdbc(self, url, table, predicates=None, properties=None):
        asked.append((table, predicates))
        if table.startswith("("):
            return spark.sql("SELECT DATE'2024-05-01' AS a, DATE'2024-05-20' AS z")
        return getattr(star, table)

    monkeypatch.setattr(DataFrameReader, "jdbc", jdbc)
    days = {
        "fact_saleorder": ("payment_completion_time", 10),
        "fact_region_product_daily_onsite_metric": ("date", 5),
        "fact_dma_product_daily_onsite_metric": ("date", 5),
        "fact_product_ads_metric": ("date", 30),
    }
    read = read_jdbc_star(spark, "jdbc:none", {}, {"fact_saleorderline": ["quantity > 1", "quantity <= 1"]}, days)
    assert compare(read, open_params()).collect() == compare(star, open_params()).collect()
    pieces = dict(asked)
    assert len(pieces["fact_saleorder"]) == 3 and len(pieces["fact_region_product_daily_onsite_metric"]) == 5
    assert pieces["fact_saleorderline"] == ["quantity > 1", "quantity <= 1"] and pieces["dim_sku"] is None


def test_markets_and_dates_are_bound_not_written(spark):
    odd = "US' OR 1 = 1 --"
    frame = spark.sql("SELECT :m AS market, DATE'2024-05-01' AS date", args={"m": odd})

    class Odd:
        market, start, end = odd, dt.date(2024, 5, 1), dt.date(2024, 5, 2)

    where = "SELECT * FROM {facts} WHERE market = :market AND date BETWEEN :start AND :end"
    assert fetch(where, frame, Odd).count() == 1
    assert fetch(where, frame.union(frame.selectExpr("'US' AS market", "date")), Odd).count() == 1


def formatted(spark, make, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double").selectExpr(f"{make('x')} AS y")
    return [row["y"] for row in frame.coalesce(1).collect()]


def test_number_formats(spark):
    values = [2.5, 0.125, -5.0, 1234567.891, None, 0.00125]
    assert formatted(spark, text.thousands, values) == ["2", "0", "-5", "1,234,568", None, "0"]
    assert formatted(spark, text.dollars, values) == ["$2.50", "$0.12", "$-5.00", "$1,234,567.89", None, "$0.00"]
    assert formatted(spark, text.two_decimals, values)[:2] == ["2.50", "0.12"]
    assert formatted(spark, text.percent, values) == ["250.00%", "12.50%", "-500.00%", "123456789.10%", None, "0.12%"]
    assert formatted(spark, text.p_value, values)[4] == text.SMALL_SAMPLE_NOTE


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=20, max_size=40))
def test_formats_agree_with_python(spark, values):
    values = [v for v in values if abs(v) > 0.01]
    if values:
        assert formatted(spark, text.two_decimals, values) == [f"{v:,.2f}" for v in values]
        assert formatted(spark, text.percent, values) == [f"{v:.2%}" for v in values]


def test_presented_columns(spark):
    result = compare(small_star(spark), open_params())
    shown = format_basic(result, "category")
    assert shown.columns == [
        "Category",
        "SKU Count",
        "Revenue_Analysed",
        "Quantity_Analysed",
        "Ave. Price_Analysed",
        "Order_Analysed",
        "Detailview_Analysed",
        "Country Average Cost per SKU",
        "Rev/DV_Analysed",
        "Rev/DV_Baseline",
        "%Metric Difference",
        "%Order",
        "Weighted Score",
        "P-Value",
    ]
    first = shown.collect()[0]
    assert first["Revenue_Analysed"] == "$1,234.50"
    assert first["P-Value"] == text.SMALL_SAMPLE_NOTE
    kept = format_two_feature(result, TwoFeatures("color_tone"))
    assert kept.columns[0] == "Category: Feature"


def test_report_names():
    period = f"{SCOPE.start} to {SCOPE.end}"
    assert report_name(PARAMS) == f"US West vs. US All_category_Rev per DV_{period}.csv"
    rank = RankParams(SCOPE, TwoFeatures("collection", "market_sku"), "CR")
    assert report_name(rank) == f"collection_market_sku_Regional Level_CR_{period}.csv"
    assert report_name(FactParams(SCOPE)) == f"category_No Selection_{period}.csv"


def test_csv_report_keeps_order_and_header(spark, tmp_path):
    shown = format_basic(compare(small_star(spark), open_params()), "category")
    path = write_report(shown, str(tmp_path), report_name(open_params()))
    (part,) = Path(path).glob("part-*.csv")
    with part.open() as handle:
        written = list(csv.DictReader(handle))
    assert [row["Category"] for row in written] == [row["Category"] for row in shown.collect()]
    assert written[0]["Revenue_Analysed"] == "$1,234.50"
    assert [row["Row"] for row in written] == ["1", "2"]
    back = read_report(spark, path)
    assert back.columns == ["Row", *shown.columns]
    assert [tuple(row)[1:] for row in back.collect()] == [tuple(row) for row in shown.collect()]


def test_reports_replace_reports_only(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).selectExpr("string(id * 7 % 1000) AS value").orderBy("value")
    path = write_report(rows, str(tmp_path), "a report.csv")
    assert [r["value"] for r in read_report(spark, path).collect()] == sorted(str(n) for n in range(1000))
    assert [r["Row"] for r in read_report(spark, path).collect()] == list(range(1, 1001))
    write_report(rows.limit(0), str(tmp_path), "a report.csv")
    assert read_report(spark, path).collect() == []
    assert [p.name for p in tmp_path.iterdir()] == ["a report.csv"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "file").write_text("kept")
    with pytest.raises(ValueError, match="not a report"):
        write_report(rows, str(tmp_path), "mine")
    with pytest.raises(ValueError, match="not a report"):
        read_report(spark, str(tmp_path / "mine"))
    assert (tmp_path / "mine" / "file").read_text() == "kept"


def test_a_failed_report_leaves_the_old_one(spark, tmp_path):
    good = spark.range(3).selectExpr("id AS value").orderBy("value")
    path = write_report(good, str(tmp_path), "report")
    broken = spark.range(3).selectExpr("IF(id = 2, raise_error('broken'), id) AS value")
    with pytest.raises(Exception, match="broken"):
        write_report(broken, str(tmp_path), "report")
    assert read_report(spark, path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_written_cells_lie_in_the_named_folder_and_are_removed(spark, tmp_path):
    with CellStore(spark, str(tmp_path)) as store:
        written = store.write(spark.range(5).selectExpr("id", "CAST(id AS DECIMAL(28,4)) AS money"))
        assert str(tmp_path) in written.inputFiles()[0]
        assert written.dtypes == [("id", "bigint"), ("money", "decimal(28,4)")]
        assert written.count() == 5
    assert not list(tmp_path.iterdir())


def test_dates_are_days_not_strings(spark):
    star = small_star(spark)
    assert dict(star.fact_product_ads_metric.dtypes)["date"] == "date"
    assert SCOPE.start == dt.date(2024, 5, 1)

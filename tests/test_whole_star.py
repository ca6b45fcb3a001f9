"""Queries that count every order of the test tables, also those the test star marks otherwise."""

import pytest

from geoaffinity.catalog.oracle import ORACLE_SQL
from geoaffinity.catalog.queries import QUERIES
from tests.oracle_check import duck

FOLDER = "/root/testdata/sf0.001"
KEYS = {
    "order_cells_region": "region, market_sku, order_date",
    "order_cells_dma": "dma, market_sku, order_date",
    "order_cells_country": "market, market_sku, order_date",
    "key_union": "region, market_sku, order_date",
    "feature_key": "region, market_sku, order_date",
}

# Every cell of completed web orders, straight from the tables; no other rule drops an order.
_CELLS = """SELECT DISTINCT {place}, 'US-' || l_partkey, DATE '2024-01-01'
    + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
  WHERE n_nationkey < 20 AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'
    AND p_type <> 'PROMO' AND p_brand <> 'Brand#25' {only}"""
_REGION = """CASE r_name WHEN 'AFRICA' THEN 'US West' WHEN 'AMERICA' THEN 'US East'
    WHEN 'ASIA' THEN 'US Southeast' WHEN 'EUROPE' THEN 'US Northwest' ELSE 'Overseas' END"""
_METRO = """CASE n_nationkey WHEN 1 THEN 'New York, NY' WHEN 0 THEN 'Los Angeles CA'
    WHEN 6 THEN 'Washington DC (Hagerstown MD)' WHEN 5 THEN 'San Francisco-Oakland-San Jose CA'
    WHEN 3 THEN 'Seattle-Tacoma WA' END"""


# Cells that were seen, in all regions but Overseas.
_SEEN = f"""SELECT DISTINCT {_REGION}, 'US-' || p_partkey, CAST(ts AS DATE)
  FROM events JOIN customer ON user_id = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON p_partkey = CAST(json_extract(props, '$.k') AS INTEGER)
      + 100 * (user_id % greatest(1, (SELECT count(*) // 100 FROM part)))
  WHERE n_nationkey < 20 AND event_type IN ('view', 'click') AND r_name <> 'MIDDLE EAST'
    AND p_type <> 'PROMO' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"""
CELLS = {
    "order_cells_region": _CELLS.format(place=_REGION, only=""),
    "order_cells_dma": _CELLS.format(place=_METRO, only=f"AND {_METRO} IS NOT NULL"),
    "order_cells_country": _CELLS.format(place="'US'", only=""),
    "key_union": f"{_CELLS.format(place=_REGION, only='')} UNION {_SEEN}",
    "feature_key": f"{_CELLS.format(place=_REGION, only='')} UNION {_SEEN}",
}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CELLS)
def test_every_completed_web_order_counts(spark, con, name):
    got = QUERIES[name](spark, FOLDER).selectExpr(*KEYS[name].split(", ")).collect()
    want = set(con.execute(CELLS[name]).fetchall())
    assert len(got) == len(want) and set(map(tuple, got)) == want
    stated = con.execute(f"SELECT {KEYS[name]} FROM ({ORACLE_SQL[name]})").fetchall()
    assert set(stated) == want


@pytest.mark.parametrize("name", [*CELLS, "welch_dma_rev"])
def test_their_sql_makes_up_no_orders_that_do_not_count(name):
    assert not [part for part in ("% 11", "% 13", "% 19", "n_nationkey = 7") if part in ORACLE_SQL[name]]

"""Expected results of the named queries as SQL over the raw test tables.

The SQL states each result the long way round: left joins from the order header, a full outer
join of cells, totals by window, and the t tail as a power series instead of a continued fraction.
Shares are quotients of whole numbers, so that they are the same in any order of additions.
"""

from __future__ import annotations

# Places and attributes that the results name.
START, END = "2024-01-01", "2024-01-30"
AU_REGIONS = ("AU Sydney", "AU Melbourne", "AU Perth")
DMAS = (
    "New York, NY",
    "Los Angeles CA",
    "Washington DC (Hagerstown MD)",
    "San Francisco-Oakland-San Jose CA",
    "Seattle-Tacoma WA",
)
US_REGIONS = ("US West", "US East", "US Southeast", "US Northwest")
ATTRIBUTES = (
    "sku_name, market_spu, spu_name, master_category, category, subcategory, collection, "
    "color_tone, material_helper"
)
NOTE = "Sample size too small to conduct ANOVA"
NUMERATOR = {"rev": "total_revenue", "cr": "total_order"}
METRIC = {"rev": "rev_per_dv", "cr": "CR"}


def _quoted(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


# --- the star -----------------------------------------------------------------------------

_STAR = """
place AS (
  SELECT n_nationkey,
    CASE WHEN n_nationkey < 20 THEN 'US' ELSE 'AU' END AS market,
    CASE WHEN n_nationkey = 7 THEN NULL WHEN n_nationkey < 20 THEN
      CASE r_name WHEN 'AFRICA' THEN 'US West' WHEN 'AMERICA' THEN 'US East'
        WHEN 'ASIA' THEN 'US Southeast' WHEN 'EUROPE' THEN 'US Northwest' ELSE 'Overseas' END
    ELSE
      CASE r_name WHEN 'AFRICA' THEN 'AU Sydney' WHEN 'AMERICA' THEN 'AU Melbourne'
        WHEN 'ASIA' THEN 'AU Perth' ELSE 'Overseas' END
    END AS region,
    'Z' || CAST(n_nationkey AS VARCHAR) AS zip,
    500 + n_nationkey AS dma_code,
    CASE n_nationkey WHEN 1 THEN 'New York, NY' WHEN 0 THEN 'Los Angeles CA'
      WHEN 6 THEN 'Washington DC (Hagerstown MD)'
      WHEN 5 THEN 'San Francisco-Oakland-San Jose CA' WHEN 3 THEN 'Seattle-Tacoma WA' END AS metro
  FROM nation JOIN region ON n_regionkey = r_regionkey),
home AS (
  SELECT c_custkey, market, region, zip, metro
  FROM customer JOIN place ON c_nationkey = n_nationkey),
fact_saleorder AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS spree_so_id, market, region, zip,
    DATE '2024-01-01'
      + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER) AS order_date,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'app' ELSE 'web' END AS spree_channel,
    CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'complete' END AS classification,
    CASE WHEN o_custkey % 11 = 0 THEN 'Service' ELSE 'Goods' END AS order_type,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Y' ELSE 'N' END AS pure_swatch_order_flag
  FROM orders JOIN home ON o_custkey = c_custkey),
fact_saleorderline AS (
  SELECT spree_so_id, market, order_date,
    market || '-' || CAST(l_partkey AS VARCHAR) AS market_sku,
    CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sale_amount,
    CAST(l_quantity AS BIGINT) AS quantity,
    CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)) AS cost
  FROM lineitem JOIN fact_saleorder ON CAST(l_orderkey AS VARCHAR) = spree_so_id),
product_view AS (
  SELECT market, CAST(ts AS DATE) AS order_date, region, metro,
    market || '-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER)
      + 100 * (user_id % greatest(1, (SELECT count(*) // 100 FROM part))) AS VARCHAR) AS market_sku,
    CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS product_view,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS add_to_cart
  FROM events JOIN home ON user_id = c_custkey WHERE event_type IN ('view', 'click')),
dim_sku AS (
  SELECT market, p_size, p_partkey // 4 AS spu,
    market || '-' || CAST(p_partkey AS VARCHAR) AS market_sku,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) AS sku_name,
    market || '-SPU-' || CAST(p_partkey // 4 AS VARCHAR) AS market_spu,
    'Family ' || CAST(p_partkey // 4 AS VARCHAR) AS spu_name,
    'All' AS master_category,
    CASE WHEN p_type = 'PROMO' THEN 'Swatch' ELSE p_type END AS category,
    CASE WHEN p_brand = 'Brand#25' THEN 'Accident Protection Plan' ELSE p_brand END AS subcategory,
    CASE WHEN p_partkey % 19 > 0 THEN split_part(p_name, ' ', 2) END AS collection,
    split_part(p_name, ' ', 1) AS color_tone
  FROM part CROSS JOIN (VALUES ('US'), ('AU')) AS m(market)),
sku_material AS (
  SELECT market_sku, CASE p_size % 3 WHEN 0 THEN 'Wood' ELSE 'Metal' END AS value
  FROM dim_sku WHERE p_size % 3 IN (0, 1)),
spu_material AS (SELECT DISTINCT market_spu, 'Fabric' AS value FROM dim_sku WHERE spu % 2 = 0),
attributes AS (
  SELECT d.market_sku, sku_name, d.market_spu, spu_name, master_category, category, subcategory,
    collection, color_tone, coalesce(k.value, u.value) AS material_helper
  FROM dim_sku d LEFT JOIN sku_material k ON d.market_sku = k.market_sku
    LEFT JOIN spu_material u ON d.market_spu = u.market_spu)
"""


def _orders(name: str, place: str) -> str:
    """Order cells of one level; an empty place means the whole country."""
    column = {"region": "o.region,", "dma": "g.metro AS dma,", "": ""}[place]
    only = f"AND g.metro IN ({_quoted(DMAS)})" if place == "dma" else ""
    return f"""
{name} AS (
  SELECT o.market, {column} l.market_sku, o.order_date, {ATTRIBUTES},
    sum(l.sale_amount) AS total_revenue,
    CAST(sum(l.quantity) AS BIGINT) AS total_quantity,
    count(DISTINCT o.spree_so_id) AS total_order
  FROM fact_saleorder o
    LEFT JOIN fact_saleorderline l ON o.spree_so_id = l.spree_so_id
    LEFT JOIN place g ON g.zip = o.zip
    LEFT JOIN attributes a ON l.market_sku = a.market_sku
  WHERE o.spree_channel = 'web' AND o.market = 'US' AND o.classification = 'complete'
    AND o.order_type = 'Goods' AND o.pure_swatch_order_flag = 'N'
    AND a.category <> 'Swatch' AND a.category IS NOT NULL
    AND a.subcategory <> 'Accident Protection Plan'
    AND o.order_date BETWEEN DATE '{START}' AND DATE '{END}' {only}
  GROUP BY ALL)"""


def _views(name: str, place: str, overseas: bool = False) -> str:
    column = {"region": "v.region,", "dma": "v.metro AS dma,", "": ""}[place]
    only = {"dma": f"AND v.metro IN ({_quoted(DMAS)})"}.get(place, "")
    if place != "dma" and not overseas:
        only = "AND v.region <> 'Overseas'"
    atc = "" if place else ", CAST(sum(add_to_cart) AS BIGINT) AS atc"
    return f"""
{name} AS (
  SELECT v.market, {column} v.market_sku, v.order_date, {ATTRIBUTES},
    CAST(sum(product_view) AS BIGINT) AS total_detailview {atc}
  FROM product_view v LEFT JOIN attributes a ON v.market_sku = a.market_sku
  WHERE v.market = 'US' AND v.order_date BETWEEN DATE '{START}' AND DATE '{END}'
    AND a.category <> 'Swatch' AND a.category IS NOT NULL {only}
  GROUP BY ALL)"""


def _costs(by_day: bool = False) -> str:
    day = "l.order_date," if by_day else ""
    return f"""
costs AS (
  SELECT l.market_sku, {day} {ATTRIBUTES}, sum(l.cost) AS country_total_cost
  FROM fact_saleorderline l LEFT JOIN attributes a ON l.market_sku = a.market_sku
  WHERE l.market = 'US' AND l.order_date BETWEEN DATE '{START}' AND DATE '{END}'
  GROUP BY ALL)"""


def _aligned(name: str, orders: str, views: str, place: str) -> str:
    both = ["order_date", "market", "market_sku", *ATTRIBUTES.split(", ")]
    if place:
        both.append(place)
    merged = ", ".join(f"coalesce(o.{c}, v.{c}) AS {c}" for c in both)
    match = "o.market_sku = v.market_sku AND o.order_date = v.order_date"
    if place:
        match += f" AND o.{place} IS NOT DISTINCT FROM v.{place}"
    extra = "" if place else ", coalesce(v.atc, 0) AS atc"
    return f"""
{name} AS (
  SELECT {merged}, coalesce(total_revenue, 0) AS total_revenue,
    coalesce(total_quantity, 0) AS total_quantity, coalesce(total_order, 0) AS total_order,
    coalesce(total_detailview, 0) AS total_detailview {extra}
  FROM {orders} o FULL OUTER JOIN {views} v ON {match})"""


def _cells(name: str, place: str, overseas: bool = False) -> list[str]:
    return [
        _orders(f"{name}_orders", place),
        _views(f"{name}_views", place, overseas),
        _aligned(name, f"{name}_orders", f"{name}_views", place),
    ]


def _country() -> list[str]:
    return [
        *_cells("joined", ""),
        _costs(by_day=True),
        """
country AS (
  SELECT j.*, coalesce(c.country_total_cost, 0) AS country_total_cost
  FROM joined j LEFT JOIN costs c ON j.market_sku = c.market_sku AND j.order_date = c.order_date)""",
    ]


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",".join([_STAR, *parts]) + "\n" + select


# --- measures -----------------------------------------------------------------------------


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def _share(partition: str) -> str:
    over = f"PARTITION BY {partition}" if partition else ""
    return f"CAST(total_order AS DOUBLE) / nullif(sum(total_order) OVER ({over}), 0)"


def _feature_sums(place: str, feature: str) -> str:
    first = f"{place}, " if place else ""
    return f"""SELECT {first}category, {feature} AS feature_value,
    count(DISTINCT market_sku) AS sku_count, sum(total_revenue) AS total_revenue,
    CAST(sum(total_quantity) AS BIGINT) AS total_quantity,
    CAST(sum(total_order) AS BIGINT) AS total_order,
    CAST(sum(total_detailview) AS BIGINT) AS total_detailview"""


def _two_sided_p(t2: str, df: str) -> str:
    """Power series of the incomplete beta function, summed on the side where it is short."""

    def series(a: str, b: str, y: str) -> str:
        return f"""(exp(({a}) * ln({y}) + ({b}) * ln(1 - {y}) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}))
          / ({a}) * list_sum(list_transform(range(0, 600), lambda n:
            exp(lgamma(({a}) + ({b}) + n) - lgamma(({a}) + ({b}))
              - lgamma(({a}) + 1 + n) + lgamma(({a}) + 1) + n * ln({y})))))"""

    x, y = f"({df} / ({df} + {t2}))", f"({t2} / ({df} + {t2}))"
    return f"""CASE WHEN {t2} = 0 THEN 1 WHEN {t2} IS NULL THEN NULL
      WHEN {x} <= 0.5 THEN {series(f"{df} / 2", "0.5", x)}
      ELSE 1 - {series("0.5", f"{df} / 2", y)} END"""


def _welch(place: str, feature: str, metric: str, literal: bool = False) -> list[str]:
    """From CTEs ``analysed`` and ``baseline`` to one p-value per place, category and feature.

    literal: cells without orders make an observation of their own.
    """
    apart = ", total_order = 0" if literal else ""

    def daily(name: str, source: str, keys: str) -> str:
        value = _ratio(f"sum({NUMERATOR[metric]})", "sum(total_detailview)")
        return f"""
{name} AS (
  SELECT {keys}category, {feature} AS feature_value, order_date, {value} AS value
  FROM {source} WHERE category IS NOT NULL AND {feature} IS NOT NULL
  GROUP BY {keys}category, {feature}, order_date{apart})"""

    def moment(name: str, source: str, keys: str) -> str:
        return f"""
{name} AS (
  SELECT {keys}category, feature_value, count(*) AS n, avg(value) AS mean,
    CASE WHEN count(*) > 1 AND min(value) < max(value) THEN var_samp(value) END AS var
  FROM {source} GROUP BY {keys}category, feature_value)"""

    first = f"{place}, "
    return [
        daily("daily_a", "analysed", first),
        daily("daily_b", "baseline", ""),
        moment("moment_a", "daily_a", first),
        moment("moment_b", "daily_b", ""),
        f"""
statistic AS (
  SELECT a.{place}, a.category, a.feature_value, a.n AS n_a, b.n AS n_b,
    (a.mean - b.mean) ** 2 / (a.var / a.n + b.var / b.n) AS t2,
    (a.var / a.n + b.var / b.n) ** 2
      / ((a.var / a.n) ** 2 / (a.n - 1) + (b.var / b.n) ** 2 / (b.n - 1)) AS df
  FROM moment_a a LEFT JOIN moment_b b
    ON a.category = b.category AND a.feature_value = b.feature_value)""",
        f"""
tested AS (
  SELECT {place}, category, feature_value, n_a, n_b, {_two_sided_p("t2", "df")} AS p_value
  FROM statistic)""",
    ]


# Filters on attribute values; a list stands for the values the US products have.
_US_VALUES = "(SELECT {0} FROM attributes WHERE market_sku LIKE '%US-%')"
_CHOSEN = (
    "category IN ('SMALL', 'LARGE') AND collection IN ('widget', 'bolt') AND subcategory IN "
    + _US_VALUES.format("subcategory")
)
_TWO_CHOSEN = "category IN ('SMALL', 'LARGE') AND collection IN " + _US_VALUES.format("collection")


def _offered(*features: str) -> str:
    return " AND ".join(f"{name} IN {_US_VALUES.format(name)}" for name in features)


def _sides(place: str, places, baseline: str, overseas: bool = False, keep: str = "true"):
    """CTEs ``shared`` (all analysed cells with the orders they are a share of), ``analysed`` and ``baseline``."""
    parts = _cells("cells", place, overseas)
    if baseline in DMAS or place == "region":
        other = "cells"
    else:
        other = "regional"
        parts += _cells("regional", "region", overseas)
    if baseline == "US All":
        chosen = "true"
    else:
        chosen = f"{'dma' if baseline in DMAS else 'region'} = '{baseline}'"
    return [
        *parts,
        f"""
shared AS (
  SELECT *, sum(total_order) OVER (PARTITION BY {place}) AS of_total,
    sum(total_order) OVER (PARTITION BY {place}, category) AS of_category
  FROM cells)""",
        f"\nanalysed AS (SELECT * FROM shared WHERE {place} IN ({_quoted(places)}) AND {keep})",
        f"\nbaseline AS (SELECT * FROM {other} WHERE {chosen} AND {keep})",
    ]


def _comparison(place: str, feature: str, metric: str, floors=(100, 0, 10, 100)) -> list[str]:
    """CTE ``compared``: gated rows with all measures, over the CTEs of ``_sides``.

    floors: of cost per SKU, metric, orders and price.
    """
    whole = "of_total" if feature == "category" else "of_category"
    name, numerator = METRIC[metric], NUMERATOR[metric]
    label = {"market_sku": "sku_name", "market_spu": "spu_name"}.get(feature)
    labels = f"(SELECT {feature} AS code, min({label}) AS label FROM attributes GROUP BY 1)" if label else ""
    return [
        _costs(),
        f"""
a AS (
  {_feature_sums(place, feature)}, {_ratio("sum(total_order)", f"max({whole})")} AS order_percent
  FROM analysed WHERE category IS NOT NULL AND {feature} IS NOT NULL GROUP BY ALL),
b AS (
  SELECT category, {feature} AS feature_value,
    {_ratio(f"sum({numerator})", "sum(total_detailview)")} AS metric
  FROM baseline WHERE category IS NOT NULL AND {feature} IS NOT NULL GROUP BY ALL),
c AS (
  SELECT category, {feature} AS feature_value, sum(country_total_cost) AS cost
  FROM costs WHERE category IS NOT NULL AND {feature} IS NOT NULL GROUP BY ALL),
measured AS (
  SELECT a.*, {"l.label," if label else ""}
    {_ratio("total_revenue", "total_quantity")} AS average_price_analysed,
    CAST(cost AS DOUBLE) / sku_count AS country_total_cost_per_sku,
    {_ratio(numerator, "total_detailview")} AS {name}_analysed,
    coalesce(b.metric, 0) AS {name}_baseline,
    CASE WHEN b.metric <> 0 THEN {_ratio(numerator, "total_detailview")} / b.metric - 1 END
      AS metric_diff_percent
  FROM a LEFT JOIN b ON a.category = b.category AND a.feature_value = b.feature_value
    LEFT JOIN c ON a.category = c.category AND a.feature_value = c.feature_value
    {f"LEFT JOIN {labels} l ON a.feature_value = l.code" if label else ""}),
compared AS (
  SELECT *, metric_diff_percent * order_percent AS weighted_score FROM measured
  WHERE country_total_cost_per_sku >= {floors[0]} AND {name}_analysed >= {floors[1]}
    AND total_order >= {floors[2]} AND average_price_analysed >= {floors[3]})""",
    ]


def _head(feature: str) -> str:
    key = "category || ': ' || feature_value AS \"cate-feature\""
    if feature == "category":
        return f"{key}, category, sku_count"
    label = {"market_sku": "label AS sku_name, ", "market_spu": "label AS spu_name, "}.get(feature, "")
    return f"{key}, feature_value AS {feature}, {label}sku_count, category"


_REVENUE = "CAST(total_revenue AS DOUBLE) AS total_revenue"
_COST = "CAST(country_total_cost AS DOUBLE) AS country_total_cost"


def _tail(metric: str) -> str:
    name = METRIC[metric]
    return f"""{_REVENUE}, total_quantity, total_order, total_detailview, average_price_analysed,
  country_total_cost_per_sku, {name}_analysed, {name}_baseline, metric_diff_percent,
  round(order_percent, 9) AS order_percent, round(weighted_score, 9) AS weighted_score"""


_TESTED = f"""round(p_value, 6) AS p_value,
  CASE WHEN p_value IS NULL THEN '{NOTE}' END AS p_note"""


def _compare(
    place: str, analysed: str, baseline: str, feature: str, metric: str, rank: str = "DESC", limit: int = 30,
    keep: str = "true", floors=(100, 0, 10, 100), literal: bool = False,
) -> str:
    parts = [
        *_sides(place, [analysed], baseline, keep=keep),
        *_comparison(place, feature, metric, floors),
        *_welch(place, feature, metric, literal),
    ]
    return _with(
        parts,
        f"""SELECT {_head(feature)}, {_tail(metric)}, {_TESTED}
FROM (SELECT * FROM compared ORDER BY weighted_score {rank} NULLS LAST, category, feature_value LIMIT {limit})
  LEFT JOIN tested USING ({place}, category, feature_value)""",
    )


def _rank(
    place: str, metric: str, feature: str, keep: str, places=None, floors=(100, 0, 10, 100), literal: bool = False
) -> str:
    places = places or (US_REGIONS if place == "region" else DMAS)
    parts = [
        *_sides(place, places, "US All", overseas=True, keep=keep),
        *_comparison(place, feature, metric, floors),
        *_welch(place, feature, metric, literal),
    ]
    shown = {"region": 'region AS "Region"', "dma": 'dma AS "DMA"'}[place]
    return _with(
        parts,
        f"""SELECT {_head(feature)}, {_tail(metric)}, {shown}, {_TESTED}
FROM compared LEFT JOIN tested USING ({place}, category, feature_value)""",
    )


def _welch_table(place: str, places, baseline: str, feature: str, metric: str, overseas=False, where="true"):
    parts = [*_sides(place, places, baseline, overseas), *_welch(place, feature, metric)]
    return _with(
        parts,
        f"SELECT {place}, category, feature_value, {_TESTED} FROM tested WHERE {where}",
    )


def _fact(feature: str, keep: str) -> str:
    share = "share_total" if feature == "category" else "share_category"
    label = {"market_sku": "sku_name", "market_spu": "spu_name"}.get(feature)
    join = (
        f"LEFT JOIN (SELECT {feature} AS code, min({label}) AS label FROM attributes GROUP BY 1) l"
        " ON feature_value = l.code"
        if label
        else ""
    )
    return _with(
        [
            *_country(),
            f"""
shared AS (
  SELECT *, {_share("")} AS share_total, {_share("category")} AS share_category FROM country),
summed AS (
  {_feature_sums("", feature)}, CAST(sum(atc) AS BIGINT) AS atc,
    coalesce(sum({share}), 0) AS order_percent, sum(country_total_cost) AS cost
  FROM shared WHERE category IS NOT NULL AND {feature} IS NOT NULL AND {keep} GROUP BY ALL),
facts AS (
  SELECT *, {_ratio("total_revenue", "total_quantity")} AS average_price,
    {_ratio("cost", "sku_count")} AS country_total_cost_per_sku,
    {_ratio("total_revenue", "total_detailview")} AS rev_per_dv,
    {_ratio("total_order", "total_detailview")} AS CR
  FROM summed)""",
        ],
        f"""SELECT {_head(feature)}, {_REVENUE}, total_quantity, average_price, total_order,
  total_detailview, atc, country_total_cost_per_sku, rev_per_dv, CR,
  round(order_percent, 9) AS order_percent
FROM facts {join}
WHERE country_total_cost_per_sku >= 100 AND rev_per_dv >= 0 AND CR >= 0 AND total_order >= 10
  AND average_price >= 100""",
    )


_P_TEXT = f"coalesce(format('{{:,.2f}}', p_value), '{NOTE}')"


def _money(column: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({column} AS DOUBLE))"


def _percent(column: str) -> str:
    return f"format('{{:.2f}}', {column} * 100) || '%'"


def _format_basic() -> str:
    parts = [
        *_sides("region", ["US West"], "US All"),
        *_comparison("region", "color_tone", "rev"),
        *_welch("region", "color_tone", "rev"),
    ]
    return _with(
        parts,
        f"""SELECT category || ': ' || feature_value AS "Category: Feature",
  feature_value AS "Color Tone", format('{{:,}}', sku_count) AS "SKU Count", category AS "Category",
  {_money("total_revenue")} AS "Revenue_Analysed",
  format('{{:,}}', total_quantity) AS "Quantity_Analysed",
  {_money("average_price_analysed")} AS "Ave. Price_Analysed",
  format('{{:,}}', total_order) AS "Order_Analysed",
  format('{{:,}}', total_detailview) AS "Detailview_Analysed",
  {_money("country_total_cost_per_sku")} AS "Country Average Cost per SKU",
  format('{{:,.2f}}', rev_per_dv_analysed) AS "Rev/DV_Analysed",
  format('{{:,.2f}}', rev_per_dv_baseline) AS "Rev/DV_Baseline",
  {_percent("metric_diff_percent")} AS "%Metric Difference",
  {_percent("order_percent")} AS "%Order", {_percent("weighted_score")} AS "Weighted Score",
  {_P_TEXT} AS "P-Value"
FROM (SELECT * FROM compared ORDER BY weighted_score DESC NULLS LAST, category, feature_value LIMIT 30)
  LEFT JOIN tested USING (region, category, feature_value)""",
    )


def _format_two_feature() -> str:
    parts = [
        *_sides("region", US_REGIONS, "US All", overseas=True, keep=_offered("category", "collection")),
        *_comparison("region", "collection", "cr"),
        *_welch("region", "collection", "cr"),
    ]
    return _with(
        parts,
        f"""SELECT feature_value AS "Collection", format('{{:,}}', sku_count) AS "SKU Count",
  category AS "Category", {_money("total_revenue")} AS "Revenue_Analysed",
  format('{{:,}}', total_quantity) AS "Quantity_Analysed",
  {_money("average_price_analysed")} AS "Ave. Price_Analysed",
  format('{{:,}}', total_order) AS "Order_Analysed",
  format('{{:,}}', total_detailview) AS "Detailview_Analysed",
  {_money("country_total_cost_per_sku")} AS "Country Average Cost per SKU",
  {_percent("CR_analysed")} AS "CR_Analysed", {_percent("CR_baseline")} AS "CR_Baseline",
  {_percent("metric_diff_percent")} AS "%Metric Difference",
  {_percent("order_percent")} AS "%Order", {_percent("weighted_score")} AS "Weighted Score",
  region AS "Region", {_P_TEXT} AS "P-Value"
FROM compared LEFT JOIN tested USING (region, category, feature_value)""",
    )


_DIMENSIONS = (
    "market_sku",
    "market_spu",
    "category",
    "subcategory",
    "collection",
    "color_tone",
    "material_helper",
)
_SCORED = [*_sides("region", ["US West"], "US All"), *_comparison("region", "market_sku", "rev")]
_SCORE_ROWS = """SELECT category, feature_value, round(weighted_score, 9) AS weighted_score
FROM compared ORDER BY compared.weighted_score {0} NULLS LAST, category, feature_value LIMIT 10"""
_WEST = ("region", ["US West"], "US All")
_NY = ["New York, NY"]

ORACLE_SQL: dict[str, str] = {
    "sku_attributes": _with([], f"SELECT market_sku, {ATTRIBUTES} FROM attributes"),
    "order_cells_region": _with([_orders("o", "region")], f"SELECT * REPLACE ({_REVENUE}) FROM o"),
    "order_cells_dma": _with([_orders("o", "dma")], f"SELECT * REPLACE ({_REVENUE}) FROM o"),
    "order_cells_country": _with([_orders("o", "")], f"SELECT * REPLACE ({_REVENUE}) FROM o"),
    "view_cells_region": _with([_views("v", "region")], "SELECT * FROM v"),
    "view_cells_incl_overseas": _with([_views("v", "region", True)], "SELECT * FROM v"),
    "view_cells_dma": _with([_views("v", "dma")], "SELECT * FROM v"),
    "view_cells_country": _with([_views("v", "")], "SELECT * FROM v"),
    "cost_by_sku": _with(
        [_costs()], f"SELECT * REPLACE ({_COST}) FROM costs"
    ),
    "cost_by_sku_day": _with(
        [_costs(True)],
        f"SELECT * REPLACE ({_COST}) FROM costs",
    ),
    "date_range": _with(
        [],
        """SELECT spree_so_id, order_date FROM fact_saleorder
WHERE spree_channel = 'web' AND market = 'US' AND classification = 'complete'
  AND order_type = 'Goods' AND pure_swatch_order_flag = 'N' AND order_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    ),
    "option_list": _with(
        [],
        " UNION ALL ".join(
            f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM attributes"
            f" WHERE market_sku LIKE '%US-%' AND {d} IS NOT NULL"
            for d in _DIMENSIONS
        ),
    ),
    "key_union": _with(
        [_orders("o", "region"), _views("v", "region")],
        """SELECT market_sku, region, order_date FROM o
UNION SELECT market_sku, region, order_date FROM v""",
    ),
    "align_region": _with(_cells("cells", "region"), f"SELECT * REPLACE ({_REVENUE}) FROM cells"),
    "align_dma": _with(_cells("cells", "dma"), f"SELECT * REPLACE ({_REVENUE}) FROM cells"),
    "align_country": _with(
        _country(),
        f"SELECT * REPLACE ({_REVENUE}, {_COST}) FROM country",
    ),
    "feature_key": _with(
        _cells("cells", "region"),
        """SELECT market_sku, region, order_date, material_helper AS feature_value,
  category || ': ' || material_helper AS "cate-feature" FROM cells""",
    ),
    "order_share_total": _with(
        _cells("cells", "region"),
        f"""SELECT market_sku, region, order_date, category, total_order,
  CASE WHEN region IS NOT NULL THEN {_share("region")} END AS order_percent_of_total FROM cells""",
    ),
    "order_share_category": _with(
        _cells("cells", "region"),
        f"""SELECT market_sku, region, order_date, category, total_order,
  CASE WHEN region IS NOT NULL THEN {_share("region, category")} END AS order_percent_of_category FROM cells""",
    ),
    "order_share_country": _with(
        _country(),
        f"""SELECT market_sku, order_date, total_order,
  {_share("")} AS order_percent_of_total,
  {_share("category")} AS order_percent_of_category FROM country""",
    ),
    "filter_options": _with(
        _cells("cells", "region"), f"SELECT * REPLACE ({_REVENUE}) FROM cells WHERE {_CHOSEN}"
    ),
    "two_feature_filter": _with(
        _cells("cells", "region", True), f"SELECT * REPLACE ({_REVENUE}) FROM cells WHERE {_TWO_CHOSEN}"
    ),
    "feature_summary": _with(
        [*_cells("cells", "region"), f"\ns AS ({_feature_sums('region', 'collection')} FROM cells GROUP BY ALL)"],
        f"SELECT * REPLACE ({_REVENUE}) FROM s WHERE feature_value IS NOT NULL",
    ),
    "baseline_summary": _with(
        _cells("cells", "region"),
        f"""SELECT category, color_tone AS feature_value,
  {_ratio("sum(total_revenue)", "sum(total_detailview)")} AS metric_baseline
FROM cells GROUP BY ALL""",
    ),
    "cost_by_feature": _with(
        [_costs()],
        """SELECT category, material_helper AS feature_value,
  CAST(sum(country_total_cost) AS DOUBLE) AS country_total_cost
FROM costs WHERE category IS NOT NULL AND material_helper IS NOT NULL GROUP BY ALL""",
    ),
    "ratios": _with(
        [*_cells("cells", "region"), f"\ns AS ({_feature_sums('region', 'subcategory')} FROM cells GROUP BY ALL)"],
        f"""SELECT region, category, feature_value,
  {_ratio("total_revenue", "total_detailview")} AS rev_per_dv,
  {_ratio("total_order", "total_detailview")} AS CR,
  {_ratio("total_revenue", "total_quantity")} AS average_price FROM s""",
    ),
    "threshold_gate": _with(
        [*_sides(*_WEST), *_comparison("region", "subcategory", "rev")],
        f"SELECT region, category, feature_value, sku_count, {_tail('rev')} FROM compared",
    ),
    "top_k": _with(_SCORED, _SCORE_ROWS.format("DESC")),
    "bottom_k": _with(_SCORED, _SCORE_ROWS.format("ASC")),
    "daily_metric": _with(
        [*_sides(*_WEST), *_welch("region", "category", "rev")],
        """SELECT 'region_analysed' AS "group", category, feature_value, order_date,
  value FROM daily_a
UNION ALL SELECT 'region_baseline', category, feature_value, order_date, value FROM daily_b""",
    ),
    "compare_region_vs_all_rev": _compare("region", "US West", "US All", "category", "rev"),
    "compare_region_vs_all_cr": _compare("region", "US West", "US All", "collection", "cr"),
    "compare_region_vs_region_rev": _compare("region", "US West", "US East", "subcategory", "rev"),
    "compare_region_vs_region_cr": _compare(
        "region", "US West", "US East", "material_helper", "cr", rank="ASC"
    ),
    "compare_dma_vs_dma_rev": _compare("dma", _NY[0], "Los Angeles CA", "category", "rev"),
    "compare_dma_vs_dma_cr": _compare("dma", _NY[0], "Los Angeles CA", "collection", "cr"),
    "compare_dma_vs_region_rev": _compare("dma", _NY[0], "US East", "color_tone", "rev"),
    "compare_dma_vs_region_cr": _compare("dma", _NY[0], "US East", "category", "cr"),
    "compare_dma_vs_all_rev": _compare("dma", _NY[0], "US All", "material_helper", "rev"),
    "compare_dma_vs_all_cr": _compare("dma", _NY[0], "US All", "category", "cr"),
    "compare_region_options": _compare("region", "US West", "US All", "category", "rev", keep=_CHOSEN),
    "compare_color_tone_options": _compare(
        "region", "US West", "US East", "color_tone", "cr", keep=f"{_CHOSEN} AND {_offered('color_tone')}"
    ),
    "compare_dma_region_options": _compare("dma", _NY[0], "US East", "category", "cr", keep=_CHOSEN),
    "compare_blank_options": _compare(
        "region", "US West", "US All", "material_helper", "rev",
        keep=_offered("category", "subcategory", "collection", "material_helper"),
    ),
    "compare_sku_labels": _compare("region", "US West", "US All", "market_sku", "rev", limit=100),
    "compare_spu_labels": _compare("region", "US West", "US All", "market_spu", "rev", limit=100),
    "welch_region_rev": _welch_table(*_WEST, "collection", "rev"),
    "welch_region_cr": _welch_table("region", ["US West"], "US East", "collection", "cr"),
    "welch_dma_rev": _welch_table("dma", _NY, "Los Angeles CA", "color_tone", "rev"),
    "welch_dma_cr": _welch_table("dma", _NY, "US All", "color_tone", "cr"),
    "welch_all_regions_rev": _welch_table("region", US_REGIONS, "US All", "collection", "rev", True),
    "welch_all_regions_cr": _welch_table("region", US_REGIONS, "US All", "color_tone", "cr", True),
    "welch_all_dmas_rev": _welch_table("dma", DMAS, "US All", "material_helper", "rev", True),
    "welch_all_dmas_cr": _welch_table("dma", DMAS, "US All", "category", "cr", True),
    "welch_pvalue": _with(
        [*_sides("region", US_REGIONS, "US All", True), *_welch("region", "market_sku", "rev")],
        """SELECT region, feature_value, n_a, n_b, round(p_value, 6) AS p_value
FROM tested WHERE p_value IS NOT NULL""",
    ),
    "welch_small_sample": _welch_table(*_WEST, "market_spu", "rev", where="p_value IS NULL"),
    "rank_regions_rev": _rank("region", "rev", "category", _offered("category")),
    "rank_regions_cr": _rank("region", "cr", "market_spu", _offered("collection", "market_spu")),
    "rank_dmas_rev": _rank("dma", "rev", "collection", _TWO_CHOSEN),
    "rank_dmas_cr": _rank("dma", "cr", "category", _offered("category")),
    "country_fact_rev": _fact("category", _offered("category")),
    "country_fact_cr": _fact("market_sku", _offered("market_sku")),
    "country_fact_two_features": _fact("collection", _TWO_CHOSEN),
    "format_basic": _format_basic(),
    "format_two_feature": _format_two_feature(),
}

ORACLE_SQL |= {
    "stored_order_cells_region": ORACLE_SQL["order_cells_region"],
    "stored_order_cells_dma": ORACLE_SQL["order_cells_dma"],
    "kept_align_region": ORACLE_SQL["align_region"],
    "kept_align_dma": ORACLE_SQL["align_dma"],
    "kept_align_country": ORACLE_SQL["align_country"],
    "kept_compare_region_vs_all": ORACLE_SQL["compare_region_vs_all_rev"],
    "feature_summary_of_days": ORACLE_SQL["feature_summary"],
    "feature_summary_of_places": _with(
        [*_cells("cells", "region"), f"\ns AS ({_feature_sums('order_date', 'collection')} FROM cells GROUP BY ALL)"],
        f"SELECT * REPLACE ({_REVENUE}) FROM s WHERE feature_value IS NOT NULL",
    ),
}


def _australian(sql: str) -> str:
    """The same over the other market."""
    return sql.replace("market = 'US'", "market = 'AU'").replace("%US-%", "%AU-%")


_OPEN = (0, 0, 1, 0)


def _in_order(parts: list[str], order: str, columns: str, source: str = "compared") -> str:
    return _with(parts, f"SELECT row_number() OVER (ORDER BY {order}) AS \"Row\", {columns} FROM {source}")


_RANKED = [
    *_sides("region", US_REGIONS, "US All", overseas=True, keep=_offered("category")),
    *_comparison("region", "category", "rev"),
]
_KEY = "category || ': ' || feature_value"
_BY_SCORE = "weighted_score DESC NULLS LAST, category, feature_value"
_FACTS = _fact("category", _offered("category"))

ORACLE_SQL |= {
    # the other market
    "au_order_cells_region": _australian(ORACLE_SQL["order_cells_region"]),
    "au_align_country": _australian(ORACLE_SQL["align_country"]),
    "au_compare_region_vs_all_rev": _australian(
        _compare("region", "AU Sydney", "US All", "category", "rev", floors=_OPEN)
    ),
    "au_compare_region_vs_region_cr": _australian(
        _compare("region", "AU Sydney", "AU Perth", "collection", "cr", floors=_OPEN)
    ),
    "au_rank_regions_rev": _australian(
        _rank("region", "rev", "category", _offered("category"), AU_REGIONS, _OPEN)
    ),
    "au_country_fact_rev": _australian(ORACLE_SQL["country_fact_rev"]),
    # cells without orders as days of their own
    "literal_days_compare": _compare("region", "US West", "US All", "category", "rev", literal=True),
    "literal_days_rank_cr": _rank("region", "cr", "category", _offered("category"), literal=True),
    "literal_days_welch": _with(
        [*_sides(*_WEST), *_welch("region", "collection", "rev", True)],
        f"SELECT region, category, feature_value, {_TESTED} FROM tested",
    ),
    # thresholds that are not the usual ones; the conversion rate is entered as a percentage
    "thresholds_cr_percent": _compare(
        "region", "US West", "US All", "collection", "cr", floors=(20, 250 / 100, 5, 10)
    ),
    "thresholds_rev_per_dv": _compare(
        "region", "US West", "US All", "subcategory", "rev", floors=(50, 70000, 3, 200)
    ),
    # results in their order
    "ordered_compare": _in_order(
        [*_sides(*_WEST), *_comparison("region", "collection", "rev")], _BY_SCORE,
        "category, feature_value AS collection", f"(SELECT * FROM compared ORDER BY {_BY_SCORE} LIMIT 30)",
    ),
    "ordered_rank_regions": _in_order(
        _RANKED, f"{_KEY} DESC, weighted_score DESC NULLS LAST, region",
        f"{_KEY} AS \"cate-feature\", region AS \"Region\"",
    ),
    "ordered_country_fact": f"""SELECT row_number() OVER (ORDER BY rev_per_dv DESC, category) AS "Row",
  category, rev_per_dv FROM ({_FACTS})""",
    # files
    "product_list_from_csv": _with([], f"SELECT {', '.join(_DIMENSIONS)} FROM attributes"),
    "report_read_back": _format_basic().replace(
        "SELECT category || ': '",
        f'SELECT row_number() OVER (ORDER BY {_BY_SCORE}) AS "Row", category || \': \'',
    ),
}


# What the test star makes up, and how it reads where every order, place and product counts.
_MADE_UP = {
    "WHEN n_nationkey = 7 THEN NULL WHEN n_nationkey < 20": "WHEN n_nationkey < 20",
    "CASE WHEN o_custkey % 11 = 0 THEN 'Service' ELSE 'Goods' END": "'Goods'",
    "CASE WHEN o_orderkey % 13 = 0 THEN 'Y' ELSE 'N' END": "'N'",
    "CASE WHEN p_partkey % 19 > 0 THEN split_part(p_name, ' ', 2) END": "split_part(p_name, ' ', 2)",
}


def _whole(sql: str) -> str:
    """The same over all rows of the test tables."""
    for made_up, plain in _MADE_UP.items():
        sql = sql.replace(made_up, plain)
    return sql


_WHOLE = (
    "order_cells_region",
    "order_cells_dma",
    "order_cells_country",
    "key_union",
    "feature_key",
    "welch_dma_rev",
)
ORACLE_SQL |= {name: _whole(ORACLE_SQL[name]) for name in _WHOLE}

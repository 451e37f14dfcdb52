"""The derived tables once more, as SQL common table expressions for the side-by-side check."""

from __future__ import annotations

from wheelbase import vocab
from workload import views


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def by_type(labels: dict[str, str]) -> str:
    return "CASE p_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in labels.items()) + " END"


def keyword_case(text: str, keyword_rules) -> str:
    branches = []
    for words, label in keyword_rules:
        hits = " OR ".join(f"contains({text}, {quoted(w)})" for w in words)
        branches.append(f"WHEN {hits} THEN {quoted(label)}")
    return "CASE " + " ".join(branches) + " END"


def stable_id(key: str) -> str:
    return f"'car_' || substr(sha256({key}), 1, 12)"


def half_up(value: str, digits: int) -> str:
    """Half-up rounding of the decimal text of a double, as Spark rounds doubles."""
    return f"round(({value})::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


def tags(fuel: str = "fuel_consumption") -> str:
    hybrid = f"energy_type IN {in_list(vocab.HYBRID_CLASSES)}"
    return f"""list_filter([
      CASE WHEN energy_type = '纯电' OR {hybrid} OR {fuel} <= 8.5 THEN '城市通勤' END,
      CASE WHEN seats >= 5 AND body_type IN ('SUV', 'MPV') THEN '家庭出行' END,
      CASE WHEN energy_type = '燃油' OR {hybrid} OR range_km >= 500 THEN '长途出行' END], lambda t: t IS NOT NULL)"""


COMPLETENESS = "round((6 + " + " + ".join(
    f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in vocab.COMPLETENESS_FIELDS
) + ") / 12.0::DOUBLE, 2)"
NUMBER_PATTERN = r"'^([-+]?\d+(?:\.\d+)?)\s*(万|%|[A-Za-z]+(?:/[A-Za-z0-9]+)?|公里|小时|秒)?$'"
STATE = """CASE WHEN replace({0}, ' ', '') IN ('', '-', '--') THEN 'missing'
      WHEN contains({0}, '●') AND contains({0}, '○') THEN 'mixed'
      WHEN contains({0}, '●') THEN 'standard' WHEN contains({0}, '○') THEN 'optional' ELSE 'value' END"""
CORE_OK = """(r.body_type = '' OR i.body_type = r.body_type) AND (r.energy_type = '' OR i.energy_type = r.energy_type)
      AND (r.min_seats IS NULL OR coalesce(i.seats >= r.min_seats, false))
      AND (r.min_sales IS NULL OR coalesce(i.sales >= r.min_sales, false))
      AND i.price_max_wan >= r.budget_min_wan"""

ENERGY_AT = f"{sql_list(views.ENERGY_TEXTS)}[((l_partkey + l_linenumber % 2) % 9 + 1)::INT]"
REQUEST_NUMBER = r"'^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$'"

# Polynomials of the error function, written from the same published coefficients.
def _polynomial(x: str, coefficients) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def erfc(x: str) -> str:
    from wheelbase.functions import statistics as s

    square = f"({x} * {x})"
    inverse = f"(1.0::DOUBLE / greatest({square}, 1.0::DOUBLE))"
    small = f"1.0::DOUBLE - {x} * {_polynomial(square, s.ERF_SMALL_NUM)} / {_polynomial(square, s.ERF_SMALL_DEN)}"
    mid = f"exp(-{square}) * {_polynomial(x, s.ERFC_MID_NUM)} / {_polynomial(x, s.ERFC_MID_DEN)}"
    ratio = f"{inverse} * {_polynomial(inverse, s.ERFC_TAIL_NUM)} / {_polynomial(inverse, s.ERFC_TAIL_DEN)}"
    tail = f"exp(-{square}) * ({s.INV_SQRT_PI!r}::DOUBLE - {ratio}) / greatest({x}, 1.0::DOUBLE)"
    return f"CASE WHEN {x} <= 0.46875 THEN {small} WHEN {x} <= 4.0 THEN {mid} WHEN {x} <= 26.5 THEN {tail} WHEN {x} IS NOT NULL THEN 0.0 END"


# name -> (needed expressions, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "trims": ((), f"""
      SELECT l_orderkey || '-' || l_linenumber AS trim_id, l_partkey::VARCHAR AS series_id,
        p_name || ' ' || year(l_shipdate) || '款' AS trim_name, year(l_shipdate)::INT AS model_year,
        {ENERGY_AT} AS energy_type_raw, {by_type(views.STRUCTURES)} AS body_structure,
        CASE WHEN p_size % 10 = 0 THEN '5/7座' WHEN p_size % 10 = 9 THEN '-' ELSE '●' || (2 + p_size % 9) END AS seats_raw
      FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "raw_attributes": ((), f"""
      SELECT trim_id, series_id, a.group_id, a.group_name, a.parameter_name, a.value_raw FROM (
        SELECT l_orderkey || '-' || l_linenumber AS trim_id, l_partkey::VARCHAR AS series_id, unnest([
          {{'group_id': '0', 'group_name': '基本参数', 'parameter_name': '厂商',
            'value_raw': CASE WHEN l_suppkey % 50 = 0 THEN '-' ELSE p_brand END}},
          {{'group_id': '0', 'group_name': '基本参数', 'parameter_name': '级别', 'value_raw': {by_type(views.LEVELS)}}},
          {{'group_id': '0', 'group_name': '基本参数', 'parameter_name': '厂商指导价(元)',
            'value_raw': CASE WHEN l_linenumber = 7 THEN '暂无报价' ELSE
              (floor(l_extendedprice / 50)::BIGINT // 100) || '.' || lpad((floor(l_extendedprice / 50)::BIGINT % 100)::VARCHAR, 2, '0') || '万' END}},
          {{'group_id': '1', 'group_name': '发动机', 'parameter_name': '工信部综合油耗(L)',
            'value_raw': CASE WHEN l_tax >= 0.075 THEN '' ELSE
              ((l_quantity::BIGINT * 2 + 30) // 10) || '.' || ((l_quantity::BIGINT * 2 + 30) % 10) END}},
          {{'group_id': '1', 'group_name': '发动机', 'parameter_name': '最大马力(Ps)', 'value_raw': (l_quantity::BIGINT * 9)::VARCHAR}},
          {{'group_id': '0', 'group_name': '基本参数', 'parameter_name': '车款人气', 'value_raw': l_suppkey::VARCHAR}},
          {{'group_id': l_linenumber::VARCHAR, 'group_name': '装备' || l_linenumber, 'parameter_name': '配置' || l_linestatus,
            'value_raw': CASE WHEN l_discount >= 0.095 THEN '主：●&nbsp;副：○' WHEN l_returnflag = 'A' THEN '●' WHEN l_returnflag = 'N' THEN '○' ELSE '-' END}},
          {{'group_id': l_linenumber::VARCHAR, 'group_name': '性能' || l_linenumber, 'parameter_name': '指标' || l_linestatus || '(%)',
            'value_raw': CASE WHEN l_discount BETWEEN 0.045 AND 0.055 THEN '12×34' ELSE (round(l_tax * 100)::BIGINT + l_quantity::BIGINT) || '%' END}},
          {{'group_id': '9', 'group_name': '外观', 'parameter_name': '颜色', 'value_raw': ['红', '白', '黑'][(year(l_shipdate) % 3 + 1)::INT]}}
        ]) AS a
        FROM lineitem JOIN part ON l_partkey = p_partkey)"""),
    "attributes": (("raw_attributes",), f"""
      SELECT *, group_id || '|' || group_name || '|' || parameter_name AS parameter_key,
        try_cast(nullif(regexp_extract(value_text, {NUMBER_PATTERN}, 1), '') AS DOUBLE) AS value_numeric,
        coalesce(nullif(regexp_extract(value_text, {NUMBER_PATTERN}, 2), ''),
          trim(regexp_extract(parameter_name, '\\(([^()]*)\\)\\s*$', 1))) AS value_unit,
        {STATE.format('value_text')} AS equipment_state
      FROM (SELECT *, trim(regexp_replace(replace(value_raw, '&nbsp;', ' '), '\\s+', ' ', 'g')) AS value_text FROM raw_attributes)"""),
    "measures": ((), """
      SELECT l_partkey::VARCHAR AS series_id, strftime(l_shipdate, '%Y-%m') AS sales_period,
        CASE WHEN l_partkey % 17 <> 0 THEN sum(l_quantity)::INT END AS sales
      FROM lineitem GROUP BY l_partkey, strftime(l_shipdate, '%Y-%m')"""),
    "series": ((), f"""
      SELECT p_partkey::VARCHAR AS series_id, p_name || ' ' || p_partkey AS series_name,
        round((p_retailprice - 895) * 0.5, 2) AS list_price_min_wan,
        round(round((p_retailprice - 895) * 0.5, 2) + (p_size % 5) * 0.5, 2) AS list_price_max_wan,
        {by_type(views.LEVELS)} AS body_hints,
        'https://catalog.example/' || p_partkey || '/' AS source_url,
        'https://catalog.example/' || p_partkey || '/options/' AS options_url,
        'https://catalog.example/' || p_partkey || '/sales/' AS sales_url, '2026-07-10' AS captured_at
      FROM part"""),
    "typed_trims": (("trims",), f"""
      SELECT trim_id, series_id, energy_type, trim(body_structure) AS body_structure,
        try_cast(nullif(regexp_extract(seats_raw, '.*([2-9])', 1), '') AS INT) AS seats, model_year
      FROM (SELECT *, {keyword_case('lower(trim(energy_type_raw))', vocab.ENERGY_RULES)} AS energy_type FROM trims)
      WHERE energy_type IS NOT NULL"""),
    "trim_summary": (("typed_trims",), """
      SELECT series_id, energy_type, min(CASE WHEN body_structure NOT IN ('', '-') THEN body_structure END) AS body_structure,
        max(seats) AS seats, max(model_year) AS model_year, count(DISTINCT trim_id) AS trim_count
      FROM typed_trims GROUP BY ALL"""),
    "attribute_columns": (("attributes", "typed_trims"), """
      SELECT series_id, energy_type,
        arg_min(value_text, (trim_id, value_text)) FILTER (parameter_name = '厂商') AS brand,
        arg_min(value_text, (trim_id, value_text)) FILTER (parameter_name = '级别') AS level_name,
        min(value_numeric) FILTER (parameter_name = '厂商指导价(元)') AS attribute_price_min,
        max(value_numeric) FILTER (parameter_name = '厂商指导价(元)') AS attribute_price_max,
        quantile_disc(value_numeric, 0.5) FILTER (parameter_name = '工信部综合油耗(L)') AS fuel_consumption,
        trunc(quantile_disc(value_numeric, 0.5) FILTER (parameter_name = '最大马力(Ps)'))::INT AS horsepower
      FROM attributes JOIN typed_trims USING (trim_id, series_id)
      WHERE parameter_name IN ('厂商', '级别', '厂商指导价(元)', '工信部综合油耗(L)', '最大马力(Ps)')
      GROUP BY series_id, energy_type"""),
    "latest_measure": (("measures",), """
      SELECT series_id, max(sales) AS sales, max(sales_period) AS sales_period FROM measures
      WHERE sales_period = (SELECT max(sales_period) FROM measures WHERE sales IS NOT NULL) AND sales >= 0
      GROUP BY series_id"""),
    "assembled": (("series", "trim_summary", "attribute_columns", "latest_measure"), """
      SELECT series_id || '-' || t.energy_type AS source_key, s.series_id, series_name AS model_name, brand,
        coalesce(attribute_price_min, list_price_min_wan) AS price_min_wan,
        coalesce(attribute_price_max, list_price_max_wan) AS price_max_wan,
        coalesce(level_name, body_hints) AS level_name, body_structure, t.energy_type, seats, NULL::DOUBLE AS range_km,
        fuel_consumption, horsepower, model_year, sales, sales_period, trim_count, source_url, options_url, sales_url,
        captured_at::DATE AS captured_at
      FROM series s JOIN trim_summary t USING (series_id)
        LEFT JOIN attribute_columns a USING (series_id, energy_type) LEFT JOIN latest_measure m USING (series_id)"""),
    "valid_catalog": (("assembled",), f"""
      SELECT * FROM (
        SELECT trim(source_key) AS source_key, trim(series_id) AS series_id, trim(model_name) AS model_name, trim(brand) AS brand,
          price_min_wan, CASE WHEN price_max_wan >= price_min_wan THEN price_max_wan ELSE price_min_wan END AS price_max_wan,
          CASE WHEN contains(level_name, 'SUV') THEN 'SUV' WHEN contains(level_name, 'MPV') THEN 'MPV'
            WHEN contains(level_name, '跑车') THEN '跑车' WHEN contains(level_name, '轻客') THEN '轻客'
            WHEN contains(body_structure, '两厢') THEN '两厢车'
            WHEN regexp_matches(level_name, '微型车|小型车|紧凑型车|中型车|中大型车|大型车') THEN '轿车' ELSE trim(body_structure) END AS body_type,
          trim(energy_type) AS energy_type, CASE WHEN seats BETWEEN 2 AND 9 THEN seats END AS seats,
          CASE WHEN range_km > 0 THEN range_km END AS range_km,
          CASE WHEN fuel_consumption BETWEEN 0.1 AND 30 THEN fuel_consumption END AS fuel_consumption,
          CASE WHEN horsepower > 0 THEN horsepower END AS horsepower,
          CASE WHEN model_year BETWEEN 2000 AND 2100 THEN model_year END AS model_year,
          CASE WHEN sales >= 0 THEN sales END AS sales, sales_period, trim_count, source_url, options_url, sales_url,
          captured_at AS updated_at
        FROM assembled)
      WHERE source_key IS NOT NULL AND model_name IS NOT NULL AND brand IS NOT NULL AND brand NOT IN ('', '-', '--')
        AND price_min_wan > 0 AND body_type IS NOT NULL AND energy_type IN {in_list(vocab.ENERGY_CLASSES)}"""),
    "catalog": (("valid_catalog",), f"""
      SELECT {stable_id('source_key')} AS car_id, *, {half_up('(price_min_wan + price_max_wan) / 2', 2)} AS price_mid_wan,
        normalized_heat AS heat_score, {tags()} AS scenario_tags, {COMPLETENESS} AS data_completeness, 'public catalog' AS source
      FROM (SELECT *, CASE WHEN sales > 0 THEN round(ln(sales + 1) / (SELECT max(ln(sales + 1)) FROM valid_catalog WHERE sales > 0), 4) END AS normalized_heat
            FROM valid_catalog)"""),
    "item_base": ((), f"""
      SELECT {stable_id("'p-' || p_partkey")} AS car_id, p_name || ' ' || p_partkey AS model_name, p_brand AS brand,
        price_min_wan, price_max_wan, round((price_min_wan + price_max_wan) / 2, 2) AS price_mid_wan,
        {by_type(views.BODIES)} AS body_type, energy_type,
        CASE WHEN p_size % 10 BETWEEN 2 AND 9 THEN p_size % 10 END AS seats,
        CASE WHEN energy_type = '纯电' THEN (300 + p_size * 10)::DOUBLE END AS range_km,
        CASE WHEN energy_type <> '纯电' THEN 5 + (p_size % 8) / 2.0::DOUBLE END AS fuel_consumption,
        CASE WHEN p_size % 7 <> 0 THEN 80 + p_size * 7 END AS horsepower,
        CASE WHEN p_size % 11 <> 0 THEN 2015 + p_size % 12 END AS model_year, sales, sales_period
      FROM (SELECT *, {sql_list(vocab.ENERGY_CLASSES)}[(p_partkey % 5 + 1)::INT] AS energy_type,
              round((p_retailprice - 895) * 0.5, 2) AS price_min_wan,
              round(round((p_retailprice - 895) * 0.5, 2) + (p_size % 5) * 0.5, 2) AS price_max_wan FROM part)
        LEFT JOIN (SELECT l_partkey, sum(l_quantity)::INT AS sales, strftime(max(l_shipdate), '%Y-%m') AS sales_period FROM lineitem GROUP BY 1)
        ON p_partkey = l_partkey"""),
    "items": (("item_base",), f"""
      SELECT *, CASE WHEN sales > 0 THEN round(ln(sales + 1) / (SELECT max(ln(sales + 1)) FROM item_base WHERE sales > 0), 4) END AS normalized_heat,
        {tags()} AS scenario_tags, {COMPLETENESS} AS data_completeness
      FROM item_base"""),
    "raw_requests": ((), f"""
      SELECT k AS request_id,
        CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN 'abc' WHEN k % 41 = 0 THEN '-5' WHEN k % 29 = 0 THEN '90'
          WHEN k % 19 = 0 THEN '2.0' WHEN k % 61 = 0 THEN '1' ELSE (3 + b % 45)::VARCHAR END AS budget_min_wan,
        CASE WHEN k % 29 = 0 THEN (4 + b % 45 + k % 6)::VARCHAR WHEN k % 19 = 0 THEN '2.45' WHEN k % 61 = 0 THEN '1.5'
          ELSE (4 + b % 45 + k % 6)::VARCHAR END AS budget_max_wan,
        CASE WHEN k % 3 = 0 THEN '' ELSE ['SUV', 'MPV', '轿车', ' 跑车 ', '两厢车'][((b + c_nationkey) % 5 + 1)::INT] END AS body_type,
        CASE WHEN k % 2 <> 0 THEN {sql_list(vocab.ENERGY_CLASSES)}[((b + c_nationkey) % 5 + 1)::INT] END AS energy_type,
        CASE WHEN k % 3 = 0 THEN []::VARCHAR[] ELSE ['Brand#' || (1 + k % 25), 'Brand#' || (1 + (k * 7) % 25), 'Brand#' || (1 + k % 25), ' '] END AS brands,
        CASE WHEN k % 53 = 0 THEN '越野' ELSE ['城市通勤', '家庭出行', '长途出行', ''][(k % 4 + 1)::INT] END AS scenario,
        CASE WHEN k % 43 = 0 THEN '12' WHEN k % 4 = 0 THEN '5' ELSE '' END AS min_seats,
        CASE WHEN k % 47 = 0 THEN '-1' WHEN k % 5 = 0 THEN (k % 1200)::VARCHAR END AS min_sales,
        CASE WHEN k % 23 = 0 THEN '9' WHEN k % 7 = 0 THEN NULL ELSE (3 + k % 3)::VARCHAR END AS "limit"
      FROM (SELECT c_custkey AS k, trunc(abs(c_acctbal))::BIGINT AS b, c_nationkey FROM customer)"""),
    "request_errors": (("raw_requests",), f"""
      SELECT *, CASE
          WHEN budget_min_wan IS NULL THEN ['MISSING_FIELD', '请填写预算下限', 'budget_min_wan']
          WHEN low IS NULL THEN ['INVALID_NUMBER', '预算下限必须是数字', 'budget_min_wan']
          WHEN low <= 0 THEN ['INVALID_BUDGET', '预算下限必须大于 0', 'budget_min_wan']
          WHEN budget_max_wan IS NULL THEN ['MISSING_FIELD', '请填写预算上限', 'budget_max_wan']
          WHEN high IS NULL THEN ['INVALID_NUMBER', '预算上限必须是数字', 'budget_max_wan']
          WHEN high <= 0 THEN ['INVALID_BUDGET', '预算上限必须大于 0', 'budget_max_wan']
          WHEN low > high THEN ['INVALID_BUDGET', '预算下限不能高于预算上限', 'budget_min_wan']
          WHEN NOT coalesce(coalesce("limit", '5')::INT BETWEEN 3 AND 5, false) THEN ['INVALID_LIMIT', '推荐数量必须是 3—5', 'limit']
          WHEN min_seats <> '' AND NOT min_seats::INT BETWEEN 2 AND 9 THEN ['INVALID_SEATS', '最低座位数必须在 2—9 之间', 'min_seats']
          WHEN min_sales IS NOT NULL AND min_sales::INT < 0 THEN ['INVALID_SALES', '最低月销量必须是非负整数', 'min_sales']
          WHEN scenario NOT IN ('', '城市通勤', '家庭出行', '长途出行') THEN ['INVALID_SCENARIO', '不支持该使用场景', 'scenario'] END AS problem
      FROM (SELECT *, CASE WHEN regexp_matches(budget_min_wan, {REQUEST_NUMBER}) THEN budget_min_wan::DOUBLE END AS low,
              CASE WHEN regexp_matches(budget_max_wan, {REQUEST_NUMBER}) THEN budget_max_wan::DOUBLE END AS high FROM raw_requests)"""),
    "requests": (("request_errors",), """
      SELECT request_id, round(low, 2) AS budget_min_wan, round(high, 2) AS budget_max_wan, trim(body_type) AS body_type,
        coalesce(trim(energy_type), '') AS energy_type,
        list_sort(list_distinct(list_filter(list_transform(brands, lambda b: trim(b)), lambda b: b <> ''))) AS brands,
        trim(scenario) AS scenario, nullif(min_seats, '')::INT AS min_seats, min_sales::INT AS min_sales,
        coalesce("limit", '5')::INT AS "limit"
      FROM request_errors WHERE problem IS NULL"""),
    "match_counts": (("items", "requests"), f"""
      SELECT r.request_id,
        count(*) FILTER (i.price_min_wan <= r.budget_max_wan) AS n_core,
        count(*) FILTER (i.price_min_wan <= r.budget_max_wan AND list_contains(r.brands, i.brand)) AS n_brand,
        count(*) FILTER (i.price_min_wan <= r.budget_max_wan AND list_contains(i.scenario_tags, r.scenario)) AS n_scenario,
        count(*) FILTER (i.price_min_wan <= r.budget_max_wan AND list_contains(r.brands, i.brand) AND list_contains(i.scenario_tags, r.scenario)) AS n_both,
        count(*) AS n_raised
      FROM requests r JOIN items i ON i.price_min_wan <= round(r.budget_max_wan * 1.1::DOUBLE, 2) AND {CORE_OK}
      GROUP BY r.request_id"""),
    "decisions": (("match_counts",), """
      SELECT *, CASE WHEN raised THEN n_raised ELSE n_fitting END AS total_candidates,
        round(budget_max_wan * 1.1::DOUBLE, 2) AS raised_ceiling,
        CASE WHEN raised THEN round(budget_max_wan * 1.1::DOUBLE, 2) ELSE budget_max_wan END AS ceiling
      FROM (SELECT *, n_fitting < 3 AND n_raised > n_fitting AS raised
        FROM (SELECT *, CASE WHEN keep_scenario THEN with_scenario WHEN keep_brand THEN n_brand ELSE n_core END AS n_fitting
          FROM (SELECT *, scenario <> '' AND with_scenario >= 3 AS keep_scenario
            FROM (SELECT *, CASE WHEN keep_brand THEN n_both ELSE n_scenario END AS with_scenario
              FROM (SELECT r.*, coalesce(n_core, 0) AS n_core, coalesce(n_brand, 0) AS n_brand, coalesce(n_scenario, 0) AS n_scenario,
                      coalesce(n_both, 0) AS n_both, coalesce(n_raised, 0) AS n_raised,
                      len(brands) > 0 AND coalesce(n_brand, 0) >= 3 AS keep_brand
                    FROM requests r LEFT JOIN match_counts c USING (request_id))))))"""),
    "relaxations": (("decisions",), """
      SELECT *, list_filter([
          CASE WHEN len(brands) > 0 AND NOT keep_brand THEN '品牌偏好（候选不足 3 款）' END,
          CASE WHEN scenario <> '' AND NOT keep_scenario THEN '使用场景（候选不足 3 款）' END,
          CASE WHEN raised THEN '预算上限放宽 10% 至 ' || printf('%.2f', raised_ceiling) || ' 万元' END], lambda t: t IS NOT NULL) AS relaxed_conditions
      FROM decisions"""),
    "candidates": (("items", "decisions"), f"""
      SELECT r.request_id, r.budget_min_wan, r.budget_max_wan, r.body_type AS want_body, r.energy_type AS want_energy, r.brands,
        r.scenario, r."limit", i.*,
        CASE WHEN list_contains(i.scenario_tags, r.scenario) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS scenario_hit,
        CASE WHEN list_contains(r.brands, i.brand) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS brand_hit,
        greatest(0.0::DOUBLE, 1 - abs(i.price_mid_wan - (r.budget_min_wan + r.budget_max_wan) / 2) / greatest(r.budget_max_wan - r.budget_min_wan, 1.0::DOUBLE)) AS price_value,
        greatest((r.budget_max_wan - r.budget_min_wan) / 3, 0.01::DOUBLE) AS third
      FROM decisions r JOIN items i ON i.price_min_wan <= r.ceiling AND {CORE_OK}
        AND (r.raised OR NOT r.keep_brand OR list_contains(r.brands, i.brand))
        AND (r.raised OR NOT r.keep_scenario OR list_contains(i.scenario_tags, r.scenario))"""),
    "scored": (("candidates",), """
      SELECT *, CASE WHEN price_mid_wan BETWEEN budget_min_wan + third AND budget_max_wan - third THEN '价格位于预算中段'
            WHEN price_mid_wan BETWEEN budget_min_wan AND budget_max_wan THEN '价格处于预算范围内' ELSE '价格在放宽后的预算范围内' END AS price_label,
        round(100 * (price_value * 0.35::DOUBLE + (CASE WHEN want_body <> '' THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN want_energy <> '' THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN scenario <> '' THEN scenario_hit * 0.15::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN len(brands) > 0 THEN brand_hit * 0.05::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN normalized_heat IS NOT NULL THEN normalized_heat * 0.05::DOUBLE ELSE 0::DOUBLE END))
          / (0.35::DOUBLE + (CASE WHEN want_body <> '' THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN want_energy <> '' THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN scenario <> '' THEN 0.15::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN len(brands) > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END)
            + (CASE WHEN normalized_heat IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END)), 1) AS score
      FROM candidates"""),
    "ranked": (("scored",), """
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, coalesce(data_completeness, 0) DESC,
          coalesce(normalized_heat, 0) DESC, model_name, car_id) AS rank FROM scored) WHERE rank <= "limit" """),
    "explained": (("ranked",), """
      SELECT *, list_distinct_ordered[1:3] AS matched_factors FROM (
        SELECT *, list_concat(
          list_transform(list_sort(list_filter([
            CASE WHEN price_value > 0 THEN {'o': -(price_value * 0.35::DOUBLE), 'l': price_label} END,
            CASE WHEN want_body <> '' THEN {'o': -(1.0::DOUBLE * 0.2::DOUBLE), 'l': '符合' || want_body || '车身偏好'} END,
            CASE WHEN want_energy <> '' THEN {'o': -(1.0::DOUBLE * 0.2::DOUBLE), 'l': '符合' || want_energy || '能源偏好'} END,
            CASE WHEN scenario <> '' AND scenario_hit > 0 THEN {'o': -(scenario_hit * 0.15::DOUBLE), 'l': '参数适合' || scenario} END,
            CASE WHEN len(brands) > 0 AND brand_hit > 0 THEN {'o': -(brand_hit * 0.05::DOUBLE), 'l': '符合品牌偏好'} END,
            CASE WHEN normalized_heat > 0 THEN {'o': -(normalized_heat * 0.05::DOUBLE), 'l': '热度表现较好'} END
            ], lambda f: f IS NOT NULL)), lambda f: f.l),
          list_filter([CASE WHEN range_km IS NOT NULL THEN '标注续航 ' || printf('%.0f', range_km) || ' 公里' END,
            CASE WHEN seats IS NOT NULL THEN '提供 ' || seats || ' 座布局' END,
            CASE WHEN horsepower IS NOT NULL THEN '标注功率 ' || horsepower || ' 马力' END], lambda t: t IS NOT NULL)) AS list_distinct_ordered
        FROM ranked)"""),
    "sets": ((), f"""
      SELECT k AS set_id, CASE WHEN k % 17 = 0 THEN [a] WHEN k % 13 = 0 THEN [a, b, c, d] WHEN k % 11 = 0 THEN [a, a]
        WHEN k % 7 = 0 THEN [a, 'car_unknown'] WHEN k % 2 = 0 THEN [a, e] ELSE [a, b, c] END AS car_ids
      FROM (SELECT c_custkey AS k, {stable_id("'p-' || c_custkey")} AS a, {stable_id("'p-' || (c_custkey + 1)")} AS b,
        {stable_id("'p-' || (c_custkey + 2)")} AS c, {stable_id("'p-' || (c_custkey + 3)")} AS d, {stable_id("'p-' || (c_custkey + 25)")} AS e FROM customer)"""),
    "set_errors": (("sets", "items"), """
      SELECT set_id, car_ids, missing, CASE WHEN len(car_ids) NOT BETWEEN 2 AND 3 THEN 'INVALID_COMPARE_COUNT'
          WHEN len(list_distinct(car_ids)) <> len(car_ids) THEN 'DUPLICATE_CAR'
          WHEN missing IS NOT NULL THEN 'CAR_NOT_FOUND' END AS code
      FROM sets LEFT JOIN (
        SELECT set_id, arg_min(cid, pos) AS missing FROM (SELECT set_id, unnest(car_ids) AS cid, generate_subscripts(car_ids, 1) AS pos FROM sets)
        WHERE cid NOT IN (SELECT car_id FROM items) GROUP BY 1) USING (set_id)"""),
    "compared": (("set_errors",), """
      SELECT set_id, pos, i.* FROM (SELECT set_id, unnest(car_ids) AS cid, generate_subscripts(car_ids, 1) - 1 AS pos FROM set_errors WHERE code IS NULL)
        JOIN items i ON i.car_id = cid"""),
    "quality": (("attributes",), """
      SELECT parameter_key, group_id, group_name, parameter_name, count(*) AS rows,
        count(*) FILTER (coalesce(value_text, '') = '') AS blank_rows, count(value_numeric) AS numeric_rows,
        count(*) FILTER (equipment_state = 'standard') AS standard_rows, count(*) FILTER (equipment_state = 'optional') AS optional_rows,
        count(*) FILTER (equipment_state = 'mixed') AS mixed_rows, count(*) FILTER (value_text IN ('-', '--')) AS absent_rows,
        count(DISTINCT value_text) AS distinct_values
      FROM attributes GROUP BY ALL"""),
    "classified": (("quality",), """
      SELECT *, parameter_type IN ('numeric', 'equipment') AND excluded_reason = '' AS selected_for_adapter,
        CASE WHEN parameter_type IN ('numeric', 'equipment') AND excluded_reason = ''
          THEN (CASE parameter_type WHEN 'numeric' THEN 'num_' ELSE 'equip_' END) || substr(sha1(parameter_key), 1, 12) ELSE '' END AS feature_name
      FROM (SELECT *, round((CASE parameter_type WHEN 'numeric' THEN numeric_rows ELSE standard_rows + optional_rows + mixed_rows + absent_rows END)
              / greatest(rows, 1)::DOUBLE, 6) AS recognized_rate,
          CASE WHEN parameter_name IN ('全国4S最低报价', '车款人气') THEN 'target_leakage' WHEN parameter_name = '厂商指导价(元)' THEN 'control_only' ELSE '' END AS excluded_reason
        FROM (SELECT *, CASE WHEN numeric_rows >= 20 AND numeric_rows / greatest(rows - blank_rows, 1)::DOUBLE >= 0.5 THEN 'numeric'
            WHEN standard_rows + optional_rows + mixed_rows > 0 AND (standard_rows + optional_rows + mixed_rows + absent_rows) / greatest(rows, 1)::DOUBLE >= 0.5
            THEN 'equipment' ELSE 'categorical' END AS parameter_type FROM quality))"""),
    "coded": (("attributes",), """
      SELECT *, CASE equipment_state WHEN 'standard' THEN 1.0::DOUBLE WHEN 'optional' THEN 0.5::DOUBLE WHEN 'mixed' THEN 0.75::DOUBLE
        ELSE CASE WHEN value_text IN ('-', '--') THEN 0.0::DOUBLE END END AS equipment_value FROM attributes"""),
    "features": (("coded", "classified"), """
      SELECT series_id, parameter_key, feature_name, feature_value FROM (
        SELECT series_id, a.parameter_key, feature_name,
          CASE WHEN any_value(parameter_type) = 'numeric' THEN quantile_disc(value_numeric, 0.5) ELSE avg(equipment_value) END AS feature_value
        FROM coded a JOIN classified c ON a.parameter_key = c.parameter_key AND c.selected_for_adapter
        GROUP BY series_id, a.parameter_key, feature_name) WHERE feature_value IS NOT NULL"""),
    "target": (("latest_measure",), """
      SELECT series_id, sales AS target_sales, ln(1 + sales::DOUBLE) AS target_log_sales FROM latest_measure"""),
    "modes": (("attributes", "trims"), """
      SELECT series_id, kind, value FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY n DESC, value) AS rn FROM (
          SELECT series_id, kind, value, count(*) AS n FROM (
            SELECT series_id, parameter_name AS kind, value_text AS value FROM attributes WHERE parameter_name IN ('厂商', '级别')
            UNION ALL SELECT series_id, 'energy', energy_type_raw FROM trims UNION ALL SELECT series_id, 'body', body_structure FROM trims)
          WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL)) WHERE rn = 1"""),
    "controls": (("modes", "attributes", "trims"), """
      SELECT t.series_id, max(value) FILTER (kind = '厂商') AS brand, max(value) FILTER (kind = '级别') AS level_name,
        max(value) FILTER (kind = 'energy') AS energy_type, max(value) FILTER (kind = 'body') AS body_structure,
        any_value(p.price) AS price_median_wan, any_value(model_year_max) AS model_year_max, any_value(trim_count) AS trim_count
      FROM (SELECT series_id, count(DISTINCT trim_id) AS trim_count, max(model_year) AS model_year_max FROM trims GROUP BY 1) t
        LEFT JOIN modes m USING (series_id)
        LEFT JOIN (SELECT series_id, quantile_disc(value_numeric, 0.5) AS price FROM attributes
          WHERE parameter_name = '厂商指导价(元)' AND value_numeric IS NOT NULL GROUP BY 1) p USING (series_id)
      GROUP BY t.series_id"""),
    "coverage": (("features", "target"), """
      SELECT feature_name, count(feature_value) AS present, stddev_pop(feature_value) AS stddev,
        count(feature_value) / (SELECT count(*) FROM target)::DOUBLE AS coverage
      FROM features SEMI JOIN target USING (series_id) GROUP BY 1"""),
    "selected": (("coverage",), """
      SELECT * FROM coverage WHERE coverage >= 0.2 AND stddev > 1e-9 ORDER BY coverage DESC, stddev DESC, feature_name LIMIT 120"""),
    "pairs": (("features", "selected", "target", "controls"), """
      SELECT feature_name, feature_value::DOUBLE AS x, target_log_sales AS y FROM features SEMI JOIN selected USING (feature_name) JOIN target USING (series_id)
      UNION ALL SELECT c.name, c.x, target_log_sales FROM (
        SELECT series_id, unnest([{'name': 'price_median_wan', 'x': price_median_wan::DOUBLE}, {'name': 'model_year_max', 'x': model_year_max::DOUBLE},
          {'name': 'trim_count', 'x': trim_count::DOUBLE}]) AS c FROM controls) JOIN target USING (series_id) WHERE c.x IS NOT NULL"""),
    "ranks": (("pairs",), """
      SELECT feature_name, x, y,
        rank() OVER (PARTITION BY feature_name ORDER BY x) + (count(*) OVER (PARTITION BY feature_name, x) - 1) / 2.0::DOUBLE AS rank_x,
        rank() OVER (PARTITION BY feature_name ORDER BY y) + (count(*) OVER (PARTITION BY feature_name, y) - 1) / 2.0::DOUBLE AS rank_y FROM pairs"""),
    "rho": (("ranks",), """
      SELECT feature_name, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rank_x) > 0 AND stddev_pop(rank_y) > 0
        THEN covar_pop(rank_x, rank_y) / (stddev_pop(rank_x) * stddev_pop(rank_y)) END AS spearman_rho FROM ranks GROUP BY 1"""),
    "tested": (("rho",), f"""
      SELECT feature_name, n, spearman_rho, {erfc('z')} AS p_value FROM (
        SELECT *, b * sqrt((n - 2) / greatest(1 - b * b, 1e-12)) / sqrt(2.0::DOUBLE) AS z
        FROM (SELECT *, CASE WHEN spearman_rho IS NOT NULL THEN least(abs(spearman_rho), 0.999999::DOUBLE) END AS b FROM rho))"""),
    "associations": (("tested",), """
      SELECT feature_name, n, spearman_rho, p_value,
        CASE WHEN p_value IS NOT NULL THEN least(1.0::DOUBLE, min(level) OVER (ORDER BY p_value DESC NULLS LAST, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS fdr_q_value
      FROM (SELECT *, p_value * (SELECT count(p_value) FROM tested) / rn AS level
        FROM (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST) AS rn FROM tested))"""),
}


def with_ctes(needed: tuple[str, ...], select: str) -> str:
    """Statement with the needed expressions and everything below them, in definition order."""
    wanted: set[str] = set()
    stack = list(needed)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack.extend(CTES[name][0])
    ordered = [name for name in CTES if name in wanted]
    body = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    return f"WITH {body}\n{select}" if ordered else select

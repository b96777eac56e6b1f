"""The domain's tables derived from the test tables, as SQL that reads alike in Spark and DuckDB.

Where the two differ, a name in braces stands for what each calls it.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

WORDS = {
    "spark": {"weekday": "weekday({0})", "text": "CAST({0} AS STRING)", "int": "CAST({0} AS INT)", "monday": "CAST(date_trunc('week', {0}) AS DATE)", "plus_days": "date_add({0}, {1})", "plus_seconds": "{0} + make_dt_interval(0, 0, 0, {1})", "array": "array({0})", "div": "(({0}) div ({1}))", "double": "CAST({0} AS DOUBLE)"},
    "duckdb": {"weekday": "(isodow({0}) - 1)", "text": "CAST({0} AS VARCHAR)", "int": "CAST({0} AS INT)", "monday": "CAST(date_trunc('week', {0}) AS DATE)", "plus_days": "({0} + CAST({1} AS INT))", "plus_seconds": "{0} + to_seconds({1})", "array": "[{0}]", "div": "(({0}) // ({1}))", "double": "CAST({0} AS DOUBLE)"},
}

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_CELL = "CASE WHEN v % 7 = 0 THEN concat(@text(v), '.9') WHEN v % 11 = 0 THEN 'closed' ELSE @text(v) END"
_NTH = "(@div(extract(day FROM service_date) - 1;7) + 1)"

FIXTURES = {
    "attendance": """SELECT concat('loc_', s_nationkey) AS location_id, CAST(l_shipdate AS DATE) AS service_date, CAST(sum(l_quantity) AS INT) AS visitors, max(@plus_seconds(l_shipdate;l_orderkey % 86400)) AS updated_at
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE @weekday(CAST(l_shipdate AS DATE)) >= 5 GROUP BY 1, 2""",
    "attendance_raw": """SELECT concat('loc_', l_suppkey % 5) AS location_id, substr(@text(l_shipdate), 1, 10) AS service_date,
        CASE l_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN concat('-', @text(@int(l_quantity))) WHEN 3 THEN concat(@text(@int(l_quantity)), '.5') ELSE @text(@int(l_quantity)) END AS visitors,
        row_number() OVER (PARTITION BY l_suppkey % 5, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem""",
    "weather_hourly": """SELECT concat('loc_', user_id % 5) AS location_id, ts AS time, value AS temperature_2m, value * 0.9 AS apparent_temperature, value + 40 AS relative_humidity_2m, value / 2 AS wind_speed_10m,
        CASE WHEN event_type = 'error' THEN value END AS precipitation FROM events""",
    "weather_daily": """SELECT concat('loc_', c_nationkey) AS location_id, CAST(o_orderdate AS DATE) AS date, @double(floor(max(o_totalprice) / 100)) / 8 AS temp_10_13, @double(floor(min(o_totalprice) / 100)) / 8 AS apparent_temp_10_13, @double(floor(max(o_totalprice) / 1000)) / 4 AS humidity_10_13,
        @double(min(CASE WHEN o_orderkey % 3 > 0 THEN floor(o_totalprice / 1000) END)) AS wind_10_13, @double(count(*)) AS precip_10_13 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "prediction_logs": """SELECT o_orderkey AS id, concat('loc_', c_nationkey) AS location_id, @plus_days(@monday(o_orderdate);5) AS service_date, @plus_seconds(o_orderdate;o_orderkey % 86400) AS prediction_created_at,
        o_totalprice / 1000 AS predicted_visitors, o_totalprice / 901 AS predicted_quantile, 7.5 + 0.0 * o_totalprice AS residual_buffer, @int(ceil(o_totalprice / 1000 * 1.08)) AS suggested_meals, 0.08 + 0.0 * o_totalprice AS meal_buffer_pct,
        'sat' AS model_segment, CASE WHEN o_orderstatus = 'F' THEN @int(floor(o_totalprice / 1100)) END AS actual_visitors,
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 > 0 THEN abs(floor(o_totalprice / 1100) - o_totalprice / 1000) END AS absolute_error, 150 AS baseline_meals_prepared,
        @double(ceil(o_totalprice / 1000 * 1.08)) * @double(0.1) AS waste_avoided_meals, @double(ceil(o_totalprice / 1000 * 1.08)) * @double(0.171) AS estimated_co2e_reduction_kg, 'nightly' AS created_by, 'job' AS source_app, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "training_runs": """SELECT o_orderkey AS id, concat('loc_', c_nationkey) AS location_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
        CASE WHEN o_orderkey % 17 > 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN @plus_seconds(o_orderdate;o_orderkey % 3600) END AS finished_at,
        CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 1 THEN NULL ELSE concat(substr(@text(o_orderdate), 1, 10), 'T00:00:00Z') END AS latest_attendance_updated_at FROM orders JOIN customer ON o_custkey = c_custkey""",
    "locations_raw": """SELECT CASE WHEN n_nationkey % 11 = 10 THEN '  ' ELSE concat(' loc_', n_nationkey) END AS id, CASE WHEN n_nationkey % 6 = 5 THEN ' ' ELSE n_name END AS name, CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE concat('1', @text(n_nationkey), '550 ') END AS zip_code,
        CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'DE' END AS country_code, CASE WHEN r_name = 'ASIA' THEN 'Asia/Tokyo' WHEN r_name = 'EUROPE' THEN '\t' END AS timezone, n_nationkey AS seq FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "locations": """SELECT concat('loc_', n_nationkey) AS id, n_name AS name FROM nation WHERE n_nationkey % 8 <> 7""",
    "users_raw": """SELECT CASE c_custkey % 9 WHEN 0 THEN concat(' ', upper(c_name)) WHEN 1 THEN concat('Customer#', lpad(@text(c_custkey - 1), 9, '0')) WHEN 2 THEN ' ' ELSE c_name END AS username, CASE c_mktsegment WHEN 'MACHINERY' THEN ' Admin' WHEN 'BUILDING' THEN 'MASTER' WHEN 'FURNITURE' THEN 'guest' ELSE 'staff' END AS role,
        CASE WHEN c_custkey % 13 = 0 THEN @array('') WHEN c_custkey % 13 = 1 THEN @array(concat('loc_', c_nationkey);'*') WHEN c_custkey % 13 = 2 THEN NULL ELSE @array(concat('loc_', c_nationkey);concat('loc_', @text(c_custkey % 30));'nowhere') END AS authorized_locations,
        c_custkey % 5 > 0 AS has_hash, c_custkey % 6 > 0 AS has_salt, c_custkey % 7 > 0 AS has_iterations, c_custkey AS seq FROM customer""",
    "schedule_grid": f"""WITH a AS (SELECT location_id, service_date, visitors AS v, extract(year FROM service_date) AS y, extract(month FROM service_date) AS m, concat(@text({_NTH}), CASE {_NTH} WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END, CASE WHEN @weekday(service_date) = 5 THEN ' Sat' ELSE ' SUN' END) AS slot FROM attendance),
        g AS (SELECT location_id, y, slot, {', '.join(f"max(CASE WHEN m = {i + 1} THEN {_CELL} END) AS {m}" for i, m in enumerate(MONTHS))} FROM a GROUP BY location_id, y, slot)
        SELECT location_id AS source_id, @text(y) AS year, @int(row_number() OVER (PARTITION BY location_id, y ORDER BY slot)) AS row_idx, concat(' ', slot) AS slot, CASE WHEN y % 2 = 0 THEN 'team' END AS team, {', '.join(MONTHS)} FROM g
        UNION ALL SELECT DISTINCT location_id, @text(y), 1000, ' Totals ', NULL, {', '.join("'9'" for _ in MONTHS)} FROM g
        UNION ALL SELECT DISTINCT location_id, @text(y), 1001, '1st Sat', NULL, {', '.join("'555'" for _ in MONTHS)} FROM g
        UNION ALL SELECT DISTINCT location_id, @text(y), 999, '3rd sat', 'late', {', '.join("'0'" for _ in MONTHS)} FROM g WHERE y % 3 = 0
        UNION ALL SELECT DISTINCT location_id, 'notes', 1, '1st Sat', NULL, {', '.join("'7'" for _ in MONTHS)} FROM g""",
}


@cache
def text(name: str, dialect: str) -> str:
    """The SQL of a fixture in the words of ``spark`` or ``duckdb``."""
    out, words = FIXTURES[name], WORDS[dialect]
    while (at := out.rfind("@")) >= 0:  # the last call has no call inside
        word, depth = re.match(r"\w+", out[at + 1 :])[0], 0
        begin = at + 1 + len(word)
        for end in range(begin, len(out)):
            depth += (out[end] == "(") - (out[end] == ")")
            if not depth:
                break
        parts = out[begin + 1 : end].split(";")
        out = out[:at] + words[word].format(", ".join(parts) if word == "array" else parts[0], *parts[1:]) + out[end + 1 :]
    return out


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the Parquet tables in ``sf_dir``."""
    query = text(name, "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", query)}
    if re.search(r"\bFROM attendance\b", query):
        used["attendance"] = fixture(spark, sf_dir, "attendance")
    for t, df in used.items():
        query = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", query)
    return spark.sql(query, **used)


def ctes(*names: str) -> str:
    """WITH clause of the fixtures, for DuckDB; end it with more of your own or a SELECT."""
    wanted = list(dict.fromkeys((["attendance"] if "schedule_grid" in names else []) + list(names)))
    return "WITH " + ", ".join(f"{n} AS ({text(n, 'duckdb')})" for n in wanted)

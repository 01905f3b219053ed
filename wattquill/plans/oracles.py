"""The registered queries as DuckDB SQL, written apart from the operators they check."""

import math

from wattquill import fixed_values as fv
from wattquill.operators import workload as wl
from wattquill.plans import meter

START, END = meter.MONTH
BIG_START, BIG_END = meter.BIG_PERIOD

# --- meter tables -----------------------------------------------------------------------------

METER = {
    "customers": """SELECT c_custkey AS customer_id,
 CASE WHEN c_mktsegment IN ('HOUSEHOLD','FURNITURE') THEN 'residential' ELSE 'commercial' END AS segment,
 CASE WHEN c_custkey % 5 = 0 THEN 'standard' ELSE 'smart' END AS meter_type FROM customer""",
    "tariffs": """SELECT * FROM (VALUES
 (1::BIGINT,'residential',0.35::DOUBLE,0.22::DOUBLE,0.45::DOUBLE,'06:00-09:00,18:00-22:00'),
 (2,'commercial',0.28,0.18,1.20,'09:00-17:00')) AS t(tariff_id, segment, peak_rate_per_kwh,
 off_peak_rate_per_kwh, standing_charge, peak_hours)""",
    "readings": """SELECT event_id AS reading_id, user_id AS customer_id, ts AS timestamp,
 CAST(value AS DECIMAL(15,3)) AS consumption_kwh FROM events""",
    "wh": """SELECT reading_id, customer_id, timestamp, CAST(timestamp AS DATE) AS day,
 CAST(hour(timestamp) AS INTEGER) AS hour, CAST(consumption_kwh * 1000 AS BIGINT) AS wh FROM readings""",
    "windows": """SELECT tariff_id, segment, CAST(split_part(split_part(w,'-',1),':',1) AS INTEGER) AS start_hour,
 CAST(split_part(split_part(w,'-',2),':',1) AS INTEGER) AS end_hour
 FROM (SELECT tariff_id, segment, unnest(string_split(peak_hours, ',')) AS w FROM tariffs)""",
    "asked": """SELECT c_custkey AS customer_id FROM customer
 UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey < 10""",
    "requests": """SELECT customer_id AS request_id, customer_id,
 CAST('2024-01-01' AS DATE) + CAST(customer_id % 7 AS INT) AS start_date,
 CAST('2024-01-01' AS DATE) + CAST(customer_id % 7 + 13 AS INT) AS end_date
 FROM asked
 UNION ALL SELECT customer_id + CAST(1000000000 AS BIGINT) * k, customer_id, CAST(s AS DATE), CAST(e AS DATE)
 FROM asked, (VALUES (1, '0001-01-01', '9999-12-31'), (2, '2024-01-20', '2024-01-10'), (3, NULL, '2024-01-31'),
  (4, '2024-01-01', NULL), (5, NULL, NULL), (6, '1990-01-01', '1990-12-31')) o(k, s, e) WHERE customer_id % 100 < 4""",
    "month_requests": f"""SELECT customer_id AS request_id, customer_id, DATE '{START}' AS start_date,
 DATE '{END}' AS end_date FROM customers""",
    "half_requests": f"""SELECT customer_id AS request_id, customer_id, DATE '{START}' AS start_date,
 DATE '2024-01-15' AS end_date FROM customers""",
    "order_wh": """SELECT o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS day,
 CAST(l_orderkey % 24 AS INTEGER) AS hour, CAST(l_quantity * 1000 AS BIGINT) AS wh
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "order_requests": f"""SELECT customer_id AS request_id, customer_id, DATE '{BIG_START}' AS start_date,
 DATE '{BIG_END}' AS end_date FROM customers""",
}


def _bills(requests: str, usage: str = "wh", tariffs: str = "tariffs") -> dict[str, str]:
    return {
        "used": f"""SELECT q.request_id, count(*) AS row_count, count(*) - count(u.wh) AS null_reading_count,
 sum(CASE WHEN EXISTS (SELECT 1 FROM windows w WHERE w.segment = c.segment AND u.hour >= w.start_hour
   AND u.hour < w.end_hour) THEN u.wh ELSE 0 END) AS peak_wh, sum(u.wh) AS all_wh
 FROM {requests} q JOIN customers c ON q.customer_id = c.customer_id
 JOIN {usage} u ON u.customer_id = q.customer_id AND u.day BETWEEN q.start_date AND q.end_date
 GROUP BY q.request_id""",
        "costed": f"""SELECT q.request_id, q.customer_id, q.start_date, q.end_date, c.segment,
 CASE WHEN c.customer_id IS NULL THEN 'customer_not_found' WHEN t.segment IS NULL THEN 'no_tariff'
  WHEN u.request_id IS NULL THEN 'no_readings' ELSE 'ok' END AS status,
 CAST(u.peak_wh AS DECIMAL(20,0)) * 0.001 AS peak, CAST(u.all_wh - u.peak_wh AS DECIMAL(20,0)) * 0.001 AS off_peak,
 CAST(t.peak_rate_per_kwh AS DECIMAL(6,4)) AS peak_rate, CAST(t.off_peak_rate_per_kwh AS DECIMAL(6,4)) AS off_peak_rate,
 CAST(date_diff('day', q.start_date, q.end_date) + 1 AS DECIMAL(9,0)) * CAST(t.standing_charge AS DECIMAL(6,4)) AS standing,
 u.null_reading_count
 FROM {requests} q LEFT JOIN customers c ON q.customer_id = c.customer_id
 LEFT JOIN {tariffs} t ON t.segment = c.segment LEFT JOIN used u ON u.request_id = q.request_id""",
        "bills": """SELECT request_id, customer_id, CAST(start_date AS VARCHAR) AS start_date,
 CAST(end_date AS VARCHAR) AS end_date, segment,
 CASE WHEN status = 'ok' THEN CAST(round(peak + off_peak, 2) AS DOUBLE) END AS total_kwh,
 CASE WHEN status = 'ok' THEN CAST(round(peak, 2) AS DOUBLE) END AS peak_kwh,
 CASE WHEN status = 'ok' THEN CAST(round(off_peak, 2) AS DOUBLE) END AS off_peak_kwh,
 CASE WHEN status = 'ok' THEN CAST(round(peak * peak_rate, 2) AS DOUBLE) END AS peak_cost,
 CASE WHEN status = 'ok' THEN CAST(round(off_peak * off_peak_rate, 2) AS DOUBLE) END AS off_peak_cost,
 CASE WHEN status = 'ok' THEN CAST(round(standing, 2) AS DOUBLE) END AS standing_charge,
 CASE WHEN status = 'ok' THEN CAST(round(peak * peak_rate + off_peak * off_peak_rate + standing, 2) AS DOUBLE) END AS total_cost,
 CASE WHEN status = 'ok' THEN 'GBP' END AS currency,
 CASE WHEN status = 'ok' THEN CAST(null_reading_count AS BIGINT) END AS null_reading_count, status FROM costed""",
    }


def _factors(requests: str) -> dict[str, str]:
    return {
        "loads": f"""SELECT q.request_id, q.customer_id, q.start_date, q.end_date, count(u.reading_id) AS row_count,
 count(u.wh) AS n, CAST(sum(u.wh) AS HUGEINT) AS total, CAST(max(u.wh) AS HUGEINT) AS top
 FROM {requests} q LEFT JOIN wh u ON u.customer_id = q.customer_id AND u.day BETWEEN q.start_date AND q.end_date
 GROUP BY ALL""",
        "factors": """SELECT request_id, customer_id, CAST(start_date AS VARCHAR) AS start_date,
 CAST(end_date AS VARCHAR) AS end_date,
 CASE WHEN top > 0 THEN CAST((2000 * total + n * top) // (2 * n * top) AS DOUBLE) / 1000 WHEN top <= 0 THEN 0.0 END AS load_factor,
 CAST((2 * total + n) // (2 * n) AS DOUBLE) / 1000 AS average_load_kwh, CAST(top AS DOUBLE) / 1000 AS peak_load_kwh,
 CASE WHEN row_count > 0 THEN CAST(n AS BIGINT) END AS reading_count,
 CASE WHEN row_count > 0 THEN CAST(row_count - n AS BIGINT) END AS null_reading_count,
 CASE WHEN row_count > 0 THEN CAST(date_diff('day', start_date, end_date) + 1 AS INTEGER) END AS period_days,
 CASE WHEN row_count > 0 THEN 'ok' ELSE 'no_readings' END AS status FROM loads""",
    }


def _with(ctes: dict[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n" + select


def _meter(select: str, **more: str) -> str:
    return _with(METER | more, select)


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
PEAK = "EXISTS (SELECT 1 FROM windows w WHERE w.segment = c.segment AND u.hour >= w.start_hour AND u.hour < w.end_hour)"
JOINED = "FROM wh u JOIN customers c ON u.customer_id = c.customer_id"
KWH = "CAST({} AS DOUBLE) / 1000"


def _median(source: str, key: str) -> str:
    """The middle one or two values by rank."""
    partition, group = (f"PARTITION BY {key}", f"GROUP BY {key}") if key else ("", "")
    lead = f"{key}, " if key else ""
    return f"""SELECT {lead}CAST(sum(x) AS DOUBLE) / (count(*) * 1000) AS result FROM (
 SELECT {lead}wh AS x, row_number() OVER ({partition} ORDER BY wh) AS rn, count(*) OVER ({partition}) AS n
 FROM ({source})) WHERE rn IN ((n + 1) // 2, n // 2 + 1) {group}"""


MONTH_BILLS = _bills("month_requests")
MONTH_FACTORS = _factors("month_requests")
FOUND_FACTORS = "SELECT * EXCLUDE (request_id) FROM factors WHERE status = 'ok'"

# --- workload ---------------------------------------------------------------------------------

HALF_END = "2024-01-15"
_CUSTOMER = {
    name: text.replace("{month}", meter.MONTH_NAME).replace("{start}", START).replace("{middle}", HALF_END)
    for name, text in fv.CUSTOMER_QUESTIONS.items()
}
_SEGMENT = {name: text.replace("{month}", meter.MONTH_NAME) for name, text in fv.SEGMENT_QUESTIONS.items()}
_GENERAL = {name: text.replace("{month}", meter.MONTH_NAME) for name, text in fv.GENERAL_QUESTIONS.items()}
_VALUES = {
    "sum": "coalesce(sum(wh), 0) / 1000",
    "mean": "CASE WHEN count(wh) > 0 THEN CAST((20 * sum(wh) + count(wh)) // (2 * count(wh)) AS DOUBLE) / 10000 END",
    "max": "max(wh) / 1000",
    "min": "min(wh) / 1000",
    "count_readings": "count(reading_id)",
}
_IN_MONTH = f"u.day BETWEEN DATE '{START}' AND DATE '{END}'"


def _truth() -> dict[str, str]:
    parts = [
        f"""SELECT replace('{_CUSTOMER["bill"]}', '{{id}}', CAST(customer_id AS VARCHAR)) AS query,
 'billing' AS category, total_cost AS value FROM bills""",
        f"""SELECT replace('{_CUSTOMER["load_factor"]}', '{{id}}', CAST(customer_id AS VARCHAR)),
 'load_factor', load_factor FROM factors""",
        f"""SELECT replace('{_CUSTOMER["plot"]}', '{{id}}', CAST(customer_id AS VARCHAR)), 'plot', 1.0 FROM customers""",
    ]
    parts += [
        f"""SELECT replace('{_CUSTOMER["half_load_factor"]}', '{{id}}', CAST(customer_id AS VARCHAR)),
 'load_factor', load_factor FROM half_factors""",
        f"""SELECT replace('{_CUSTOMER["trend_plot"]}', '{{id}}', CAST(customer_id AS VARCHAR)), 'plot', 1.0 FROM customers""",
    ]
    parts += [f"SELECT '{text}', 'plot', 1.0" for text in fv.PLOT_QUESTIONS]
    for scope, texts, slot, key in (
        ("customer", _CUSTOMER, "{id}", "c.customer_id"),
        ("segment", _SEGMENT, "{segment}", "c.segment"),
        ("all", _GENERAL, "{none}", "1"),
    ):
        for name, text in texts.items():
            operation = name.removeprefix("month_")
            category = "count" if operation.startswith("count") else "aggregation"
            on = "u.customer_id = c.customer_id" + (f" AND {_IN_MONTH}" if name != operation else "")
            if operation == "count_customers":
                parts.append(
                    f"""SELECT replace('{text}', '{slot}', CAST({key} AS VARCHAR)), 'count', count(*)
 FROM customers c GROUP BY {key}"""
                )
            elif operation in _VALUES:
                join = f"customers c LEFT JOIN wh u ON {on}" if scope != "all" else (
                    "wh u" + (f" WHERE {_IN_MONTH}" if name != operation else "")
                )
                parts.append(
                    f"""SELECT replace('{text}', '{slot}', CAST({key} AS VARCHAR)), '{category}',
 CAST({_VALUES[operation]} AS DOUBLE) FROM {join} GROUP BY {key}"""
                )
    minimum = f"contains(query, '{fv.MINIMUM_QUESTION}')"
    half = {f"half_{name}": sql.replace("FROM loads", "FROM half_loads") for name, sql in _factors("half_requests").items()}
    return MONTH_BILLS | MONTH_FACTORS | half | {
        "answers": "\nUNION ALL ".join(parts),
        "truth": f"""SELECT query, category, round(CAST(value AS DOUBLE), 4) AS expected_value,
 CAST(CASE WHEN category IN ('plot', 'count') OR {minimum} THEN 0 ELSE 0.05 END AS DOUBLE) AS tolerance,
 CASE WHEN category = 'plot' THEN 'plot_exists' WHEN category = 'count' OR {minimum} THEN 'exact'
  ELSE 'relative' END AS tolerance_type FROM answers WHERE value IS NOT NULL""",
    }


_STATISTICS = {
    "median": "median(wh) / 1000",
    "mean": _VALUES["mean"],
    "sum": _VALUES["sum"],
    "count": "count(wh)",
}


def _statistics() -> dict[str, str]:
    """Medians, counts of values and grouped questions: a plain aggregate for each question."""
    ends = {"month_": END, "half_": HALF_END}
    parts = []

    def add(name: str, text: str, rows: str, key: str, slot: str, group: str) -> None:
        prefix = next((p for p in ends if name.startswith(p)), "")
        text = text.replace("{month}", meter.MONTH_NAME).replace("{start}", START).replace("{middle}", HALF_END)
        dated = f" AND u.day BETWEEN DATE '{START}' AND DATE '{ends[prefix]}'" if prefix else ""
        parts.append(
            f"""SELECT replace('{text}', '{slot}', CAST({key} AS VARCHAR)) AS query, {group} AS group_key,
 CAST({_STATISTICS[name.removeprefix(prefix)]} AS DOUBLE) AS value FROM {rows.format(dated)} GROUP BY {key}"""
        )

    of_customers = "customers c LEFT JOIN wh u ON u.customer_id = c.customer_id{}"
    for name, text in wl.STATISTICS_QUESTIONS["customer"].items():
        add(name, text, of_customers, "c.customer_id", "{id}", "NULL")
    for name, text in wl.STATISTICS_QUESTIONS["segment"].items():
        add(name, text, of_customers, "c.segment", "{segment}", "NULL")
    for name, text in wl.STATISTICS_QUESTIONS["all"].items():
        add(name, text, "wh u WHERE true{}", "1", "{none}", "NULL")
    for group in wl.GROUPS:
        for name, text in wl.GROUPED_QUESTIONS.items():
            text = text.replace("{group}", group.replace("_", " "))
            add(name, text, of_customers, f"c.{group}", "{none}", f"c.{group}")
    return {
        "statistics": "\nUNION ALL ".join(parts),
        "statistics_truth": """SELECT query, CAST(group_key AS VARCHAR) AS group_key, 'aggregation' AS category,
 round(value, 4) AS expected_value, 0.05::DOUBLE AS tolerance, 'relative' AS tolerance_type
 FROM statistics WHERE value IS NOT NULL""",
    }


# --- synthetic data ---------------------------------------------------------------------------


def _uniform(key: str, at: int = 1) -> str:
    return f"((CAST(('0x' || substr(md5({key}), {at}, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"


def _base(segment: str, hour: str, weekday: str) -> str:
    return f"""(CASE WHEN {segment} = 'residential' THEN CASE WHEN {hour} >= 6 AND {hour} < 9 THEN 0.8
  WHEN {hour} >= 18 AND {hour} < 22 THEN 1.0 ELSE 0.3 END
 ELSE CASE WHEN {weekday} <= 5 AND {hour} >= 9 AND {hour} < 17 THEN 2.5 ELSE 0.8 END END)"""


_STEPS = meter.GENERATED_DAYS * 96
GENERATED = {
    "made_customers": f"""SELECT c_custkey + 1 AS customer_id,
 CASE WHEN {_uniform("'42:segment:' || (c_custkey + 1)")} < 0.7::DOUBLE THEN 'residential' ELSE 'commercial' END AS segment,
 CASE WHEN {_uniform("'42:meter:' || (c_custkey + 1)")} < 0.8::DOUBLE THEN 'smart' ELSE 'standard' END AS meter_type,
 DATE '2024-01-01' - 1825 + CAST(floor({_uniform("'42:join:' || (c_custkey + 1)")} * 1825::DOUBLE) AS INTEGER) AS join_day
 FROM customer""",
    "stamps": f"""SELECT customer_id, segment, step, TIMESTAMP '2024-01-01' + to_minutes(15 * step) AS stamp
 FROM made_customers, range({_STEPS}) r(step)""",
    "noise": f"""SELECT *, hour(stamp) AS h, sqrt(-2.0::DOUBLE * ln({_uniform("'42:reading:' || customer_id || ':' || step")}))
 * cos({2.0 * math.pi!r}::DOUBLE * {_uniform("'42:reading:' || customer_id || ':' || step", 14)}) AS z FROM stamps""",
    "made": f"""SELECT customer_id, segment, h, (customer_id - 1) * {_STEPS} + step + 1 AS reading_id,
 CAST(floor(greatest(CAST({_base("segment", "h", "isodow(stamp)")} AS DOUBLE) * 1.3::DOUBLE
  * (1.0::DOUBLE + 0.15::DOUBLE * z), 0.0::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS wh FROM noise""",
}


def _meter_oracles() -> dict[str, str]:
    select_all = "reading_id, customer_id, " + STAMP.format("timestamp") + " AS timestamp, CAST(consumption_kwh AS DOUBLE) AS consumption_kwh"
    sql = {
        "src_readings_scan": _meter(f"SELECT {select_all} FROM readings"),
        "table_stats": _meter(
            """SELECT 'customers' AS table_name, count(*) AS row_count FROM customers
 UNION ALL SELECT 'tariffs', count(*) FROM tariffs UNION ALL SELECT 'readings', count(*) FROM readings"""
        ),
        "sink_roundtrip_counts": _meter(
            """SELECT 'customers' AS table_name, count(*) AS row_count FROM customers
 UNION ALL SELECT 'tariffs', count(*) FROM tariffs UNION ALL SELECT 'readings', count(*) FROM readings
 UNION ALL SELECT 'readings/' || CAST(day AS VARCHAR), count(wh) FROM wh GROUP BY day"""
        ),
        "sql_select_filter": _meter("SELECT * FROM customers WHERE segment = 'residential'"),
        "sql_count_customers": "SELECT count(*) AS n FROM customer",
        "sql_count_segment": _meter("SELECT count(*) AS n FROM customers WHERE segment = 'commercial'"),
        "sql_time_range": _meter(
            """SELECT reading_id, customer_id, CAST(consumption_kwh AS DOUBLE) AS consumption_kwh FROM readings
 WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15'"""
        ),
        "sql_time_range_closed": _meter(
            f"""SELECT reading_id, {STAMP.format("timestamp")} AS timestamp, CAST(consumption_kwh AS DOUBLE) AS consumption_kwh
 FROM readings WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp <= TIMESTAMP '2024-01-10 23:59:59'"""
        ),
        "sql_in_list": _meter(f"SELECT {select_all} FROM readings WHERE customer_id IN (5, 10, 15)"),
        "sql_join_segment": _meter(
            f"""SELECT reading_id, r.customer_id AS customer_id, {STAMP.format("timestamp")} AS timestamp,
 CAST(consumption_kwh AS DOUBLE) AS consumption_kwh, c.customer_id AS customer_id_1, segment, meter_type
 FROM readings r JOIN customers c ON r.customer_id = c.customer_id WHERE c.segment = 'residential'"""
        ),
        "sql_cast_date": _meter("SELECT count(*) AS n FROM readings WHERE CAST(timestamp AS DATE) = DATE '2024-01-15'"),
        "sql_order_limit": _meter(
            """SELECT reading_id, CAST(consumption_kwh AS DOUBLE) AS consumption_kwh FROM readings
 ORDER BY readings.consumption_kwh DESC, reading_id LIMIT 100"""
        ),
        "agg_global_sum": _meter(f"SELECT {KWH.format('coalesce(sum(wh), 0)')} AS result FROM wh"),
        "agg_global_mean": _meter(
            "SELECT CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh) AS result FROM readings"
        ),
        "agg_global_median": _meter(_median("SELECT wh FROM wh WHERE wh IS NOT NULL", "")),
        "agg_global_count": _meter("SELECT count(wh) AS result FROM wh"),
        "agg_global_max": _meter(f"SELECT {KWH.format('max(wh)')} AS result FROM wh"),
        "agg_global_min": _meter(f"SELECT {KWH.format('min(wh)')} AS result FROM wh"),
        "agg_by_segment": _meter(
            """SELECT segment, CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh) AS result
 FROM readings r JOIN customers c ON r.customer_id = c.customer_id GROUP BY segment"""
        ),
        "agg_by_meter_type": _meter(
            f"SELECT meter_type, {KWH.format('coalesce(sum(wh), 0)')} AS result {JOINED} GROUP BY meter_type"
        ),
        "agg_median_by_segment": _meter(
            _median(f"SELECT segment, wh {JOINED} WHERE wh IS NOT NULL", "segment")
        ),
        "agg_join_mean_residential": _meter(
            """SELECT CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh) AS result
 FROM readings r JOIN customers c ON r.customer_id = c.customer_id WHERE segment = 'residential'"""
        ),
        "agg_join_sum_commercial": _meter(
            f"SELECT {KWH.format('coalesce(sum(wh), 0)')} AS result {JOINED} WHERE segment = 'commercial'"
        ),
        "agg_capped_ordered": _meter(
            f"""SELECT {KWH.format('sum(wh)')} AS result
 FROM (SELECT wh FROM wh ORDER BY timestamp, reading_id LIMIT 100)"""
        ),
        "bill_monthly": _meter("SELECT * EXCLUDE (request_id) FROM bills", **MONTH_BILLS),
        "bill_order_lines": _meter(
            "SELECT * EXCLUDE (request_id) FROM bills", **_bills("order_requests", "order_wh")
        ),
        "bill_requests": _meter("SELECT * FROM bills", **_bills("requests")),
        "bill_status_counts": _meter(
            "SELECT status, count(*) AS requests FROM bills GROUP BY status",
            home_tariffs="SELECT * FROM tariffs WHERE segment = 'residential'",
            **_bills("requests", tariffs="home_tariffs"),
        ),
        "bill_by_segment": _meter(
            """SELECT segment, count(*) AS bills, CAST(sum(CAST(total_kwh AS DECIMAL(18,2))) AS DOUBLE) AS total_kwh,
 CAST(sum(CAST(standing_charge AS DECIMAL(18,2))) AS DOUBLE) AS standing_charge,
 CAST(sum(CAST(total_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM bills WHERE status = 'ok' GROUP BY segment""",
            **MONTH_BILLS,
        ),
        "standing_charge": _meter(
            """SELECT request_id, q.customer_id AS customer_id, CAST(start_date AS VARCHAR) AS start_date,
 CAST(end_date AS VARCHAR) AS end_date, CAST(date_diff('day', start_date, end_date) + 1 AS INTEGER) AS days,
 CAST(round(CAST(date_diff('day', start_date, end_date) + 1 AS DECIMAL(9,0)) * CAST(standing_charge AS DECIMAL(6,4)), 2) AS DOUBLE) AS standing_charge
 FROM requests q LEFT JOIN customers c ON q.customer_id = c.customer_id LEFT JOIN tariffs t ON t.segment = c.segment"""
        ),
        "tariff_peak_windows": _meter(
            f"""SELECT w.tariff_id, w.segment, w.start_hour, w.end_hour, {KWH.format('sum(u.wh)')} AS kwh
 {JOINED} JOIN windows w ON w.segment = c.segment AND u.hour >= w.start_hour AND u.hour < w.end_hour GROUP BY ALL"""
        ),
        "peak_share_by_hour": _meter(
            f"""SELECT s.segment, s.hour, EXISTS (SELECT 1 FROM windows w WHERE w.segment = s.segment
 AND s.hour >= w.start_hour AND s.hour < w.end_hour) AS is_peak, {KWH.format('coalesce(sum(u.wh), 0)')} AS kwh
 FROM (SELECT DISTINCT c.segment, CAST(r.h AS INTEGER) AS hour FROM customers c, range(24) r(h)) s
 LEFT JOIN (SELECT segment, hour, wh {JOINED}) u ON u.segment = s.segment AND u.hour = s.hour GROUP BY ALL"""
        ),
        "peak_offpeak_by_customer": _meter(
            f"""SELECT u.customer_id, c.segment, {KWH.format(f'coalesce(sum(CASE WHEN {PEAK} THEN wh END), 0)')} AS peak_kwh,
 {KWH.format(f'coalesce(sum(CASE WHEN NOT {PEAK} THEN wh END), 0)')} AS off_peak_kwh {JOINED} GROUP BY ALL"""
        ),
        "load_factor": _meter(
            FOUND_FACTORS,
            reading_requests=f"""SELECT DISTINCT customer_id AS request_id, customer_id, DATE '{START}' AS start_date,
 DATE '{END}' AS end_date FROM readings""",
            **_factors("reading_requests"),
        ),
        "load_factor_requests": _meter("SELECT * FROM factors", **_factors("requests")),
        "load_factor_status": _meter(
            "SELECT status, count(*) AS requests FROM factors GROUP BY status", **_factors("requests")
        ),
        "load_factor_ratio": _meter(
            f"""SELECT customer_id, start_date, end_date, load_factor, load_factor / base AS ratio_to_base,
 CASE WHEN load_factor > 0.5 THEN 'Good' ELSE 'Variable' END AS efficiency
 FROM factors, (SELECT max(load_factor) AS base FROM factors WHERE customer_id = {meter.BASE_CUSTOMER}) WHERE status = 'ok'""",
            reading_requests=f"""SELECT DISTINCT customer_id AS request_id, customer_id, DATE '{START}' AS start_date,
 DATE '{END}' AS end_date FROM readings""",
            **_factors("reading_requests"),
        ),
        "plot_daily_consumption": _meter(
            f"""SELECT customer_id, CAST(day AS VARCHAR) AS reading_date, {KWH.format('coalesce(sum(wh), 0)')} AS consumption_kwh
 FROM wh GROUP BY customer_id, day"""
        ),
        "plot_total_by_segment": _meter(
            f"SELECT segment AS series_x, {KWH.format('sum(wh)')} AS series_y {JOINED} GROUP BY segment"
        ),
        "plot_month_trend": _meter(
            f"""SELECT CAST(day AS VARCHAR) AS series_x, {KWH.format('sum(wh)')} AS series_y FROM wh u
 WHERE {_IN_MONTH} GROUP BY day"""
        ),
        "plot_peak_vs_offpeak": _meter(
            f"""SELECT series_x, series_y FROM (SELECT u.customer_id,
 {KWH.format(f'coalesce(sum(CASE WHEN {PEAK} THEN wh END), 0)')} AS series_x,
 {KWH.format(f'coalesce(sum(CASE WHEN NOT {PEAK} THEN wh END), 0)')} AS series_y {JOINED} GROUP BY ALL)"""
        ),
        "plot_peak_vs_offpeak_sample": _meter(
            f"""SELECT series_x, series_y, CASE WHEN count(*) OVER () = {meter.PLOT_POINTS} THEN max(h) OVER () ELSE 1.0::DOUBLE END
 AS sample_rate FROM (SELECT u.customer_id, {_uniform("'42:plot:' || u.customer_id")} AS h,
 {KWH.format(f'coalesce(sum(CASE WHEN {PEAK} THEN wh END), 0)')} AS series_x,
 {KWH.format(f'coalesce(sum(CASE WHEN NOT {PEAK} THEN wh END), 0)')} AS series_y {JOINED} GROUP BY u.customer_id
 ORDER BY h LIMIT {meter.PLOT_POINTS})"""
        ),
        "plot_load_factor_hist": _meter(
            """SELECT bin, (bin - 1) / 10.0::DOUBLE AS bin_start, bin / 10.0::DOUBLE AS bin_end, count(*) AS customers
 FROM (SELECT CAST(least(floor(round(load_factor * 1000) / 100) + 1, 10) AS INTEGER) AS bin FROM factors WHERE status = 'ok')
 GROUP BY bin""",
            reading_requests=f"""SELECT DISTINCT customer_id AS request_id, customer_id, DATE '{START}' AS start_date,
 DATE '{END}' AS end_date FROM readings""",
            **_factors("reading_requests"),
        ),
        "plot_mean_by_meter_type": _meter(
            """SELECT meter_type AS series_x, CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh) AS series_y
 FROM readings r JOIN customers c ON r.customer_id = c.customer_id GROUP BY meter_type"""
        ),
        "gen_customers_profile": _with(
            GENERATED,
            f"""SELECT segment, meter_type, count(*) AS customers, {STAMP.format("CAST(min(join_day) AS TIMESTAMP)")} AS first_join,
 {STAMP.format("CAST(max(join_day) AS TIMESTAMP)")} AS last_join FROM made_customers GROUP BY segment, meter_type""",
        ),
        "gen_tariffs": _meter(
            """SELECT t.*, n.customers FROM tariffs t LEFT JOIN
 (SELECT segment, count(*) AS customers FROM made_customers GROUP BY segment) n ON n.segment = t.segment""",
            **GENERATED,
        ),
        "gen_time_axis": _with(
            GENERATED,
            f"""SELECT {STAMP.format("TIMESTAMP '2024-01-01' + to_minutes(15 * step)")} AS timestamp, count(*) AS customers,
 max(step) AS step FROM made_customers, range({_STEPS}) r(step) GROUP BY 1""",
        ),
        "gen_base_load": _meter(
            f"""SELECT c.segment, u.hour, count(*) AS readings, CAST(sum(CAST({_base("c.segment", "u.hour", "isodow(u.timestamp)")}
 AS DECIMAL(4,1))) AS DOUBLE) AS base_kwh {JOINED} GROUP BY c.segment, u.hour"""
        ),
        "gen_season_factor": """SELECT CAST(month(o_orderdate) AS INTEGER) AS month,
 CAST(CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1.3 WHEN month(o_orderdate) IN (6, 7, 8) THEN 1.2 ELSE 0.85 END AS DOUBLE) AS factor,
 count(*) AS orders FROM orders GROUP BY ALL""",
        "gen_readings_profile": _with(
            GENERATED,
            f"""SELECT segment, CAST(h AS INTEGER) AS hour, count(*) AS readings, {KWH.format('sum(wh)')} AS kwh,
 {KWH.format('min(wh)')} AS min_kwh, {KWH.format('max(wh)')} AS max_kwh FROM made GROUP BY segment, h""",
        ),
        "gen_readings_count": _with(
            GENERATED,
            """SELECT count(*) AS readings, min(reading_id) AS first_id, max(reading_id) AS last_id,
 CAST(sum(reading_id) AS BIGINT) AS id_sum FROM made""",
        ),
        "ground_truth": _meter("SELECT * FROM truth", **_truth()),
        "ground_truth_statistics": _meter("SELECT * FROM statistics_truth", **_statistics()),
        "workload_by_category": _meter(
            "SELECT category, count(*) AS questions FROM truth GROUP BY category", **_truth()
        ),
        "workload_tolerances": _meter(
            "SELECT category, tolerance_type, tolerance, count(*) AS questions FROM truth GROUP BY ALL", **_truth()
        ),
    }
    return sql


# --- transcripts, tool calls, episodes --------------------------------------------------------


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _after(marker: str) -> str:
    return f"CASE WHEN contains(clean, '{marker}') THEN substr(clean, instr(clean, '{marker}') + {len(marker)}) END"


def _cut(tail: str) -> str:
    cases = " ".join(
        f"WHEN contains({tail}, '{m}') THEN split_part({tail}, '{m}', 1)" for m in fv.STOP_MARKERS
    )
    return f"CASE {cases} ELSE {tail} END"


def _repair(text: str) -> str:
    flat = rf"regexp_replace({_strip(text)}, '[\n\r\t]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({flat}, ',\s*\}}', '}}', 'g'), ',\s*\]', ']', 'g')"


def _parse(source: str, keys: str) -> dict[str, str]:
    name = source
    return {
        f"{name}_tails": f"""SELECT {keys}, {_after("Answer:")} AS a, {_after("Thought:")} AS t, {_after("Action:")} AS n,
 {_after("Action Input:")} AS i FROM (SELECT *, regexp_replace(response, '(Observation:|\\nObservation)\\z', '') AS clean FROM {source})""",
        f"{name}_cut": f"""SELECT {keys}, {_strip(_cut("a"))} AS answer, CASE WHEN a IS NULL THEN {_strip(_cut("t"))} END AS thought,
 CASE WHEN a IS NULL THEN {_strip(_cut("n"))} END AS action,
 CASE WHEN a IS NULL AND n IS NOT NULL THEN {_repair(_cut("i"))} END AS j FROM {name}_tails""",
        f"{name}_kind": f"""SELECT *, CASE WHEN answer IS NOT NULL THEN NULL
 WHEN action IS NOT NULL AND j IS NULL THEN 'missing_action_input'
 WHEN action IS NOT NULL AND NOT json_valid(j) THEN 'invalid_json'
 WHEN action IS NULL AND coalesce(thought, '') = '' THEN 'no_markers' END AS error_kind FROM {name}_cut""",
        f"{name}_parsed": f"""SELECT {keys}, CASE WHEN answer IS NOT NULL THEN 'answer' WHEN error_kind IS NOT NULL THEN 'error'
 WHEN action IS NOT NULL THEN 'action' ELSE 'thought_only' END AS type, thought, action,
 CASE WHEN error_kind IS NULL THEN j END AS action_input, answer, error_kind,
 CASE error_kind WHEN 'invalid_json' THEN 'the action input is not valid JSON'
 WHEN 'missing_action_input' THEN 'an action without its input'
 WHEN 'no_markers' THEN 'none of the section markers found' END AS error FROM {name}_kind""",
    }


def _number(text: str) -> str:
    return rf"TRY_CAST(list_extract(regexp_extract_all(replace({text}, ',', ''), '[-+]?\d*\.\d+|\d+'), -1) AS DOUBLE)"


TURNS = {
    "turns": """SELECT user_id * 10000000000 + CAST((rn - 1) // 12 AS BIGINT) AS episode_id,
 CAST((rn - 1) % 12 + 1 AS INTEGER) AS step, event_id, event_type, user_id, CAST(value AS DECIMAL(12,2)) AS cents,
 CASE
  WHEN user_id % 10 = 0 AND event_type IN ('purchase','error','signup') THEN 'Thought: keep thinking'
  WHEN event_type='view' AND event_id % 7 = 0 THEN 'Thought: ' || chr(10) || ' '
  WHEN event_type='view' THEN 'Thought: look up customer ' || CAST(user_id AS STRING)
  WHEN event_type='click' THEN 'Thought: run a query' || chr(10) || 'Action: ' || CASE
   WHEN event_id % 16 = 6 THEN 'sql_executor' || chr(10) || 'Action Input: [1, 2]'
   WHEN event_id % 16 = 7 THEN 'tariff_calculator' || chr(10) || 'Action Input: {"customer_id": ' || CAST(user_id AS STRING)
    || ', "start_date": "2024-01-01", "end_date": "2024-01-31", "note": 1}'
   WHEN event_id % 16 = 8 THEN 'tariff_calculator' || chr(10) || 'Action Input: {"customer_id": "one", "start_date": "2024-01-01"}'
   ELSE 'sql_executor' || chr(10) || 'Action Input: {"query": "SELECT 1", "row_limit": ' || CASE event_id % 16
     WHEN 0 THEN '7.9' WHEN 1 THEN 'true' WHEN 2 THEN 'null' WHEN 3 THEN '[1]' WHEN 4 THEN '"many"'
     WHEN 5 THEN CAST(event_id % 50 AS STRING) WHEN 9 THEN 'false'
     ELSE '"' || CAST(event_id % 50 AS STRING) || '"' END || '}' END
  WHEN event_type='purchase' THEN 'Answer: The total cost is ' || CAST(CAST(value AS DECIMAL(12,2)) AS STRING) || ' GBP.'
  WHEN event_type='error' AND event_id % 2 = 0 THEN 'Thought: bill' || chr(10) || 'Action: tariff_calculator' || chr(10)
   || 'Action Input: {"customer_id": "' || CAST(user_id AS STRING) || '", "start_date": "2024-01-01",}' || chr(10) || 'Observation:'
  WHEN event_type='error' THEN 'no marker here ' || CAST(CAST(value AS DECIMAL(12,2)) AS STRING)
  WHEN event_id % 3 = 0 THEN 'Thought: plot' || chr(10) || 'Action: plot_generator'
  WHEN event_id % 3 = 1 THEN 'Thought: try' || chr(10) || 'Action: nonexistent_tool' || chr(10) || 'Action Input: {"a": 1, "b": "x"}'
  ELSE 'Action: sql_executor' || chr(10) || 'Action Input: {bad json'
 END AS response
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) q""",
    **_parse("turns", "episode_id, step, event_id"),
}
PROSE = {
    "prose": "SELECT conv_id, turn, text AS response FROM conversations",
    **_parse("prose", "conv_id, turn"),
}
CALLS = {
    "calls": "SELECT episode_id, step, action AS tool, action_input FROM turns_parsed WHERE type = 'action'",
    "params": "SELECT * FROM (VALUES "
    + ", ".join(
        "('{}', '{}', {}, '{}', {}, {})".format(
            tool, param, at, kind, required, "NULL" if default is None else f"'{default}'"
        )
        for at, (tool, param, kind, required, default) in enumerate(fv.TOOL_PARAMETERS)
    )
    + ") AS t(tool, param, position, type, required, default_value)",
    "given": """SELECT episode_id, step, tool, unnest(json_keys(action_input)) AS param FROM calls
 WHERE json_type(action_input) = 'OBJECT'""",
    "problems": r"""SELECT c.episode_id, c.step, p.position, p.param, CASE
 WHEN p.required AND NOT list_contains(json_keys(c.action_input), p.param) THEN 'missing_parameter'
 WHEN p.type = 'int' AND list_contains(json_keys(c.action_input), p.param) AND
  CASE json_type(c.action_input, '$.' || p.param)
   WHEN 'VARCHAR' THEN NOT regexp_full_match(json_extract_string(c.action_input, '$.' || p.param), '\s*[+-]?\d+\s*')
   ELSE json_type(c.action_input, '$.' || p.param) IN ('ARRAY', 'OBJECT') END THEN 'bad_type' END AS problem
 FROM calls c JOIN params p ON p.tool = c.tool WHERE json_type(c.action_input) = 'OBJECT'""",
    "checked": """SELECT c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM params p WHERE p.tool = c.tool) THEN 'unknown_tool'
 WHEN json_type(c.action_input) <> 'OBJECT' THEN 'arguments_not_object' ELSE coalesce(f.problem, 'ok') END AS status, f.param AS problem_param FROM calls c LEFT JOIN
 (SELECT episode_id, step, arg_min(problem, position) AS problem, arg_min(param, position) AS param FROM problems
  WHERE problem IS NOT NULL GROUP BY episode_id, step) f ON f.episode_id = c.episode_id AND f.step = c.step""",
}
EPISODES = {
    "ends": """SELECT episode_id, min(CASE WHEN type IN ('answer', 'error') AND step <= 10 THEN step END) AS ended
 FROM turns_parsed GROUP BY episode_id""",
    "outcomes": f"""SELECT e.episode_id, CASE WHEN e.ended IS NULL THEN 'max_iterations' WHEN p.type = 'answer' THEN 'success'
 ELSE 'failure' END AS status, coalesce(p.type = 'answer', false) AS success, coalesce(e.ended, 10) AS iterations,
 CAST((SELECT count(*) FROM turns_parsed c WHERE c.episode_id = e.episode_id AND c.type = 'action'
  AND c.step < coalesce(e.ended, 11)) AS INTEGER) AS tool_calls, p.answer, {_number("p.answer")} AS answer_number,
 CASE WHEN e.ended IS NULL THEN 'no answer within 10 steps'
  WHEN p.type = 'error' THEN 'unreadable turn: ' || p.error END AS error
 FROM ends e LEFT JOIN turns_parsed p ON p.episode_id = e.episode_id AND p.step = e.ended""",
    "expected": """SELECT e.episode_id, CASE CAST(e.episode_id % 5 AS INTEGER) WHEN 0 THEN 'aggregation' WHEN 1 THEN 'billing'
 WHEN 2 THEN 'load_factor' WHEN 3 THEN 'count' ELSE 'plot' END AS category,
 CASE WHEN e.episode_id % 11 = 0 THEN 0.0::DOUBLE
 ELSE CAST(t.cents * CAST(1 + (e.episode_id % 5 - 2) * 0.03 AS DECIMAL(4,2)) AS DOUBLE) END AS expected,
 CASE WHEN e.episode_id % 5 = 4 THEN 'plot_exists' WHEN e.episode_id % 4 = 0 THEN 'exact' ELSE 'relative' END AS kind
 FROM ends e LEFT JOIN turns_parsed p ON p.episode_id = e.episode_id AND p.step = e.ended AND p.type = 'answer'
 LEFT JOIN turns t ON t.event_id = p.event_id""",
    "parts": """SELECT o.episode_id, category, success, CASE WHEN tool_calls > 0 THEN 2.0 ELSE -5.0 END::DOUBLE AS tool_part,
 CASE WHEN tool_calls = 0 THEN 0.0 WHEN success THEN 3.0 ELSE -3.0 END::DOUBLE AS success_part,
 CASE WHEN tool_calls > 0 AND success AND CASE WHEN kind = 'plot_exists' THEN EXISTS (SELECT 1 FROM turns_parsed v
   JOIN events e ON e.event_id = v.event_id WHERE v.episode_id = o.episode_id AND e.event_type NOT IN ('error', 'view')
   AND e.event_id % 5 IN (0, 1)) WHEN kind = 'exact' THEN abs(answer_number - expected) <= 1e-6::DOUBLE
  WHEN expected = 0 THEN abs(answer_number) <= 0.05::DOUBLE
  ELSE abs(answer_number - expected) <= 0.05::DOUBLE * abs(expected) END THEN 5.0 ELSE 0.0 END::DOUBLE AS accuracy_part
 FROM outcomes o JOIN expected x ON x.episode_id = o.episode_id""",
    "rewards": "SELECT *, tool_part + success_part + accuracy_part AS reward FROM parts",
    "walked": """SELECT p.* FROM turns_parsed p JOIN outcomes o ON o.episode_id = p.episode_id
 WHERE p.step BETWEEN 1 AND o.iterations""",
    "batches": """SELECT CAST(epoch AS INTEGER) AS epoch, episode_id, row_number() OVER (PARTITION BY epoch
 ORDER BY md5(episode_id || ':' || epoch || ':42'), episode_id) AS position FROM ends, range(1, 4) r(epoch)""",
}
METRICS = "count(*) AS episodes, avg(reward) AS mean_reward, avg(CAST(success AS INTEGER)) AS success_rate"


def _episodes(select: str) -> str:
    return _with(TURNS | EPISODES, select)


def _evaluation_oracles() -> dict[str, str]:
    tools = ", ".join(dict.fromkeys(spec[0] for spec in fv.TOOL_PARAMETERS))
    both = TURNS | PROSE
    calls = TURNS | CALLS
    limits = """CAST(CASE WHEN tool = 'sql_executor' THEN CASE json_type(action_input, '$.row_limit')
 WHEN 'DOUBLE' THEN CAST(trunc(CAST(json_extract(action_input, '$.row_limit') AS DOUBLE)) AS INTEGER)
 WHEN 'BOOLEAN' THEN CASE json_extract_string(action_input, '$.row_limit') WHEN 'true' THEN 1 ELSE 0 END
 WHEN 'NULL' THEN NULL ELSE CAST(coalesce(json_extract_string(action_input, '$.row_limit'), '100') AS INTEGER) END END AS INTEGER)"""
    return {
        "parse_turns": _with(TURNS, "SELECT * EXCLUDE (event_id) FROM turns_parsed"),
        "turn_type_counts": _with(
            both,
            """SELECT source, type, count(*) AS n FROM (SELECT 'agent' AS source, type FROM turns_parsed
 UNION ALL SELECT 'prose', type FROM prose_parsed) GROUP BY ALL""",
        ),
        "parse_error_kinds": _with(
            both,
            """SELECT source, error_kind, count(*) AS n FROM (SELECT 'agent' AS source, error_kind FROM turns_parsed
 UNION ALL SELECT 'prose', error_kind FROM prose_parsed) WHERE error_kind IS NOT NULL GROUP BY ALL""",
        ),
        "json_repair_counts": _with(
            TURNS,
            rf"""SELECT action, count(*) AS inputs,
 CAST(count(*) FILTER (json_valid(raw) AND NOT regexp_matches(raw, ',\s*[\}}\]]')) AS BIGINT) AS valid_raw,
 CAST(count(*) FILTER (json_valid({_repair("raw")})) AS BIGINT) AS valid_repaired
 FROM (SELECT {_strip(_cut("n"))} AS action, {_strip(_cut("i"))} AS raw FROM turns_tails WHERE i IS NOT NULL) GROUP BY action""",
        ),
        "tool_param_specs": _with(
            calls,
            """SELECT p.tool, p.param, p.position, p.type, p.required, p.default_value, count(g.param) AS given
 FROM params p LEFT JOIN given g ON g.tool = p.tool AND g.param = p.param GROUP BY ALL""",
        ),
        "calls_unknown_tool": _with(
            calls, "SELECT episode_id, step, tool FROM checked WHERE status = 'unknown_tool'"
        ),
        "calls_missing_param": _with(
            calls,
            "SELECT episode_id, step, tool, problem_param FROM checked WHERE status = 'missing_parameter'",
        ),
        "calls_coercion": _with(
            calls,
            f"""SELECT episode_id, step, tool, {limits} AS row_limit,
 TRY_CAST(json_extract_string(action_input, '$.customer_id') AS BIGINT) AS customer_id FROM checked WHERE status = 'ok'""",
        ),
        "calls_with_defaults": _with(
            calls,
            f"""SELECT tool, CASE WHEN cut THEN 100 ELSE {limits} END AS row_limit, count(*) AS calls
 FROM (SELECT *, coalesce(tool = 'sql_executor' AND step % 3 = 0 AND json_type(action_input, '$.row_limit') = 'VARCHAR', false)
  AS cut FROM checked) WHERE status = 'ok' OR cut GROUP BY ALL""",
        ),
        "calls_extra_args": _with(
            calls,
            """SELECT tool, status, CASE WHEN status NOT IN ('unknown_tool', 'arguments_not_object') THEN CAST((SELECT count(*) FROM given g
 WHERE g.episode_id = c.episode_id AND g.step = c.step AND NOT EXISTS (SELECT 1 FROM params p WHERE p.tool = g.tool
 AND p.param = g.param)) AS INTEGER) END AS extra_arguments, count(*) AS calls FROM checked c GROUP BY ALL""",
        ),
        "call_success_by_tool": _with(
            calls,
            f"""SELECT tool, status, status = 'ok' AS success, CASE status
 WHEN 'unknown_tool' THEN 'no tool is called ''' || tool || ''', there are {tools}'
 WHEN 'missing_parameter' THEN 'parameter ''' || problem_param || ''' of tool ''' || tool || ''' is not given'
 WHEN 'bad_type' THEN 'the value of ''' || problem_param || ''' has the wrong type'
 WHEN 'arguments_not_object' THEN 'the arguments are no object' END AS error,
 count(*) AS calls FROM checked GROUP BY ALL""",
        ),
        "episode_outcomes": _episodes("SELECT * FROM outcomes"),
        "episode_tool_calls": _episodes(
            """SELECT o.episode_id, o.tool_calls, coalesce(string_agg(p.action, ',' ORDER BY p.step), '') AS tools
 FROM outcomes o LEFT JOIN turns_parsed p ON p.episode_id = o.episode_id AND p.type = 'action' AND p.step <= 10
 AND (p.step < o.iterations OR o.status = 'max_iterations') GROUP BY o.episode_id, o.tool_calls"""
        ),
        "answer_numbers": _with(
            TURNS,
            f"""SELECT event_id, number FROM (SELECT event_id, {_number("response")} AS number FROM turns)
 WHERE number IS NOT NULL""",
        ),
        "plot_artifacts_verified": """SELECT CASE event_id % 5 WHEN 0 THEN 'events.parquet' ELSE 'customer.parquet' END AS file,
 count(*) AS calls FROM events WHERE event_type NOT IN ('error', 'view') AND event_id % 5 IN (0, 1) GROUP BY ALL""",
        "episode_rewards": _episodes("SELECT * FROM rewards"),
        "reward_distribution": _episodes("SELECT reward, count(*) AS episodes FROM rewards GROUP BY reward"),
        "episode_token_usage": _episodes(
            """SELECT w.episode_id, CAST(sum(t.event_id % 500 + 100) AS BIGINT) AS prompt_tokens,
 CAST(sum(length(t.response)) AS BIGINT) AS completion_tokens,
 CAST(sum(t.event_id % 500 + 100 + length(t.response)) AS BIGINT) AS total_tokens
 FROM walked w JOIN turns t ON t.event_id = w.event_id GROUP BY w.episode_id"""
        ),
        "run_metrics": _episodes(f"SELECT {METRICS} FROM rewards"),
        "epoch_batches": _episodes(
            "SELECT epoch, episode_id, position, CAST((position - 1) // 4 AS BIGINT) AS batch FROM batches"
        ),
        "batch_metrics": _episodes(
            f"""SELECT epoch, CAST((position - 1) // 4 AS BIGINT) AS batch, {METRICS} FROM batches b
 JOIN rewards r ON r.episode_id = b.episode_id GROUP BY 1, 2"""
        ),
        "step_rewards": _episodes(
            "SELECT w.episode_id, w.step, r.reward FROM walked w JOIN rewards r ON r.episode_id = w.episode_id"
        ),
        "accuracy_by_category": _episodes(
            f"""SELECT category, {METRICS}, avg(CAST(accuracy_part > 0 AS INTEGER)) AS accuracy FROM rewards GROUP BY category"""
        ),
    }


def oracle_sql() -> dict[str, str]:
    return _meter_oracles() | _evaluation_oracles()

"""ANSI SQL for the queries of the catalog, written against the raw tables and run by another engine.

The SQL states each result on its own. It shares only the parameter values with the catalog.
"""

from __future__ import annotations

from ..operators.fixed import AGE_LABELS, AGE_LIMITS, FOREST_FEATURES, VISIT_LABELS
from . import catalog as c
from .given import DEPTH, TREES, forest_rows

ADMISSIONS = """
admissions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
                   CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus,
                   CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS admission_id,
         o_custkey AS patient_id,
         l_suppkey AS doctor_id,
         sn.n_name AS department_name,
         p_brand AS diagnosis,
         CAST(l_shipdate AS DATE) AS admission_date,
         CAST(l_quantity AS INTEGER) AS length_of_stay,
         o_orderpriority AS severity,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS total_bill,
         r_name AS insurance_provider,
         round(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(4, 2)), 2)
           AS insurance_covered,
         CAST(l_extendedprice AS DECIMAL(18, 2))
           - round(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(4, 2)), 2)
           AS patient_paid,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS readmitted_30days,
         c_mktsegment AS bed_type,
         o_orderstatus AS admission_type,
         CASE WHEN l_linestatus = 'F' THEN 'Recovered' ELSE 'Referred' END AS outcome
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region ON cn.n_regionkey = r_regionkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""

DOCTORS = """
doctors AS (
  SELECT s_suppkey AS doctor_id, s_name AS doctor_name, n_name AS specialization,
         CAST(s_suppkey % 23 + 3 AS INTEGER) AS experience_years
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
)"""

PATIENTS = """
patients AS (
  SELECT c_custkey AS patient_id,
         CAST(floor((c_acctbal + 1000) / 130) AS INTEGER) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender
  FROM customer
)"""

PROCEDURES = """
procedures AS (
  SELECT l_orderkey AS admission_id, n_name AS department_name, p_type AS procedure_name,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS cost
  FROM lineitem
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""

ORDER_ADMISSIONS = """
order_admissions AS (
  SELECT o_orderkey AS admission_id, n_name AS department_name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

SALES = """
sales AS (
  SELECT CAST(o_orderdate AS DATE) AS sale_date, CAST(o_totalprice AS DECIMAL(18, 2)) AS amount,
         r_name AS region
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
)"""

SCHEDULE = """
schedule AS (
  SELECT event_type AS station, user_id AS train, CAST(ts AS DATE) AS day FROM events
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(cte.strip() for cte in ctes) + "\n"


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _up(x: str, digits: int) -> str:
    """Round half away from zero; stays a decimal."""
    return f"round(CAST({x} AS DECIMAL(38, 8)), {digits})"


def _r(x: str, digits: int) -> str:
    return _dbl(_up(x, digits))


def _even(x: str, digits: int) -> str:
    """Round half even on the scaled double."""
    scale = float(10**digits)
    return f"(round_even({_dbl(x)} * {scale}, 0) / {scale})"


def _even_units(x: str) -> str:
    """An exact decimal rounded half even to whole units."""
    return f"CAST(round_even({_dbl(x)}, 0) AS DECIMAL(30, 0))"


def _pct(n: str, d: str) -> str:
    return f"({_dbl(n)} * 100.0 / nullif({_dbl(d)}, 0))"


def _ratio(n: str, d: str) -> str:
    return f"({_dbl(n)} / nullif({_dbl(d)}, 0))"


def _big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


AVG_BILL = _ratio("sum(total_bill)", "count(total_bill)")
READMITTED = _pct("sum(readmitted_30days)", "count(*)")
RECOVERED = _pct("count(*) FILTER (outcome = 'Recovered')", "count(*)")
MONTH = "strftime(admission_date, '%Y-%m')"


def _sources() -> dict[str, str]:
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in c.TABLES
    )
    yoy = _with(ADMISSIONS) + f"""
        SELECT CAST(year(admission_date) AS INTEGER) AS year, count(*) AS admissions,
               {_r('sum(total_bill)', 0)} AS revenue
        FROM admissions GROUP BY 1"""
    def rolled(table: str) -> str:
        return f"""
        SELECT {MONTH} AS year_month, {_dbl('sum(total_bill)')} AS total_revenue,
               count(*) AS total_admissions,
               {_even('avg(length_of_stay)', 2)} AS avg_los,
               {_big('sum(readmitted_30days)')} AS readmissions
        FROM {table} GROUP BY 1"""

    rollup = _with(ADMISSIONS) + rolled("admissions")
    months = ", ".join(f"'{m}'" for m in c.RELOADED)
    reloaded = f"""
        reloaded AS (SELECT * FROM admissions WHERE {MONTH} NOT IN ({months}) OR total_bill >= {c.LEAST_BILL})"""
    return {
        "table_read": "SELECT * FROM customer",
        "query_read": "SELECT o_orderpriority AS severity, count(*) AS total FROM orders"
        " WHERE o_totalprice >= 1000 GROUP BY 1",
        "csv_round_trip": yoy,
        "api_yoy": yoy,
        "monthly_revenue_table": rollup,
        "monthly_revenue_rollup": rollup,
        "monthly_rollup_reload": _with(ADMISSIONS, reloaded) + rolled("reloaded"),
        "table_row_counts": counts,
        "json_output": _with(ADMISSIONS)
        + """SELECT '{"severity":"' || severity || '","total":' || count(*) || '}' AS record
             FROM admissions GROUP BY severity""",
        "date_columns": """
            SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
                   CAST(year(o_orderdate) AS INTEGER) AS year,
                   CAST(month(o_orderdate) AS INTEGER) AS month,
                   strftime(o_orderdate, '%Y-%m') AS year_month
            FROM orders""",
    }


def _departments() -> dict[str, str]:
    high, medium = c.COVERAGE
    los_high, los_medium = c.LOS
    coverage = _pct("sum(insurance_covered)", "sum(total_bill)")
    covered_pct = f"({_ratio('sum(insurance_covered)', 'sum(total_bill)')} * 100)"
    pivot = ", ".join(
        f"coalesce(avg(CASE WHEN severity = '{s}' THEN readmitted_30days END) * 100, 0.0) AS \"{s}\""
        for s in c.SEVERITIES
    )
    first, last = c.YEARS[0], c.YEARS[-1]
    by_year = {
        y: f"sum(CASE WHEN yr = {y} THEN revenue ELSE 0 END)" for y in c.YEARS
    }
    years = ", ".join(f"{_dbl(x)} AS rev_{y}" for y, x in by_year.items())
    summary = f"""
        summary AS (
          SELECT department_name, count(*) AS admissions,
                 {_dbl(_even_units('sum(total_bill)'))} AS revenue,
                 {_even(AVG_BILL, 0)} AS avg_bill,
                 {_even('avg(length_of_stay)', 1)} AS avg_los,
                 {_even('avg(readmitted_30days) * 100', 1)} AS readmission_pct
          FROM admissions WHERE department_name IS NOT NULL GROUP BY 1
        ),
        shares AS (SELECT *, revenue / sum(revenue) OVER () AS revenue_share FROM summary)"""
    return {
        "dept_revenue_ranking": _with(ADMISSIONS) + f""",
            d AS (
              SELECT department_name, count(*) AS total_admissions, sum(total_bill) AS revenue,
                     {_r(AVG_BILL, 2)} AS avg_bill_per_patient,
                     {_dbl('sum(insurance_covered)')} AS insurance_recovered,
                     {_dbl('sum(patient_paid)')} AS patient_collections,
                     {_r('avg(length_of_stay)', 1)} AS avg_length_of_stay
              FROM admissions GROUP BY 1
            )
            SELECT * EXCLUDE (revenue), {_dbl('revenue')} AS total_revenue,
                   rank() OVER (ORDER BY revenue DESC) AS revenue_rank,
                   {_r(_pct('revenue', 'sum(revenue) OVER ()'), 2)} AS revenue_share_pct
            FROM d""",
        "readmission_by_dept_severity": _with(ADMISSIONS) + f"""
            SELECT department_name, severity, count(*) AS total_admissions,
                   {_big('sum(readmitted_30days)')} AS readmissions,
                   {_r(READMITTED, 2)} AS readmission_rate_pct,
                   {_r('avg(length_of_stay)', 1)} AS avg_los,
                   {_r(AVG_BILL, 0)} AS avg_bill
            FROM admissions GROUP BY 1, 2 HAVING count(*) >= {c.MIN_CELL}
            ORDER BY readmission_rate_pct DESC, department_name, severity LIMIT 20""",
        "insurer_leakage": _with(ADMISSIONS) + f"""
            SELECT insurance_provider, count(*) AS total_claims,
                   {_dbl('sum(total_bill)')} AS total_billed,
                   {_dbl('sum(insurance_covered)')} AS total_insurer_paid,
                   {_dbl('sum(patient_paid)')} AS total_patient_paid,
                   {_dbl('sum(total_bill - insurance_covered - patient_paid)')} AS revenue_gap,
                   {_r(coverage, 1)} AS insurer_coverage_pct,
                   {_r(AVG_BILL, 0)} AS avg_claim_value,
                   CASE WHEN {coverage} >= {high} THEN 'High Coverage'
                        WHEN {coverage} >= {medium} THEN 'Medium Coverage'
                        ELSE 'Low Coverage' END AS coverage_category
            FROM admissions GROUP BY 1""",
        "top_procedures": _with(PROCEDURES, ORDER_ADMISSIONS) + f""",
            g AS (
              SELECT p.procedure_name, a.department_name, count(*) AS times_performed,
                     sum(cost) AS revenue,
                     {_r(_ratio('sum(cost)', 'count(cost)'), 0)} AS avg_cost,
                     {_r('min(cost)', 0)} AS min_cost, {_r('max(cost)', 0)} AS max_cost
              FROM procedures p JOIN order_admissions a ON p.admission_id = a.admission_id
              GROUP BY 1, 2
            )
            SELECT * EXCLUDE (revenue), {_dbl('revenue')} AS total_revenue,
                   CAST(ntile(4) OVER (ORDER BY revenue DESC, procedure_name, department_name)
                        AS INTEGER) AS revenue_quartile
            FROM g ORDER BY revenue DESC, procedure_name, department_name LIMIT 20""",
        "bed_utilisation": _with(ADMISSIONS) + f"""
            SELECT bed_type, admission_type, count(*) AS admissions,
                   {_r('avg(length_of_stay)', 1)} AS avg_los_days,
                   {_r(AVG_BILL, 0)} AS avg_bill,
                   {_r('sum(total_bill)', 0)} AS total_revenue,
                   {_r(_ratio(AVG_BILL, 'avg(length_of_stay)'), 0)} AS revenue_per_day,
                   {_r(READMITTED, 1)} AS readmission_rate_pct
            FROM admissions GROUP BY 1, 2""",
        "yoy_pivot": _with(ADMISSIONS) + f""",
            y AS (
              SELECT department_name, year(admission_date) AS yr,
                     round(sum(total_bill), 0) AS revenue
              FROM admissions GROUP BY 1, 2
            )
            SELECT department_name, {years},
                   {_r(_pct(f'{by_year[last]} - {by_year[first]}', by_year[first]), 1)}
                     AS growth_{first}_to_{last}_pct
            FROM y GROUP BY 1""",
        "diagnosis_rank": _with(ADMISSIONS) + f""",
            g AS (
              SELECT diagnosis, department_name, count(*) AS cases, {AVG_BILL} AS avg_bill,
                     {_r('sum(total_bill)', 0)} AS total_revenue,
                     {_r('avg(length_of_stay)', 1)} AS avg_los,
                     {_r(READMITTED, 1)} AS readmission_rate_pct
              FROM admissions GROUP BY 1, 2 HAVING count(*) >= {c.MIN_CASES}
            )
            SELECT * EXCLUDE (avg_bill), {_r('avg_bill', 0)} AS avg_treatment_cost,
                   dense_rank() OVER (ORDER BY cases DESC) AS frequency_rank,
                   dense_rank() OVER (ORDER BY avg_bill DESC) AS cost_rank
            FROM g ORDER BY cases DESC, diagnosis, department_name LIMIT 25""",
        "api_departments": _with(ADMISSIONS) + f"""
            SELECT department_name, count(*) AS admissions, {_r('sum(total_bill)', 0)} AS revenue,
                   {_r(AVG_BILL, 0)} AS avg_bill, {_r('avg(length_of_stay)', 1)} AS avg_los,
                   {_r(READMITTED, 1)} AS readmission_rate, {_r(RECOVERED, 1)} AS recovery_rate
            FROM admissions GROUP BY 1""",
        "api_insurance": _with(ADMISSIONS) + f"""
            SELECT insurance_provider, count(*) AS claims, {_r('sum(total_bill)', 0)} AS billed,
                   {_r('sum(insurance_covered)', 0)} AS covered,
                   {_r('sum(patient_paid)', 0)} AS patient_paid
            FROM admissions GROUP BY 1 ORDER BY billed DESC, insurance_provider LIMIT 4""",
        "api_readmission_heatmap": _with(ADMISSIONS) + f"""
            SELECT department_name, severity, {_r(READMITTED, 0)} AS readmission_rate
            FROM admissions GROUP BY 1, 2""",
        "department_matrix": _with(ADMISSIONS) + f""",
            d AS (
              SELECT department_name, {_dbl('sum(total_bill)')} AS revenue, count(*) AS admissions,
                     avg(length_of_stay) AS avg_los, avg(readmitted_30days) AS readmission_rate,
                     {AVG_BILL} AS avg_bill
              FROM admissions WHERE department_name IS NOT NULL GROUP BY 1
            )
            SELECT *, row_number() OVER (ORDER BY revenue DESC, department_name) <= 3 AS top_revenue,
                   CASE WHEN avg_los > {los_high} THEN 'long' WHEN avg_los > {los_medium} THEN 'medium'
                        ELSE 'short' END AS los_band,
                   {_r('avg(avg_los) OVER ()', 6)} AS mean_department_los
            FROM d""",
        "readmission_severity_pivot": _with(ADMISSIONS) + f"""
            SELECT department_name, {pivot} FROM admissions
            WHERE department_name IS NOT NULL GROUP BY 1""",
        "insurance_breakdown": _with(ADMISSIONS) + f"""
            SELECT insurance_provider, count(*) AS claims, {_dbl('sum(total_bill)')} AS billed,
                   {_dbl('sum(insurance_covered)')} AS covered,
                   {_dbl('sum(patient_paid)')} AS collected,
                   {_dbl('sum(total_bill) - sum(insurance_covered) - sum(patient_paid)')} AS gap,
                   greatest({_dbl('sum(total_bill) - sum(insurance_covered) - sum(patient_paid)')}, 0.0)
                     AS gap_clipped,
                   {covered_pct} AS coverage_pct,
                   CASE WHEN {covered_pct} >= {high} THEN 'good' WHEN {covered_pct} >= {medium}
                        THEN 'moderate' ELSE 'low' END AS coverage_band
            FROM admissions WHERE insurance_provider IS NOT NULL GROUP BY 1""",
        "report_dept_summary": _with(ADMISSIONS, summary) + "SELECT * FROM shares",
        "report_dept_total_row": _with(ADMISSIONS, summary) + f""",
            both_parts AS (
              SELECT * FROM shares
              UNION ALL
              SELECT 'TOTAL', {_big('sum(admissions)')}, sum(revenue), avg(avg_bill), avg(avg_los),
                     NULL, NULL FROM shares
            )
            SELECT * REPLACE ({_r('avg_bill', 6)} AS avg_bill, {_r('avg_los', 6)} AS avg_los)
            FROM both_parts""",
        "report_diagnosis_top": _with(ADMISSIONS) + f"""
            SELECT diagnosis, department_name, count(*) AS cases, {_even(AVG_BILL, 0)} AS avg_cost,
                   {_dbl(_even_units('sum(total_bill)'))} AS total_revenue,
                   {_even('avg(length_of_stay)', 1)} AS avg_los,
                   {_even('avg(readmitted_30days) * 100', 1)} AS readmission_rate_pct,
                   avg(readmitted_30days) > {c.RISK} AS high_readmission
            FROM admissions WHERE diagnosis IS NOT NULL AND department_name IS NOT NULL
            GROUP BY 1, 2 ORDER BY cases DESC, diagnosis, department_name LIMIT 25""",
        "success_rate_vs_benchmark": _with(ADMISSIONS) + f"""
            SELECT department_name, count(*) AS admissions,
                   count(*) FILTER (outcome IN ('Recovered', 'Improved')) AS successes,
                   {_r(_pct("count(*) FILTER (outcome IN ('Recovered', 'Improved'))", 'count(*)'), 2)}
                     AS success_rate_pct,
                   {_pct("count(*) FILTER (outcome IN ('Recovered', 'Improved'))", 'count(*)')}
                     < {c.BENCHMARK} AS below_benchmark
            FROM admissions GROUP BY 1""",
    }


def _time() -> dict[str, str]:
    months = f"""
        m AS (
          SELECT {MONTH} AS ym, count(*) AS admissions, sum(total_bill) AS revenue,
                 {_even(AVG_BILL, 0)} AS avg_bill, {_big('sum(readmitted_30days)')} AS readmissions
          FROM admissions GROUP BY 1
        )"""
    return {
        "monthly_mom_growth": _with(ADMISSIONS, months) + f""",
            p AS (SELECT *, lag(revenue) OVER (ORDER BY ym) AS previous FROM m)
            SELECT ym AS year_month, admissions, {_dbl('revenue')} AS revenue,
                   {_dbl('previous')} AS prev_month_revenue,
                   {_r(_pct('revenue - previous', 'previous'), 2)} AS mom_growth_pct,
                   CASE WHEN revenue > previous THEN 'Growth' WHEN revenue < previous THEN 'Decline'
                        ELSE 'Flat' END AS trend
            FROM p""",
        "rolling_and_cumulative": _with(ADMISSIONS, months) + f"""
            SELECT ym, admissions, {_dbl('revenue')} AS revenue,
                   {_r(_ratio('sum(revenue) OVER w', 'count(*) OVER w'), 2)} AS rolling_3m_avg,
                   {_dbl('sum(revenue) OVER (ORDER BY ym ROWS UNBOUNDED PRECEDING)')}
                     AS cumulative_revenue
            FROM m WINDOW w AS (ORDER BY ym ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        "api_monthly": _with(ADMISSIONS, months)
        + f"SELECT ym, admissions, {_r('revenue', 0)} AS revenue FROM m",
        "monthly_trend_line": _with(ADMISSIONS, months) + f""",
            i AS (
              SELECT ym, CAST(row_number() OVER (ORDER BY ym) - 1 AS INTEGER) AS month_index,
                     admissions, {_dbl('revenue')} AS revenue
              FROM m
            ),
            f AS (
              SELECT regr_slope(revenue, month_index) AS slope,
                     regr_intercept(revenue, month_index) AS intercept FROM i
            )
            SELECT ym, month_index, admissions, revenue,
                   (revenue / lag(revenue) OVER (ORDER BY ym) - 1) * 100 AS mom_growth,
                   {_r('slope', 2)} AS slope, {_r('intercept', 2)} AS intercept,
                   {_r('slope * month_index + intercept', 2)} AS trend_value
            FROM i, f""",
        "report_monthly": _with(ADMISSIONS, months) + f""",
            e AS (SELECT ym, admissions, {_even_units('revenue')} AS revenue, avg_bill, readmissions
                  FROM m),
            p AS (SELECT *, lag(revenue) OVER (ORDER BY ym) AS previous,
                         sum(revenue) OVER (ORDER BY ym ROWS UNBOUNDED PRECEDING) AS so_far FROM e)
            SELECT ym, admissions, {_dbl('revenue')} AS revenue, avg_bill, readmissions,
                   {_ratio('revenue - previous', 'previous')} AS mom_growth,
                   {_dbl('so_far')} AS cumulative_revenue
            FROM p""",
        "daily_sales": _with(SALES) + f""",
            d AS (SELECT sale_date, count(*) AS sales, sum(amount) AS total FROM sales GROUP BY 1),
            p AS (SELECT *, lag(total) OVER (ORDER BY sale_date) AS previous FROM d)
            SELECT sale_date, sales, {_dbl('total')} AS total_sales,
                   {_r(_pct('total - previous', 'previous'), 2)} AS growth_pct
            FROM p""",
        "daily_sales_growth": _with(SALES) + f""",
            d AS (SELECT sale_date, sum(amount) AS total FROM sales GROUP BY 1),
            o AS (SELECT
              (SELECT min(sale_date) FROM d) AS first_day,
              (SELECT max(sale_date) FROM d) AS last_day,
              (SELECT sale_date FROM d ORDER BY total DESC, sale_date LIMIT 1) AS peak_day,
              (SELECT sale_date FROM d ORDER BY total, sale_date LIMIT 1) AS dip_day),
            v AS (SELECT o.*,
              (SELECT total FROM d WHERE sale_date = first_day) AS opening,
              (SELECT total FROM d WHERE sale_date = last_day) AS closing,
              (SELECT total FROM d WHERE sale_date = peak_day) AS peak,
              (SELECT total FROM d WHERE sale_date = dip_day) AS dip FROM o)
            SELECT first_day, last_day, peak_day, {_dbl('peak')} AS peak_sales, dip_day,
                   {_dbl('dip')} AS dip_sales,
                   {_r(_pct('closing - opening', 'opening'), 2)} AS growth_pct
            FROM v""",
    }


def _kpis() -> dict[str, str]:
    coverage = _pct("sum(insurance_covered)", "sum(total_bill)")

    def frequency(column: str) -> str:
        return _with(ADMISSIONS) + f"SELECT {column}, count(*) AS total FROM admissions GROUP BY 1"

    return {
        "executive_kpis": _with(ADMISSIONS) + f"""
            SELECT count(DISTINCT patient_id) AS total_unique_patients,
                   count(*) AS total_admissions,
                   {_r(_dbl('sum(total_bill)') + ' / 1e7', 2)} AS total_revenue_crore,
                   {_r(AVG_BILL, 0)} AS avg_bill_per_admission,
                   {_r('avg(length_of_stay)', 1)} AS avg_length_of_stay,
                   {_r(READMITTED, 2)} AS overall_readmission_rate_pct,
                   {_r(coverage, 1)} AS insurance_coverage_pct,
                   (SELECT department_name FROM admissions GROUP BY 1
                    ORDER BY sum(total_bill) DESC, department_name LIMIT 1) AS top_revenue_dept,
                   count(*) FILTER (outcome = 'Recovered') AS total_recoveries,
                   {_r(RECOVERED, 1)} AS recovery_rate_pct
            FROM admissions""",
        "api_kpis": _with(ADMISSIONS) + f"""
            SELECT {_r(_dbl('sum(total_bill)') + ' / 1e7', 2)} AS total_revenue_crore,
                   count(*) AS total_admissions, count(DISTINCT patient_id) AS unique_patients,
                   {_r(AVG_BILL, 0)} AS avg_bill, {_r('avg(length_of_stay)', 1)} AS avg_los,
                   {_r(READMITTED, 1)} AS readmission_rate, {_r(coverage, 1)} AS insurance_pct,
                   {_r(RECOVERED, 1)} AS recovery_rate
            FROM admissions""",
        "kpi_overview": _with(ADMISSIONS) + f"""
            SELECT count(DISTINCT patient_id) AS unique_patients, count(*) AS total_admissions,
                   {_dbl('sum(total_bill)')} AS total_revenue, {AVG_BILL} AS avg_bill,
                   avg(length_of_stay) AS avg_los,
                   avg(readmitted_30days) * 100 AS readmission_rate,
                   {_ratio('sum(insurance_covered)', 'sum(total_bill)')} * 100 AS insurance_pct,
                   {_ratio("count(*) FILTER (outcome = 'Recovered')", 'count(*)')} * 100
                     AS recovery_rate
            FROM admissions""",
        "api_severity": frequency("severity"),
        "api_outcomes": frequency("outcome"),
        "api_bed_types": frequency("bed_type"),
    }


def _doctors() -> dict[str, str]:
    per_doctor = f"""
        s AS (
          SELECT d.doctor_id, d.doctor_name, d.specialization, d.experience_years,
                 count(a.doctor_id) AS patients, count(*) AS joined, sum(total_bill) AS revenue,
                 {AVG_BILL} AS avg_bill, avg(length_of_stay) AS avg_los,
                 count(*) FILTER (outcome = 'Recovered') AS recoveries,
                 {_big('sum(readmitted_30days)')} AS readmissions
          FROM doctors d LEFT JOIN admissions a ON d.doctor_id = a.doctor_id
          GROUP BY ALL
        )"""
    return {
        "doctor_scorecard": _with(ADMISSIONS, DOCTORS, per_doctor) + f""",
            k AS (
              SELECT *, {_r(_ratio('recoveries', 'joined') + ' * 100', 1)} AS recovery_rate_pct
              FROM s WHERE patients > 0
            )
            SELECT doctor_name, specialization, experience_years, patients AS patients_treated,
                   {_dbl('revenue')} AS total_revenue_generated,
                   {_r('avg_bill', 0)} AS avg_bill_per_patient,
                   {_r('avg_los', 1)} AS avg_patient_los, recovery_rate_pct, readmissions,
                   rank() OVER (PARTITION BY specialization ORDER BY revenue DESC)
                     AS dept_revenue_rank,
                   rank() OVER (PARTITION BY specialization ORDER BY recovery_rate_pct DESC)
                     AS dept_recovery_rank
            FROM k""",
        "api_doctors": _with(ADMISSIONS, DOCTORS, per_doctor) + f"""
            SELECT doctor_name, specialization, experience_years, patients,
                   {_r('revenue', 0)} AS revenue, {_r('avg_bill', 0)} AS avg_bill,
                   {_r(_pct('recoveries', 'joined'), 1)} AS recovery_rate, readmissions
            FROM s ORDER BY {_r('revenue', 0)} DESC NULLS LAST, doctor_id LIMIT 10""",
        "doctor_monthly_productivity": _with(ADMISSIONS, DOCTORS) + f""",
            m AS (
              SELECT d.doctor_id, doctor_name, specialization, {MONTH} AS ym,
                     count(*) AS patients, round(sum(total_bill), 0) AS revenue
              FROM admissions a JOIN doctors d ON a.doctor_id = d.doctor_id GROUP BY ALL
            ),
            g AS (
              SELECT doctor_name, specialization,
                     {_ratio('sum(revenue)', 'count(revenue)')} AS average,
                     {_dbl('sum(revenue)')} AS total_revenue,
                     {_big('sum(patients)')} AS total_patients, count(ym) AS active_months
              FROM m GROUP BY 1, 2
            )
            SELECT * EXCLUDE (average), {_r('average', 0)} AS avg_monthly_revenue,
                   rank() OVER (PARTITION BY specialization ORDER BY average DESC) AS rank_in_dept
            FROM g""",
        "report_doctor_tiers": _with(ADMISSIONS, DOCTORS, per_doctor) + f""",
            m AS (SELECT * FROM s WHERE patients > 0),
            q AS (SELECT quantile_cont({_dbl('revenue')}, 0.75) AS upper_q,
                         quantile_cont({_dbl('revenue')}, 0.5) AS median_q FROM m)
            SELECT doctor_name, specialization, experience_years, patients,
                   {_dbl(_even_units('revenue'))} AS revenue, {_even('avg_bill', 0)} AS avg_bill,
                   {_even(_ratio('recoveries', 'patients') + ' * 100', 1)} AS recovery_rate_pct, readmissions,
                   CASE WHEN revenue > upper_q THEN 'Top' WHEN revenue > median_q THEN 'Good'
                        ELSE 'Avg' END AS performance
            FROM m, q ORDER BY m.revenue DESC, doctor_id LIMIT 30""",
    }


def _patients() -> dict[str, str]:
    one, two, few, many = VISIT_LABELS
    visits = f"""
        v AS (
          SELECT patient_id, count(*) AS total_visits, min(admission_date) AS first_visit,
                 max(admission_date) AS last_visit, sum(total_bill) AS lifetime_value,
                 {_up(AVG_BILL, 2)} AS avg_spend
          FROM admissions GROUP BY 1
        )"""
    bands = " ".join(
        f"WHEN age < {limit} THEN '{label}'"
        for limit, label in zip(AGE_LIMITS, AGE_LABELS, strict=False)
    )
    features = """
        features AS (
          SELECT s.*, age FROM (
            SELECT patient_id, CAST(sum(total_bill) AS DOUBLE) AS total_spend, count(*) AS visits,
                   avg(length_of_stay) AS avg_los,
                   CAST(sum(readmitted_30days) AS BIGINT) AS readmissions
            FROM admissions WHERE patient_id IS NOT NULL GROUP BY 1) s
          LEFT JOIN patients p ON s.patient_id = p.patient_id
          WHERE age IS NOT NULL AND total_spend IS NOT NULL AND avg_los IS NOT NULL
        )"""
    spend = _ratio("sum(CAST(total_spend AS DECIMAL(18, 2)))", "count(*)")
    inputs = ("total_spend", "visits", "avg_los", "readmissions", "age")
    means = ", ".join(f"avg({x}::DOUBLE) AS m_{x}, stddev_samp({x}::DOUBLE) AS d_{x}" for x in inputs)
    units = ", ".join(f"({x}::DOUBLE - m_{x}) / d_{x} AS {x}" for x in inputs)
    middles = ", ".join(f"avg({x}) AS c_{x}" for x in inputs)
    square = " + ".join(f"({x} - c_{x}) * ({x} - c_{x})" for x in inputs)
    assigned = f"""
        units AS (SELECT patient_id, CAST(patient_id % 4 AS INTEGER) AS given, {units}
                  FROM features, (SELECT {means} FROM features)),
        centres AS (SELECT given AS segment, {middles} FROM units GROUP BY 1),
        nearest AS (SELECT patient_id, min({{'d': {square}, 'segment': segment}}) AS best
                    FROM units, centres GROUP BY 1)"""
    labelled = f"""
        g AS (SELECT *, CAST(patient_id % 4 AS INTEGER) AS segment FROM features),
        means AS (SELECT segment, {spend} AS spend, avg(visits) AS visits, avg(avg_los) AS los
                  FROM g GROUP BY 1),
        labelled AS (
          SELECT *, CASE
            WHEN segment = (SELECT segment FROM means ORDER BY spend, segment LIMIT 1)
              THEN 'Low Engagement'
            WHEN segment = (SELECT segment FROM means ORDER BY los DESC, segment LIMIT 1)
              THEN 'Complex Care'
            WHEN segment = (SELECT segment FROM means ORDER BY visits DESC, segment LIMIT 1)
              THEN 'Frequent'
            WHEN segment = (SELECT segment FROM means ORDER BY spend DESC, segment LIMIT 1)
              THEN 'High Value'
            ELSE 'Segment ' || segment END AS segment_label
          FROM g
        )"""

    def scaled(column: str) -> str:
        low, high = f"min({column}) OVER ()", f"max({column}) OVER ()"
        return f"{_r(f'({column} - {low}) / ({high} - {low} + 1e-9)', 4)} AS {column}"

    return {
        "patient_visits": _with(ADMISSIONS, visits) + f"""
            SELECT patient_id, total_visits, first_visit, last_visit,
                   {_dbl('lifetime_value')} AS lifetime_value,
                   {_dbl('avg_spend')} AS avg_spend_per_visit
            FROM v""",
        "visit_cohorts": _with(ADMISSIONS, visits) + f"""
            SELECT CASE WHEN total_visits = 1 THEN '{one}' WHEN total_visits = 2 THEN '{two}'
                        WHEN total_visits <= 4 THEN '{few}' ELSE '{many}' END AS visit_segment,
                   count(*) AS patients_in_segment,
                   {_r(_ratio('sum(lifetime_value)', 'count(*)'), 0)} AS avg_lifetime_value,
                   {_r('sum(lifetime_value)', 0)} AS segment_total_revenue,
                   {_r(_ratio('sum(avg_spend)', 'count(*)'), 0)} AS avg_spend_per_visit
            FROM v GROUP BY 1""",
        "age_group_profile": _with(ADMISSIONS, PATIENTS) + f"""
            SELECT CASE {bands} ELSE '{AGE_LABELS[-1]}' END AS age_group, count(*) AS admissions,
                   count(DISTINCT a.patient_id) AS unique_patients,
                   {_r(AVG_BILL, 0)} AS avg_bill, {_r('sum(total_bill)', 0)} AS total_revenue,
                   {_r('avg(length_of_stay)', 1)} AS avg_los,
                   {_r(READMITTED, 1)} AS readmission_rate_pct,
                   count(*) FILTER (severity = '{c.CRITICAL}') AS critical_cases
            FROM admissions a JOIN patients p ON a.patient_id = p.patient_id GROUP BY 1""",
        "spend_deciles": _with(ADMISSIONS) + f""",
            s AS (SELECT patient_id, sum(total_bill) AS spend FROM admissions GROUP BY 1),
            n AS (SELECT *, ntile(10) OVER (ORDER BY spend DESC, patient_id) AS spend_decile FROM s)
            SELECT spend_decile, count(*) AS patients,
                   {_r(_ratio('sum(spend)', 'count(*)'), 0)} AS avg_spend,
                   {_r('sum(spend)', 0)} AS total_revenue,
                   {_r(_pct('sum(spend)', '(SELECT sum(total_bill) FROM admissions)'), 2)}
                     AS pct_of_total_revenue
            FROM n GROUP BY 1""",
        "patient_features": _with(ADMISSIONS, PATIENTS, features) + "SELECT * FROM features",
        "referred_return_rate": _with(ADMISSIONS) + f""",
            d AS (SELECT *, max(admission_date) OVER (PARTITION BY patient_id) AS last_day
                  FROM admissions)
            SELECT count(*) AS referred_admissions,
                   count(*) FILTER (admission_date < last_day) AS returned,
                   {_r(_pct('count(*) FILTER (admission_date < last_day)', 'count(*)'), 2)}
                     AS return_rate_pct
            FROM d WHERE outcome = 'Referred'""",
        "segment_assignment_of_given": _with(ADMISSIONS, PATIENTS, features, assigned) + f"""
            SELECT patient_id, best.segment AS segment,
                   {_r('(SELECT sum(best.d) FROM nearest)', 2)} AS total_cost
            FROM nearest""",
        "segment_summary_of_given": _with(ADMISSIONS, PATIENTS, features, labelled) + f"""
            SELECT segment_label, count(*) AS patients, {spend} AS avg_spend,
                   {_dbl('sum(CAST(total_spend AS DECIMAL(18, 2)))')} AS total_revenue
            FROM labelled GROUP BY 1""",
        "segment_profile_of_given": _with(ADMISSIONS, PATIENTS, features, labelled) + f""",
            avgs AS (SELECT segment_label, avg(total_spend) AS total_spend, avg(visits) AS visits,
                            avg(avg_los) AS avg_los FROM labelled GROUP BY 1)
            SELECT segment_label, {', '.join(scaled(x) for x in ('total_spend', 'visits', 'avg_los'))}
            FROM avgs""",
    }


def _operations() -> dict[str, str]:
    return {
        "procedure_kpis": _with(PROCEDURES) + f"""
            SELECT count(*) AS total_procedures,
                   {_r(_ratio('sum(cost)', 'count(cost)'), 2)} AS avg_cost,
                   {_dbl('sum(cost)')} AS total_cost
            FROM procedures""",
        "department_procedure_volume": _with(PROCEDURES) + """
            SELECT department_name, count(*) AS procedures,
                   rank() OVER (ORDER BY count(*) DESC) AS volume_rank
            FROM procedures GROUP BY 1""",
        "procedures_per_admission": _with(PROCEDURES) + """
            SELECT procedures, count(*) AS admissions
            FROM (SELECT admission_id, count(*) AS procedures FROM procedures GROUP BY 1) GROUP BY 1""",
        "volume_revenue_correlation": _with(PROCEDURES) + f"""
            SELECT count(*) AS departments, {_r('corr(procedures, revenue)', 6)} AS correlation
            FROM (SELECT count(*) AS procedures, {_dbl('sum(cost)')} AS revenue
                  FROM procedures GROUP BY department_name)""",
        "sales_kpis": _with(SALES) + f"""
            SELECT {_dbl('sum(amount)')} AS total_sales, count(*) AS transactions,
                   {_r(_ratio('sum(amount)', 'count(amount)'), 2)} AS avg_sale,
                   {_dbl('max(amount)')} AS max_sale
            FROM sales""",
        "sales_share_by_region": _with(SALES) + f"""
            SELECT region, {_dbl('sum(amount)')} AS total_sales,
                   {_r(_pct('sum(amount)', '(SELECT sum(amount) FROM sales)'), 2)} AS share_pct
            FROM sales GROUP BY 1""",
        "schedule_kpis": _with(SCHEDULE) + """
            SELECT count(DISTINCT train) AS trains, count(DISTINCT station) AS stations,
                   count(*) AS schedules FROM schedule""",
        "schedule_frequency": _with(SCHEDULE) + f"""
            SELECT station, count(*) AS schedules, count(DISTINCT train) AS trains,
                   {_r(_pct('count(*)', '(SELECT count(*) FROM schedule)'), 2)} AS share_pct
            FROM schedule GROUP BY 1""",
        "utilisation_ratio": _with(SCHEDULE) + f""",
            d AS (SELECT station, day, count(*) AS n FROM schedule GROUP BY 1, 2),
            u AS (SELECT station, arg_max(n, day) AS current_schedules, max(n) AS max_schedules
                  FROM d GROUP BY 1)
            SELECT *, {_r(_ratio('current_schedules', 'max_schedules'), 4)} AS utilisation FROM u""",
    }


def _codes(*columns: str) -> str:
    """Alphabetical code of each (source, name) pair, from 0."""
    pairs = [c.split(":") for c in columns]
    return ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {source}) - 1 AS INTEGER) AS {name}" for source, name in pairs
    )


# Text columns that the risk model codes.
CODED = ("severity", "department_name", "diagnosis", "bed_type", "admission_type", "gender", "insurance_provider")


def _fold(label: str, salt: str) -> str:
    """Position among the rows of a label by a hash of the key, dealt out in turn to 5 folds."""
    return f"""(row_number() OVER (PARTITION BY {label} ORDER BY md5('{salt}' || admission_id), admission_id)
                - 1) % 5"""


def _models() -> dict[str, str]:
    coded = _codes(
        "department_name:department_code",
        "severity:severity_code",
        "bed_type:bed_code",
        "admission_type:admission_type_code",
        "gender:gender_code",
    )
    features = f"""
        features AS (
          SELECT admission_id, age, {coded}, length_of_stay,
                 {_dbl('total_bill')} AS total_bill, {_dbl('insurance_covered')} AS insurance_covered,
                 {_dbl('patient_paid')} AS patient_paid,
                 CAST(month(admission_date) AS INTEGER) AS month, readmitted_30days
          FROM admissions a LEFT JOIN patients p ON a.patient_id = p.patient_id
        )"""
    risk_codes = _codes(
        "severity:severity_code",
        "department_name:department_code",
        "diagnosis:diagnosis_code",
        "bed_type:bed_code",
        "admission_type:admission_type_code",
        "gender:gender_code",
        "insurance_provider:insurance_code",
    )
    attributes = ("age", "gender", "doctor_name", "specialization", "experience_years")
    facts = ", ".join(f"a.{x}" for x in c.RISK_FACTS if x not in ("total_bill", *attributes))
    split = f"""
        split AS (
          SELECT *, CASE WHEN {_fold('readmitted_30days', 'split')} = 0 THEN 'test' ELSE 'train' END AS part
          FROM features WHERE age IS NOT NULL
        )"""
    words = " UNION ALL ".join(f"SELECT '{x}' AS \"column\", {x} AS value FROM joined" for x in CODED)
    dictionary = f"""
        joined AS (SELECT a.*, p.gender FROM admissions a LEFT JOIN patients p ON a.patient_id = p.patient_id),
        words AS ({words})"""
    # A row per admission and tree, taken from node to node.
    steps = "".join(
        f""",
        at{i + 1} AS (
          SELECT r.admission_id, r.readmitted_30days, r.x, r.tree,
                 CASE WHEN r.x[n.feature + 1] <= n.threshold THEN n.lft ELSE n.rgt END AS node
          FROM at{i} r JOIN nodes n ON n.tree = r.tree AND n.node = r.node
        )"""
        for i in range(DEPTH)
    )
    values = ", ".join(
        f"({t}, {n}, {f}, {'NULL' if v is None else v}::DOUBLE, {left}, {right}, {s}::DOUBLE)"
        for t, n, f, v, left, right, s in forest_rows()
    )
    inputs = ", ".join(f"{f}::DOUBLE" for f in FOREST_FEATURES)
    given = f"""
        nodes(tree, node, feature, threshold, lft, rgt, share) AS (VALUES {values}),
        at0 AS (
          SELECT admission_id, readmitted_30days, [{inputs}] AS x, tree, 0 AS node
          FROM features, range({TREES}) AS trees(tree) WHERE age IS NOT NULL
        ){steps},
        shares AS (
          SELECT admission_id, readmitted_30days, avg(share) AS probability
          FROM at{DEPTH} r JOIN nodes n ON n.tree = r.tree AND n.node = r.node GROUP BY 1, 2
        ),
        scored AS (SELECT *, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM shares)"""
    walked = _with(ADMISSIONS, PATIENTS, features, given)
    return {
        "readmission_features": _with(ADMISSIONS, PATIENTS, features)
        + "SELECT * FROM features WHERE age IS NOT NULL",
        "train_test_split_stratified": _with(ADMISSIONS, PATIENTS, features, split)
        + "SELECT admission_id, readmitted_30days, part FROM split",
        "readmission_model_check": _with(ADMISSIONS, PATIENTS, features, split) + """
            SELECT admission_id, readmitted_30days, true AS probability_in_range, true AS prediction_valid,
                   true AS equals_walk
            FROM split WHERE part = 'test'""",
        "forest_scores_of_given": walked + "SELECT admission_id, readmitted_30days, prediction, probability FROM scored",
        "confusion_matrix_of_given_forest": walked + """
            SELECT a.v AS actual, p.v AS predicted, count(admission_id) AS admissions
            FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) p(v)
            LEFT JOIN scored ON readmitted_30days = a.v AND prediction = p.v
            GROUP BY 1, 2""",
        "model_auc_check": _with(ADMISSIONS, PATIENTS, features) + """
            SELECT count(*) AS admissions, true AS in_range, true AS held_out_equal, true AS folds_equal
            FROM features WHERE age IS NOT NULL""",
        "risk_model_cv_auc_check": _with(ADMISSIONS) + """
            SELECT count(*) AS admissions, true AS in_range, true AS folds_equal FROM admissions""",
        "risk_model_optimality": """
            SELECT range::INTEGER AS fold, true AS gradient_vanishes, true AS values_are_block_means, true AS monotone
            FROM range(5)""",
        "code_dictionary": _with(ADMISSIONS, PATIENTS, dictionary) + """
            SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT * FROM words WHERE value IS NOT NULL)""",
        "auc_of_given_score": _with(ADMISSIONS) + """,
            cells AS (SELECT department_name, severity, sum(readmitted_30days)::DOUBLE / count(*) AS score,
                             count(*) FILTER (readmitted_30days = 1) AS pos,
                             count(*) FILTER (readmitted_30days = 0) AS neg
                      FROM admissions GROUP BY 1, 2),
            ranked AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg,
                              coalesce(sum(sum(neg)) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                           AND 1 PRECEDING), 0) AS below
                       FROM cells GROUP BY score)
            SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
                   sum(pos * (2 * below + neg))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE * 2) AS auc
            FROM ranked""",
        "confusion_matrix_totals": _with(ADMISSIONS, PATIENTS, features, split) + """
            SELECT y AS actual, count(admission_id) AS admissions
            FROM (VALUES (0), (1)) v(y) LEFT JOIN split ON readmitted_30days = y AND part = 'test'
            GROUP BY 1""",
        "feature_importance_check": f"""
            SELECT unnest([{", ".join(f"'{f}'" for f in FOREST_FEATURES)}]) AS feature,
                   true AS not_negative, true AS sums_to_one""",
        "expected_probability_check": _with(ADMISSIONS) + """
            SELECT admission_id, true AS in_range, true AS calibrated FROM admissions""",
        "segment_patients_check": _with(ADMISSIONS, PATIENTS) + """
            SELECT DISTINCT patient_id, true AS valid, true AS all_used
            FROM admissions JOIN patients USING (patient_id)
            WHERE age IS NOT NULL""",
        "fold_assignment": _with(ADMISSIONS) + f""",
            dealt AS (SELECT readmitted_30days, {_fold('readmitted_30days', 'outer')} AS fold FROM admissions)
            SELECT fold::INTEGER AS fold, readmitted_30days, count(*) AS admissions FROM dealt GROUP BY 1, 2""",
        "confusion_matrix_of_rule": _with(ADMISSIONS) + f""",
            r AS (SELECT readmitted_30days AS actual,
                         CASE WHEN severity IN ('{c.SEVERITIES[0]}', '{c.SEVERITIES[3]}') THEN 1 ELSE 0
                         END AS predicted FROM admissions),
            grid AS (SELECT a.v AS actual, p.v AS predicted
                     FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) p(v))
            SELECT g.actual, g.predicted, count(r.actual) AS admissions
            FROM grid g LEFT JOIN r ON r.actual = g.actual AND r.predicted = g.predicted
            GROUP BY 1, 2""",
        "risk_frame": _with(ADMISSIONS, PATIENTS, DOCTORS) + f"""
            SELECT {facts}, {_dbl('total_bill')} AS total_bill,
                   coalesce({_dbl('age')}, median(age) OVER ()) AS age,
                   coalesce(gender, 'Unknown') AS gender,
                   doctor_name, specialization, experience_years, {risk_codes},
                   CAST(month(admission_date) AS INTEGER) AS month
            FROM admissions a
            LEFT JOIN patients p ON a.patient_id = p.patient_id
            LEFT JOIN doctors d ON a.doctor_id = d.doctor_id""",
    }


def _attribution() -> dict[str, str]:
    mix = f"""
        cells AS (
          SELECT department_name AS cd, severity AS cs,
                 CAST({READMITTED} / 100 AS DECIMAL(12, 8)) AS expected_prob
          FROM admissions GROUP BY 1, 2
        ),
        coded AS (
          SELECT a.*, age, expected_prob, dense_rank() OVER (ORDER BY severity) - 1 AS severity_code
          FROM admissions a
          LEFT JOIN cells ON department_name = cd AND severity = cs
          LEFT JOIN patients p ON a.patient_id = p.patient_id
        ),
        mix AS (
          SELECT d.doctor_id, doctor_name, specialization, experience_years,
                 count(*) AS n_patients, avg(readmitted_30days) AS actual_readmit_rate,
                 {_ratio('sum(expected_prob)', 'count(expected_prob)')} AS expected_readmit_rate,
                 avg(severity_code) AS avg_severity, avg(age) AS avg_patient_age,
                 {_dbl('sum(total_bill)')} AS revenue_generated,
                 {_ratio("count(*) FILTER (outcome = 'Recovered')", 'count(*)')} AS recovery_rate
          FROM doctors d JOIN coded a ON d.doctor_id = a.doctor_id
          WHERE specialization IS NOT NULL GROUP BY ALL
        )"""
    scores = f"""
        deviation AS (SELECT *, expected_readmit_rate AS avg_complexity,
                             actual_readmit_rate - expected_readmit_rate AS attribution_score FROM mix),
        scaled AS (
          SELECT *,
            {_even('attribution_score / max(abs(attribution_score)) OVER () * 100', 1)}
              AS attribution_score_norm,
            {_even('(avg_complexity - min(avg_complexity) OVER ()) / (max(avg_complexity) OVER ()'
                   ' - min(avg_complexity) OVER ()) * 100', 1)} AS complexity_score
          FROM deviation
        ),
        medians AS (SELECT quantile_cont(complexity_score, 0.5) AS mc,
                           quantile_cont(actual_readmit_rate, 0.5) AS ma FROM scaled),
        placed AS (
          SELECT scaled.*,
            CASE WHEN complexity_score >= mc AND actual_readmit_rate < ma THEN 'Hidden Star'
                 WHEN complexity_score >= mc THEN 'Overloaded'
                 WHEN actual_readmit_rate < ma THEN 'Solid' ELSE 'Quality Gap' END AS quadrant,
            rank() OVER (ORDER BY actual_readmit_rate)
              + (count(*) OVER (PARTITION BY actual_readmit_rate) - 1) / 2.0 AS raw_rank,
            rank() OVER (ORDER BY attribution_score_norm)
              + (count(*) OVER (PARTITION BY attribution_score_norm) - 1) / 2.0 AS adj_rank
          FROM scaled, medians
        ),
        scores AS (SELECT * REPLACE ({_dbl('raw_rank')} AS raw_rank, {_dbl('adj_rank')} AS adj_rank),
                          round_even({_dbl('raw_rank - adj_rank')}, 0) AS rank_shift FROM placed)"""
    mixed = _with(ADMISSIONS, PATIENTS, DOCTORS, mix)
    base = _with(ADMISSIONS, PATIENTS, DOCTORS, mix, scores)
    return {
        "doctor_case_mix": mixed + "SELECT *, expected_readmit_rate AS avg_complexity FROM mix",
        "attribution_score": base + "SELECT doctor_id, attribution_score_norm FROM scores",
        "complexity_score": base + "SELECT doctor_id, complexity_score FROM scores",
        "quadrant": base + "SELECT doctor_id, quadrant FROM scores",
        "rank_shift": base + "SELECT doctor_id, raw_rank, adj_rank, rank_shift FROM scores",
        "attribution_scores": base + f"""
            SELECT doctor_name, specialization, experience_years, n_patients,
                   {_even('actual_readmit_rate', 3)} AS actual_readmit_rate,
                   {_even('expected_readmit_rate', 3)} AS expected_readmit_rate,
                   attribution_score_norm, complexity_score,
                   {_even('recovery_rate', 3)} AS recovery_rate,
                   {_even('revenue_generated', 0)} AS revenue_generated, quadrant, rank_shift
            FROM scores""",
        "top_hidden_stars": base + """
            SELECT doctor_id, complexity_score FROM scores WHERE quadrant = 'Hidden Star'
            ORDER BY complexity_score DESC, doctor_id LIMIT 3""",
        "top_quality_gaps": base + """
            SELECT doctor_id, attribution_score_norm FROM scores WHERE quadrant = 'Quality Gap'
            ORDER BY attribution_score_norm DESC, doctor_id LIMIT 3""",
        "top_rank_shift": base + """
            SELECT doctor_id, rank_shift FROM scores ORDER BY rank_shift DESC, doctor_id LIMIT 5""",
        "rank_shift_extremes": base + """
            (SELECT doctor_id, rank_shift FROM scores ORDER BY rank_shift DESC, doctor_id LIMIT 10)
            UNION
            (SELECT doctor_id, rank_shift FROM scores ORDER BY rank_shift, doctor_id LIMIT 10)""",
        "dept_actual_vs_expected": base + f"""
            SELECT specialization, {_r('avg(actual_readmit_rate)', 6)} AS actual,
                   {_r('avg(expected_readmit_rate)', 6)} AS expected, {_big('sum(n_patients)')} AS n
            FROM scores GROUP BY 1""",
        "experience_effect": base + f""",
            f AS (SELECT regr_slope(attribution_score_norm, experience_years) AS slope,
                         regr_intercept(attribution_score_norm, experience_years) AS intercept,
                         corr(experience_years, attribution_score_norm) AS pearson_r FROM scores)
            SELECT {_r('slope', 6)} AS slope, {_r('intercept', 6)} AS intercept,
                   {_r('pearson_r', 6)} AS pearson_r,
                   CASE WHEN pearson_r < -0.1 THEN 'experienced doctors perform better'
                        WHEN pearson_r > 0.1 THEN 'experience does not predict quality'
                        ELSE 'no strong relationship' END AS verdict
            FROM f""",
        "quadrant_counts": base + "SELECT quadrant, count(*) AS doctors FROM scores GROUP BY 1",
        "complexity_extremes": base + """
            (SELECT doctor_id, doctor_name, specialization, complexity_score, actual_readmit_rate,
                    'most complex' AS panel
             FROM scores ORDER BY complexity_score DESC, doctor_id LIMIT 1)
            UNION ALL
            (SELECT doctor_id, doctor_name, specialization, complexity_score, actual_readmit_rate,
                    'least complex' AS panel
             FROM scores ORDER BY complexity_score, doctor_id LIMIT 1)""",
    }


def all_sql() -> dict[str, str]:
    parts = (
        _sources(),
        _departments(),
        _time(),
        _kpis(),
        _doctors(),
        _patients(),
        _operations(),
        _models(),
        _attribution(),
    )
    return {name: sql for part in parts for name, sql in part.items()}

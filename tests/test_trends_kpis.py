import pytest

from caregauge.operators import kpis, trends

from .conftest import by


def test_first_month_is_flat_and_gaps_are_skipped(admissions):
    rows = trends.monthly_mom_growth(admissions).collect()
    assert [r.year_month for r in rows] == ["2021-01", "2021-02", "2021-04", "2022-04", "2022-05", "2022-06"]
    assert (rows[0].prev_month_revenue, rows[0].mom_growth_pct, rows[0].trend) == (None, None, "Flat")
    assert (rows[1].mom_growth_pct, rows[1].trend) == (-50.01, "Decline")
    assert rows[2].prev_month_revenue == 200.0  # the month before with rows
    assert (rows[3].trend, rows[3].mom_growth_pct) == ("Flat", 0.0)


def test_growth_after_a_zero_month_is_null(admissions):
    months = admissions.where("admission_id in ('A6', 'A8')")
    rows = trends.monthly_mom_growth(months).collect()
    assert rows[1].mom_growth_pct is None and rows[1].trend == "Growth"


def test_rolling_rows_and_running_total(admissions):
    rows = trends.rolling_and_cumulative(admissions).collect()
    assert rows[2].rolling_3m_avg == round((400.10 + 200 + 600.10) / 3, 2)
    assert rows[1].rolling_3m_avg == 300.05  # only two months so far
    assert rows[-1].cumulative_revenue == 1860.55


def test_trend_line_goes_through_a_straight_series(spark):
    df = spark.createDataFrame(
        [("2021-01-01", 10.0), ("2021-02-01", 20.0), ("2021-03-01", 30.0)], "d string, total_bill double"
    ).selectExpr("to_date(d) AS admission_date", "total_bill")
    rows = trends.monthly_trend_line(df).collect()
    assert [r.month_index for r in rows] == [0, 1, 2]
    assert rows[0].slope == pytest.approx(10) and rows[0].intercept == pytest.approx(10)
    assert [r.trend_value for r in rows] == pytest.approx([10, 20, 30])
    assert rows[0].mom_growth is None and rows[1].mom_growth == pytest.approx(100)


def test_rollup_and_report(admissions):
    rollup = by(trends.monthly_revenue_rollup(admissions).collect(), "year_month")
    assert rollup["2021-01"] == {
        "year_month": "2021-01", "total_revenue": 400.10, "total_admissions": 2, "avg_los": 3.0, "readmissions": 1,
    }
    report = trends.report_monthly(admissions).collect()
    assert report[0].mom_growth is None and report[1].mom_growth == -0.5
    assert report[-1].cumulative_revenue == 400 + 200 + 600 + 600 + 50 + 10


def test_yoy_long_form(admissions):
    assert [(r.year, r.admissions, r.revenue) for r in trends.api_yoy(admissions).collect()] == [
        (2021, 4, 1200.0), (2022, 4, 660.0),
    ]
    assert trends.api_monthly(admissions).first().asDict() == {"ym": "2021-01", "admissions": 2, "revenue": 400.0}


def test_daily_sales_peak_ties_go_to_the_earliest_day(spark):
    df = spark.createDataFrame(
        [("2021-01-01", 5.0), ("2021-01-02", 9.0), ("2021-01-03", 9.0), ("2021-01-04", 4.0)], "d string, amount double"
    ).selectExpr("to_date(d) AS sale_date", "amount")
    row = trends.daily_sales_growth(df).first()
    assert str(row.peak_day) == "2021-01-02" and str(row.dip_day) == "2021-01-04"
    assert row.growth_pct == -20.0
    assert [r.growth_pct for r in trends.daily_sales(df).collect()] == [None, 80.0, 0.0, -55.56]


def test_kpis(admissions):
    row = kpis.kpi_overview(admissions).first()
    assert row.total_revenue == 1860.55 and row.unique_patients == 3
    assert row.readmission_rate == 37.5 and row.recovery_rate == 50.0
    shown = kpis.api_kpis(admissions).first()
    assert shown.avg_bill == 233.0 and shown.insurance_pct == 48.9 and shown.total_revenue_crore == 0.0


def test_executive_kpis_name_the_top_department(admissions):
    row = kpis.executive_kpis(admissions).first()
    assert row.top_revenue_dept == "General" and row.total_recoveries == 4
    tied = admissions.where("admission_id in ('A4', 'A5')").selectExpr(
        "* except(department_name)", "if(admission_id = 'A4', 'Zeta', 'Eta') AS department_name"
    )
    assert kpis.executive_kpis(tied).first().top_revenue_dept == "Eta"


def test_kpis_of_no_rows(admissions):
    row = kpis.api_kpis(admissions.where("false")).first()
    assert row.total_admissions == 0 and row.readmission_rate is None


def test_frequency_keeps_null(admissions):
    rows = kpis.frequency_table(admissions, "insurance_provider").collect()
    assert [(r.insurance_provider, r.total) for r in rows] == [("Alpha", 3), ("Beta", 3), (None, 1), ("Self-Pay", 1)]

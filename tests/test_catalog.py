"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from loadlens.plans.catalog import load_all
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ("overuse_alarm_evaluation", "baseline_evaluation", "error_by_dimension",
         "horizon_customer_meter_day", "customer_cvrmse_spread", "interpolate_missing", "outlier_jump",
         "clean_step_log", "ts_compose", "special_day_features", "tou_periods", "final_bill",
         "stacked_welfare", "pf_strategy_comparison", "monthly_weather_features", "national_weather",
         "typical_year_forecast", "weather_policy_tmy_bias", "btm_detect", "profile_load_distribution",
         "profile_data_quality", "profile_partial_month_stability", "ami_observed", "feature_matrix",
         "base_temperature_grid", "stream_sliding_hour", "publish_verified")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    q = load_all()[name]
    df = q.run(spark, SF)
    cur = con.execute(q.oracle())
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_every_query_reads_tables_and_names_its_columns():
    for q in load_all().values():
        assert q.columns and q.ids
        sql = q.oracle()
        assert sql is None or sql.startswith("WITH")


def test_flagship_plan_has_two_exchanges_below_the_result(spark):
    """Readings to days, days to customers, then the small result: no further shuffle."""
    df = load_all()["overuse_alarm_evaluation"].run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan

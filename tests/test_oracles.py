"""Registered queries against their SQL on the smallest tables, where those are there."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from footfall.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
#: A spread over the operators; the whole set runs in the driver's own comparison.
NAMES = [
    "attendance_normalized", "service_records_clean", "locations_normalized", "user_audit", "assigned_location_labels", "training_frame", "target_features",
    "target_weather_fallback", "backtest_metrics_scopes", "residual_buffer", "logs_deduped", "logs_with_actuals", "log_upsert", "monitoring_rollup", "retrain_plan",
    "stream_attendance", "stream_weather", "stream_logs", "stream_actuals", "features_imputed_prefix", "target_features_as_of", "target_verdicts", "weather_daily_local",
    "attendance_bucketed", "metrics_read_back", "run_ledger", "user_look_up", "expanding_quantile",
]


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "None"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = plans.queries()[name](spark, str(DATA)).toPandas()
    want = con.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_plain_query_has_sql():
    without = set(plans.queries()) - set(plans.oracle_sql())
    assert without == {"model_backtest", "model_metrics", "final_models", "next_forecasts"}

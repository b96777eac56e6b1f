"""Running quantiles, imputation without look-ahead and features as of any date, against brute force."""

from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.config import feature_names
from footfall.operators import features
from footfall.operators.prefix import running_quantiles, with_running_quantiles

FEATURES = feature_names(False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(float("nan")), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), max_size=40), st.sampled_from([0.0, 0.5, 0.8, 1.0, 0.37]))
def test_running_quantiles_equal_those_of_each_prefix(values, share):
    got = running_quantiles(np.array(values, float), share)
    for i, g in enumerate(got):
        before = [v for v in values[:i] if v == v]
        assert (np.isnan(g) and not before) or g == pytest.approx(np.quantile(before, share), rel=1e-9, abs=1e-9)


def test_a_long_history_takes_no_quadratic_time():
    rng = np.random.default_rng(0)
    values = rng.normal(size=300_000)
    got = running_quantiles(values, 0.8)
    assert all(got[i] == pytest.approx(np.quantile(values[:i], 0.8)) for i in (1, 2, 77, 12_345, 299_999))


def test_columns_nulls_and_groups_stay(spark):
    rows = [("a", 2, None, "x"), ("a", 1, 5, "y"), ("a", 3, 7, None), (None, 1, 1, "z"), (None, 2, 3, "z")]
    df = spark.createDataFrame(rows, "k string, t int, v int, extra string")
    got = {(r["k"], r["t"]): r for r in with_running_quantiles(df, ["k"], "t", {"q": ("v", 0.5)}).collect()}
    assert {k: r["q"] for k, r in got.items()} == {("a", 1): None, ("a", 2): 5.0, ("a", 3): 5.0, (None, 1): None, (None, 2): 1.0}
    assert got["a", 2]["v"] is None and got["a", 3]["extra"] is None
    assert with_running_quantiles(df.limit(0), ["k"], "t", {"q": ("v", 0.5)}).count() == 0


def history(spark, n=40, gap=None):
    first = date(2024, 1, 6)
    days = [first + timedelta(7 * (i // 2) + i % 2) for i in range(n)]
    return spark.createDataFrame([("a", d, 100 + 7 * i % 31) for i, d in enumerate(days) if d != gap], "location_id string, service_date date, visitors int"), days


def test_prefix_imputation_sees_nothing_later(spark):
    past, days = history(spark)
    weather = spark.createDataFrame([("a", d, float(i), 1.0, 2.0, 3.0, 0.0) for i, d in enumerate(days) if i % 3], "location_id string, date date, temp_10_13 double, apparent_temp_10_13 double, humidity_10_13 double, wind_10_13 double, precip_10_13 double")
    whole = features.training_frame(past, weather, "prefix")
    cut = features.training_frame(past.filter(f"service_date < '{days[20]}'"), weather, "prefix")
    names = ["service_date", *feature_names(True)]
    want = sorted(map(tuple, whole.filter(f"service_date < '{days[20]}'").select(names).collect()))
    assert want == sorted(map(tuple, cut.select(names).collect())) and len(want) == 17  # the first three rows have no third lag
    looks_ahead = features.training_frame(past.filter(f"service_date < '{days[20]}'"), weather)
    assert sorted(map(tuple, looks_ahead.select(names).collect())) != sorted(map(tuple, features.training_frame(past, weather).filter(f"service_date < '{days[20]}'").select(names).collect()))


def test_as_of_features_equal_those_of_the_history_cut_there(spark):
    past, days = history(spark, gap=date(2024, 2, 10))
    wanted = [days[0], days[3], date(2024, 2, 10), days[25], days[25], days[-1] + timedelta(6), date(2024, 3, 6)]
    targets = spark.createDataFrame([("a", d) for d in wanted] + [("new", days[3])], "location_id string, service_date date")
    names = [c for c in FEATURES]
    got = features.target_features_as_of(past, targets).select("location_id", "service_date", *names).collect()
    assert len(got) == len(wanted) + 1
    for r in got:
        before = past.filter(f"service_date < '{r['service_date']}'")
        alone = features.target_features(before.unionByName(spark.createDataFrame([(r["location_id"], date(1990, 1, 6), None)], past.schema)), spark.createDataFrame([(r["location_id"], r["service_date"])], targets.schema))
        want = alone.select("location_id", "service_date", *names).collect()
        if r["service_date"] > days[8] and r["location_id"] == "a":
            assert len(want) == 1 and all((x is None and y is None) or x == pytest.approx(y) for x, y in zip(r[2:], want[0][2:], strict=True))
    new = next(r for r in got if r["location_id"] == "new")
    assert new["lag1"] is None and new["rolling_mean_3"] is None and new["weekday_num"] == 6

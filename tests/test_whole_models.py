"""The registered model queries do the whole job: every fold, models of full size."""

import inspect
from datetime import date

import numpy as np

from footfall.operators import features, models
from footfall.plans import workloads


def test_backtest_queries_take_every_fold_and_full_models(spark, monkeypatch):
    rng = np.random.default_rng(1)
    first = date(2024, 1, 6).toordinal()
    rows = [("a", date.fromordinal(first + 7 * (i // 2) + i % 2), int(100 + rng.integers(0, 30))) for i in range(56)]
    frame = features.training_frame(spark.createDataFrame(rows, "location_id string, service_date date, visitors int")).cache()
    asked, real = [], models.backtest

    def small(*args, **kwargs):
        given = inspect.signature(real).bind(*args, **kwargs)
        given.apply_defaults()
        asked.append((given.arguments["n_trees"], given.arguments["rounds"]))
        return real(*args, **kwargs | {"n_trees": 2, "rounds": 2})

    monkeypatch.setattr(workloads, "training_frame", lambda spark, sf_dir: frame)
    monkeypatch.setattr(workloads, "FEATURES", [c for c in workloads.FEATURES if c in frame.columns])
    monkeypatch.setattr(workloads.models, "backtest", small)
    assert workloads.model_backtest(spark, "").count() == 2 * (28 - 18)
    assert '"BacktestRows":20' in workloads.model_metrics(spark, "").first()["metrics"]
    assert asked == [(400, 500)] * 2

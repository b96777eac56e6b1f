"""Models by location and segment: walk-forward backtests, final fits, scores of target dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall import schemas
from footfall.config import DEFAULT_MEAL_BUFFER, MIN_TRAIN_ROWS, QUANTILE
from footfall.functions.calendar import segment
from footfall.functions.values import suggested_meals
from footfall.operators import spread, trees
from footfall.operators.backtest import with_segment

#: Folds that one group fits; a group has all the rows up to its last fold.
BLOCK = 8
#: Fits that a block has at least, where folds share them: the boosted trees of all its fits grow together.
FITS = 4
#: What a fit raises that must stop no other.
FIT_ERRORS = (ValueError, FloatingPointError, ArithmeticError, IndexError, MemoryError)
#: Why a target gets no prediction.
NO_WEEKEND, NO_MODEL = "target_date must be Saturday or Sunday", "No trained model for segment: "


def backtest(frame: DataFrame, features: list[str], min_train_rows: int = MIN_TRAIN_ROWS, quantile: float = QUANTILE, n_trees: int = 400, rounds: int = 500, max_folds: int | None = None, refit_every: int = 1, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Walk-forward predictions: each row of a segment from ``min_train_rows`` on, by models of the rows before it.

    Folds are dealt out in blocks, and blocks over ``parts`` partitions by what they cost (fits times rows),
    so that neither a long segment nor many short ones make one long task. ``max_folds`` keeps only the last ones; with ``refit_every`` above 1 every
    fold is still predicted, by a model that is fitted anew at every so many of them. A block has whole runs of such folds, so results don't
    depend on it. A fold whose fit fails has no predictions and says why in error_message; it stops no other.
    """
    block = -(-max(block, FITS * refit_every) // refit_every) * refit_every
    parts = parts or spread.parts_for(frame.sparkSession)
    line = Window.partitionBy("location_id", "segment").orderBy("service_date")
    rows = with_segment(frame).withColumns({"__at": F.row_number().over(line) - 1, "__n": F.count(F.lit(1)).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    first = F.lit(min_train_rows) if max_folds is None else F.greatest(F.lit(min_train_rows), F.col("__n") - max_folds)
    rows = rows.filter(F.col("__n") > min_train_rows).withColumn("__first", first)
    # blocks of each segment, from its row numbered 0; the last one may be shorter
    last = F.floor((F.col("__n") - 1 - min_train_rows) / block).cast("int")
    blocks = rows.filter("__at = 0").select("location_id", "segment", "__n", F.explode(F.sequence(F.floor((F.col("__first") - min_train_rows) / block).cast("int"), last)).alias("__block"))
    end = F.least(F.col("__n"), min_train_rows + (F.col("__block") + 1) * block)
    blocks = blocks.withColumn("__end", end).withColumn("__cost", F.ceil((F.col("__end") - min_train_rows - F.col("__block") * block) / refit_every) * F.col("__end"))
    placed = spread.dealt(blocks.drop("__n"), ["location_id", "segment", "__block"], "__cost", parts)
    needed = ["location_id", "segment", "service_date", "visitors", "__at", "__first", *features]
    sent = rows.select(*dict.fromkeys(needed)).join(placed, ["location_id", "segment"]).filter(F.col("__at") < F.col("__end")).drop("__end", "__cost")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        location, own, number = key
        part = part.sort_values("__at")
        x, y = part[features].to_numpy(float), part["visitors"].to_numpy(float)
        first, out, point, upper, error = max(min_train_rows + int(number) * block, int(part["__first"].iloc[0])), [], None, None, None
        fitted = [i for i in range(first, len(part)) if i == first or (i - min_train_rows) % refit_every == 0]
        by_value, uppers = trees.sorted_rows(x), {}
        try:
            uppers = dict(zip(fitted, trees.fit_quantiles(trees.checked(x, y), y, fitted, quantile, rounds), strict=True))
        except FIT_ERRORS:
            pass  # some row of the block can't be learnt from: each fold finds out for itself
        for i in range(first, len(part)):
            if i in fitted:
                point = upper = error = None
                try:
                    trees.checked(x[:i], y[:i])
                    point = trees.fit_forest(x[:i], y[:i], trees.seed_of(location, own, i), n_trees, by_value=trees.of_first(by_value, i))
                    upper = uppers[i] if i in uppers else trees.fit_quantile(x[:i], y[:i], quantile, rounds)
                except FIT_ERRORS as e:
                    error = str(e) or type(e).__name__
            pred, pred_q = (None, None) if error else (float(trees.predict(point, x[i : i + 1], True)[0]), float(trees.predict(upper, x[i : i + 1], False)[0]))
            out.append((location, own, part["service_date"].iloc[i], i, i, y[i], pred, pred_q, None if error else abs(y[i] - pred), int(own == "sun"), error))
        return pd.DataFrame(out, columns=["location_id", "segment", "service_date", "fold", "train_rows", "actual", "pred", "pred_q", "abs_error", "is_sun", "error_message"])

    return spread.apply_groups(sent, ["location_id", "segment", "__block"], fit, schemas.BACKTEST, parts)


def fit_final(frame: DataFrame, features: list[str], quantile: float = QUANTILE, n_trees: int = 400, rounds: int = 500, parts: int | None = None) -> DataFrame:
    """A model pack for each location and segment that has rows, dealt over ``parts`` partitions by their rows.

    A fit that fails says so in its row's status and error_message and stops no other.
    """

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        point = upper = error = None
        try:
            part = part.sort_values("service_date")
            x, y = part[features].to_numpy(float), part["visitors"].to_numpy(float)
            point = trees.to_bytes(trees.fit_forest(trees.checked(x, y), y, trees.seed_of(*key, "final"), n_trees))
            upper = trees.to_bytes(trees.fit_quantile(x, y, quantile, rounds))
        except FIT_ERRORS as e:
            point, upper, error = None, None, str(e) or type(e).__name__
        return pd.DataFrame([(*key, features, point, upper, "failed" if error else "success", error)], columns=["location_id", "segment", "feature_cols", "point_model", "quantile_model", "status", "error_message"])

    parts = parts or spread.parts_for(frame.sparkSession)
    rows = with_segment(frame).select("location_id", "segment", "service_date", "visitors", *features)
    sizes = rows.groupBy("location_id", "segment").agg(F.count(F.lit(1)).alias("__cost"))
    placed = spread.dealt(sizes, ["location_id", "segment"], "__cost", parts).drop("__cost")
    return spread.apply_groups(rows.join(placed, ["location_id", "segment"]), ["location_id", "segment"], fit, schemas.MODEL_PACK, parts)


def judged(targets: DataFrame, packs: DataFrame, strict: bool = False, observation: Observation | None = None) -> DataFrame:
    """Targets with segment and reason: null where a model can predict them, else why none does.

    Days that are no weekend have no segment; a segment may have no model. ``strict`` raises the first
    reason instead. ``observation`` takes the numbers of rows accepted and rejected, in the same pass as whatever reads the result.
    """
    have = packs.filter(F.col("point_model").isNotNull()).select("location_id", "segment").distinct().withColumn("__model", F.lit(True))
    named = targets.withColumn("segment", segment(F.col("service_date"))).join(have, ["location_id", "segment"], "left")
    reason = F.when(F.col("segment").isNull(), F.lit(NO_WEEKEND)).when(F.col("__model").isNull(), F.concat(F.lit(NO_MODEL), "segment"))
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))
    out = named.withColumn("reason", reason).drop("__model")
    if observation is not None:
        out = out.observe(observation, F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected"))
    return out


SCORED = "location_id string, service_date date, predicted_visitors double, predicted_quantile double, model_segment string, reason string"


def score(targets: DataFrame, packs: DataFrame, features: list[str], strict: bool = False, observation: Observation | None = None, parts: int | None = None) -> DataFrame:
    """Predictions for target rows with their features; rows that no model predicts stay, with their ``reason`` (see ``judged``).

    The targets move to the models; each model is decoded once. Groups go to ``parts`` partitions whatever their bytes.
    """
    keys = ["location_id", "segment"]
    parts = parts or spread.parts_for(targets.sparkSession)
    wanted = judged(targets, packs, strict, observation).select(*keys, "service_date", "reason", *features)
    models = packs.filter(F.col("point_model").isNotNull()).select(*keys, "point_model", "quantile_model")

    def apply(key: tuple, rows: pd.DataFrame, pack: pd.DataFrame) -> pd.DataFrame:
        point = upper = None
        if len(rows) and len(pack):
            x, blob = rows[features].to_numpy(float), pack["quantile_model"].iloc[0]
            point = trees.predict(trees.from_bytes(pack["point_model"].iloc[0]), x, True)
            upper = trees.predict(trees.from_bytes(blob), x, False) if blob is not None else point
        return pd.DataFrame({"location_id": rows["location_id"], "service_date": rows["service_date"], "predicted_visitors": point, "predicted_quantile": upper, "model_segment": rows["segment"], "reason": rows["reason"]})

    left = wanted.repartition(parts, *keys).groupBy(*keys)
    return left.cogroup(models.repartition(parts, *keys).groupBy(*keys)).applyInPandas(apply, SCORED)


def accepted(scored: DataFrame) -> DataFrame:
    """The rows that have a prediction."""
    return scored.filter(F.col("reason").isNull()).drop("reason")


def rejected(scored: DataFrame) -> DataFrame:
    """location_id, service_date and reason of the rows that have none."""
    return scored.filter(F.col("reason").isNotNull()).select("location_id", "service_date", "reason")


def recommend(predictions: DataFrame, buffers: DataFrame, meal_buffer: float = DEFAULT_MEAL_BUFFER) -> DataFrame:
    """Add residual_buffer (0 if there is none), meal_buffer_pct and suggested_meals."""
    own = buffers.select("location_id", F.col("segment").alias("model_segment"), "residual_buffer")
    out = predictions.join(own, ["location_id", "model_segment"], "left").withColumns({"residual_buffer": F.coalesce("residual_buffer", F.lit(0.0)), "meal_buffer_pct": F.lit(meal_buffer)})
    return out.withColumn("suggested_meals", suggested_meals(F.col("predicted_visitors"), F.col("predicted_quantile"), F.col("residual_buffer"), F.col("meal_buffer_pct")))

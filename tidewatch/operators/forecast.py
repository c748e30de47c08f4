"""Short dissolved-oxygen forecast from each unit's last readings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.rounding import exact, is_finite, mean_hundredths
from tidewatch.functions.thresholds import status
from tidewatch.operators.recent import last_rows, since
from tidewatch.schemas import MEASURES


class Profile(NamedTuple):
    offsets: tuple[int, int, int]  # hundredths added for +2 h, +4 h and +6 h
    confidence: float


# Fixed values of the forecast.
WINDOW_HOURS = 24
WINDOW_ROWS = 6
EMPTY_WINDOW = 550  # hundredths
MISSING_VALUE = 5.0
DECLINING_CAP = 380  # hundredths
STEADY = Profile(offsets=(10, 5, -5), confidence=0.92)
DECLINING = Profile(offsets=(-30, -70, -110), confidence=0.87)
DECLINING_IDS = (3,)

HORIZONS = ("do_2h", "do_4h", "do_6h")
FORECAST_FIELDS = ("do_now", *HORIZONS, "confidence")

# Takes a row per unit (its id and, per feature, its values oldest first) and gives a row of FORECAST_FIELDS for each.
Model = Callable[[pd.DataFrame], pd.DataFrame]


def forecast_features(readings: DataFrame, as_of: datetime | str) -> DataFrame:
    """Readings of the last 24 h as a model sees them."""
    return since(readings, as_of, WINDOW_HOURS).select("unit_id", "timestamp", *MEASURES)


def _is_declining(declining: Column | Iterable[int]) -> Column:
    if isinstance(declining, Column):
        return declining
    ids = list(declining)
    return F.col("id").isin(*ids) if ids else F.lit(False)


def recent_oxygen(readings: DataFrame, as_of: datetime | str) -> DataFrame:
    """Up to six newest oxygen values per unit within the last 24 h."""
    window = since(readings, as_of, WINDOW_HOURS).select("unit_id", "timestamp", "id", "do_predicted")
    return last_rows(window, WINDOW_ROWS)


def _window_means(recent: DataFrame) -> DataFrame:
    """Mean oxygen per unit in hundredths, rounded half-up; NaN or infinite where a value is."""
    oxygen = recent.selectExpr("unit_id", f"coalesce(do_predicted, {MISSING_VALUE}D) AS oxygen")
    finite = is_finite("oxygen")
    sums = oxygen.groupBy("unit_id").agg(
        F.expr(f"sum(CASE WHEN {finite} THEN {exact('oxygen')} END) AS total"),
        F.expr("count(*) AS n"),
        F.expr(f"sum(CASE WHEN NOT {finite} THEN oxygen * double('Infinity') END) AS odd"),
    )
    return sums.selectExpr("unit_id AS id", f"coalesce(odd, CAST({mean_hundredths('total', 'n')} AS DOUBLE)) AS _mean")


def forecast_from(units: DataFrame, recent: DataFrame, declining: Column | Iterable[int] = DECLINING_IDS) -> DataFrame:
    """Forecast of every unit from its recent oxygen values; a unit without any gets the default.

    Counted in whole hundredths up to the last step, so all four values carry
    the rounding of the mean. A NaN mean stays NaN.
    """
    joined = units.join(_window_means(recent), "id", "left").withColumn("_falling", _is_declining(declining))
    based = joined.selectExpr("id", "name", "_falling", f"coalesce(_mean, {EMPTY_WINDOW}D) AS _mean").selectExpr(
        "id",
        "name",
        "_falling",
        f"CASE WHEN _falling AND _mean > {DECLINING_CAP} AND NOT isnan(_mean)"
        f" THEN {DECLINING_CAP}D ELSE _mean END AS _now",
    )
    later = [
        f"(_now + if(_falling, {falling}, {steady})) / 100D AS {horizon}"
        for horizon, falling, steady in zip(HORIZONS, DECLINING.offsets, STEADY.offsets)
    ]
    return based.selectExpr(
        "id AS unit_id",
        "name AS unit_name",
        "_now / 100D AS do_now",
        *later,
        f"if(_falling, {DECLINING.confidence}D, {STEADY.confidence}D) AS confidence",
    )


def forecast_do(
    units: DataFrame,
    readings: DataFrame,
    as_of: datetime | str,
    declining: Column | Iterable[int] = DECLINING_IDS,
    model: Model | None = None,
    model_rows: int | None = None,
) -> DataFrame:
    """One forecast per unit, from the built-in rule or from ``model``.

    ``declining`` names the units with a falling profile: ids, or a condition on
    the columns of ``units``.
    """
    if model is None:
        return forecast_from(units, recent_oxygen(readings, as_of), declining)
    if not model_rows:
        raise ValueError("state model_rows, the number of newest readings the model reads")
    return _forecast_with(units, readings, as_of, model, model_rows)


def _forecast_with(units: DataFrame, readings: DataFrame, as_of: datetime | str, model: Model, rows: int) -> DataFrame:
    """Runs a model on the ``rows`` newest readings of each unit in the last 24 h, many units a call.

    A unit's readings are packed into one row of arrays, oldest first and no longer than
    the model's own input, so that a call costs per Arrow batch and not per unit, and a
    unit with a large share of the readings is no larger than any other. A unit without
    readings reaches the model with empty arrays.
    """
    features = ["timestamp", *MEASURES]
    window = since(readings, as_of, WINDOW_HOURS).select("unit_id", "id", *features)
    entry = F.struct("timestamp", "id", *MEASURES)
    packed = last_rows(window, rows).groupBy("unit_id").agg(F.sort_array(F.collect_list(entry)).alias("window"))
    named = units.selectExpr("id AS unit_id", "name AS unit_name").join(packed, "unit_id", "left")
    inputs = named.selectExpr("unit_id", "unit_name", *[f"coalesce(window.{f}, array()) AS {f}" for f in features])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answer = model(batch.drop(columns="unit_name"))
            values = {field: np.asarray(answer[field], np.float64) for field in FORECAST_FIELDS}
            yield pd.DataFrame({"unit_id": batch["unit_id"], "unit_name": batch["unit_name"], **values})

    schema = "unit_id int, unit_name string, " + ", ".join(f"{field} double" for field in FORECAST_FIELDS)
    return inputs.mapInPandas(run, schema)


def forecast_status(forecast: DataFrame) -> DataFrame:
    """The band of each forecast's current value."""
    return forecast.selectExpr("unit_id", "unit_name", "do_now", f"{status('do_predicted', 'do_now')} AS do_status")

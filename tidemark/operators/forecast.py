"""Validated forecasts: ARIMA orders chosen by AIC on training rows, scored against a random walk, then projected."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tidemark.config import DEFAULT, Settings
from tidemark.functions.stats import by_day, ratio
from tidemark.operators import arima
from tidemark.operators.returns import densified


@dataclass(frozen=True)
class Forecaster:
    """A model of daily log returns, replaceable as a whole; its functions run in tasks.

    fit(returns, p, q) gives (parameters, variance, AIC) or raises ValueError;
    one_step(returns, parameters) predicts each return from those before it;
    project(returns, parameters, variance, horizon) gives means and variances of the summed
    returns ahead.  `orders` are the candidates (p, q); the earlier one wins ties.
    """

    fit: Callable[[np.ndarray, int, int], tuple]
    one_step: Callable[[np.ndarray, tuple], np.ndarray]
    project: Callable[[np.ndarray, tuple, float, int], tuple[np.ndarray, np.ndarray]]
    orders: tuple[tuple[int, int], ...]
    name: str = "ARIMA"


def _fit(y: np.ndarray, p: int, q: int) -> tuple:
    phi, theta, variance, aic = arima.fit(y, p, q)
    return (phi, theta), variance, aic


ARIMA = Forecaster(_fit, lambda y, parameters: arima.one_step(y, *parameters), lambda y, parameters, variance, horizon: arima.project(y, *parameters, variance, horizon), tuple((p, q) for p in range(3) for q in range(3)))

_Z = {0.20: 1.2815515655446004, 0.10: 1.6448536269514722, 0.05: 1.959963984540054}


def prepared(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, day, price, log_price, before, k, n, n_test, is_test) on calendar days; `before` is the log price a day earlier."""
    full, w = Window.partitionBy("symbol"), by_day("symbol")
    rows = densified(bars).where("price > 0").withColumn("log_price", F.ln("price"))
    rows = rows.withColumn("before", F.lag("log_price").over(w)).withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(full))
    rows = rows.withColumn("n_test", F.greatest(F.lit(s.min_test), F.floor(F.col("n") * F.lit(s.test_share)).cast("int")))
    return rows.withColumn("is_test", F.col("k") > F.col("n") - F.col("n_test"))


def errors(actual: str, predicted: str, prefix: str = "") -> list[Column]:
    """RMSE, MAE and MAPE in percent."""
    e = F.col(actual) - F.col(predicted)
    return [F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"), F.avg(F.abs(e)).alias(f"{prefix}mae"), (100 * F.avg(F.abs(ratio(e, F.col(actual))))).alias(f"{prefix}mape")]


def skill(rmse: Column, naive: Column) -> Column:
    """1 - rmse / naive; NULL where the baseline has no error."""
    return 1 - ratio(rmse, F.when(naive > 0, naive))


def verdict(value: Column, p: Column, q: Column, name: str = "ARIMA") -> Column:
    """The order, and its error in percent of the random walk's; `close` marks a gain of 5% or less."""
    model, error = F.format_string(f"{name}(%d,1,%d)", p, q), F.format_string("%.1f%%", 100 * (1 - value))
    kind = F.when(value > 0.05, "").when(value > 0, " (close)").otherwise(" (no gain)")
    return F.when(value.isNull(), "unscored").otherwise(F.concat(model, F.lit(": error "), error, F.lit(" of naive"), kind))


def naive_backtest(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The random walk alone: (symbol, n_test, naive_rmse, naive_mae, naive_mape)."""
    rows = prepared(bars, s).where("is_test and before is not null").withColumn("naive", F.exp("before"))
    return rows.groupBy("symbol").agg(F.count("*").alias("n_test"), *errors("price", "naive", "naive_"))


def random_walk_forecast(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, day, step, point, lower, upper) under order (0, 1, 0), whose variance grows by the step."""
    rows = prepared(bars, s)
    last = rows.groupBy("symbol").agg(F.max("day").alias("end"), F.max_by("log_price", "day").alias("level"), F.avg(F.pow(F.col("log_price") - F.col("before"), F.lit(2))).alias("variance"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(s.horizon))))
    half = F.lit(_Z[s.alpha]) * F.sqrt(F.col("variance") * F.col("step"))
    return steps.select("symbol", F.date_add("end", F.col("step")).alias("day"), "step", F.exp("level").alias("point"), F.exp(F.col("level") - half).alias("lower"), F.exp(F.col("level") + half).alias("upper"))


def series(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, days, logs, n_test): each symbol's calendar days and log prices in order, the last `n_test` of them for testing."""
    rows = densified(bars).where("price > 0").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", F.ln("price").alias("log")))).alias("rows"))
    n_test = F.greatest(F.lit(s.min_test), F.floor(F.size("rows") * F.lit(s.test_share)).cast("int"))
    return rows.select("symbol", F.col("rows.day").alias("days"), F.col("rows.log").alias("logs"), n_test.alias("n_test"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """(the row without its arrays, its log prices)."""
    for batch in batches:
        logs, small = batch["logs"], batch.select([c for c in batch.schema.names if c not in ("days", "logs")])
        values, at = logs.values.to_numpy(), logs.offsets.to_numpy()
        for i, row in enumerate(small.to_pylist()):
            yield row | ({"days": batch["days"][i].values} if "days" in batch.schema.names else {}), values[at[i] : at[i + 1]]


def selected(bars: DataFrame, s: Settings = DEFAULT, model: Forecaster = ARIMA) -> DataFrame:
    """`series` with p, q and fit: the order of least AIC on the training rows with its parameters, (1, 1) and NULL where none could be fitted.

    A task fits one order to one series; the series goes along, so that the bars are read once.
    """
    orders = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("idx", "p", "q"), (i, *order)))) for i, order in enumerate(model.orders)))
    rows = series(bars, s)
    tasks = max(len(model.orders), 2 * rows.sparkSession.sparkContext.defaultParallelism)  # fitting is the work, however few the rows
    fan = rows.select("*", F.inline(orders)).repartition(tasks, "symbol", "idx")
    fitted = StructType([*fan.schema.fields, StructField("aic", DoubleType()), StructField("fit", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aics, fits = [], []
            for row, logs in _rows([batch]):
                aic, fit = None, None
                try:
                    parameters, _, found = model.fit(np.diff(logs[: max(0, len(logs) - row["n_test"])]), row["p"], row["q"])
                    if np.isfinite(found):
                        aic, fit = float(found), pickle.dumps(parameters)
                except (ValueError, np.linalg.LinAlgError):
                    pass
                aics.append(aic)
                fits.append(fit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(aics, pa.float64()), pa.array(fits, pa.binary())], [*batch.schema.names, "aic", "fit"])

    best = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", "idx", "p", "q", "fit"))).alias("best")
    found = fan.mapInArrow(run, fitted).groupBy("symbol").agg(best, *(F.any_value(c).alias(c) for c in ("days", "logs", "n_test")))
    order = [F.coalesce(F.col(f"best.{c}"), F.lit(1)).alias(c) for c in ("p", "q")]
    return found.select("symbol", "days", "logs", "n_test", *order, F.col("best.fit").alias("fit"))


_WALK = pa.schema([("symbol", pa.string()), ("p", pa.int32()), ("q", pa.int32()), ("day", pa.date32()), ("actual", pa.float64()), ("predicted", pa.float64()), ("naive", pa.float64())])


def backtest(bars: DataFrame, s: Settings = DEFAULT, model: Forecaster = ARIMA) -> DataFrame:
    """(symbol, p, q, day, actual, predicted, naive) over the test rows, parameters as fitted on the training rows.

    Where the model cannot be fitted the prediction is the value before, as in the baseline.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, logs in _rows(batches):
            y = np.diff(logs)
            step = model.one_step(y, pickle.loads(row["fit"])) if row["fit"] is not None else np.zeros(len(y))
            low = max(1, len(logs) - row["n_test"])  # the first row has none before it
            n = len(logs) - low
            if n > 0:
                before = logs[low - 1 : -1]
                columns = [[row[c]] * n for c in ("symbol", "p", "q")] + [row["days"][low:], np.exp(logs[low:]), np.exp(before + step[low - 1 :]), np.exp(before)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WALK)], schema=_WALK)

    return selected(bars, s, model).mapInArrow(run, "symbol string, p int, q int, day date, actual double, predicted double, naive double")


def forecast(bars: DataFrame, s: Settings = DEFAULT, model: Forecaster = ARIMA) -> DataFrame:
    """The header: symbol, order, errors of model and baseline, skill, verdict."""
    scored = backtest(bars, s, model).groupBy("symbol").agg(F.first("p").alias("p"), F.lit(1).alias("d"), F.first("q").alias("q"), *errors("actual", "predicted"), *errors("actual", "naive", "naive_"))
    symbols = bars.select("symbol").distinct()
    out = symbols.join(scored, "symbol", "left").withColumn("skill", skill(F.col("rmse"), F.col("naive_rmse")))
    return out.withColumn("beats_naive", F.coalesce(F.col("skill") > 0, F.lit(False))).withColumn("verdict", verdict(F.col("skill"), F.col("p"), F.col("q"), model.name))


def forecast_path(bars: DataFrame, s: Settings = DEFAULT, model: Forecaster = ARIMA) -> DataFrame:
    """(symbol, day, point, lower, upper) from a fit of the whole history with the selected order."""
    z = _Z[s.alpha]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, logs in _rows(batches):
            y = np.diff(logs)
            try:
                parameters, variance, _ = model.fit(y, row["p"], row["q"])
                mean, var = model.project(y, parameters, variance, s.horizon)
            except (ValueError, np.linalg.LinAlgError):  # the random walk
                mean, var = np.zeros(s.horizon), (float(np.mean(y * y)) if len(y) else 0.0) * np.arange(1, s.horizon + 1)
            last = row["days"][-1].as_py()
            days, level, half = [last + timedelta(days=i + 1) for i in range(s.horizon)], logs[-1] + mean, z * np.sqrt(var)
            yield pa.RecordBatch.from_arrays([pa.array([row["symbol"]] * s.horizon), pa.array(days), *(pa.array(np.exp(x)) for x in (level, level - half, level + half))], ["symbol", "day", "point", "lower", "upper"])

    return selected(bars, s, model).mapInArrow(run, "symbol string, day date, point double, lower double, upper double")


def forecast_fan(bars: DataFrame, s: Settings = DEFAULT, model: Forecaster = ARIMA) -> DataFrame:
    """(symbol, day, kind, value, lower, upper): the last `lookback` rows of each symbol (history) and the path ahead with its bounds (forecast)."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    none = F.lit(None).cast("double")
    history = bars.select("symbol", "day", "price").withColumn("k", k).where(F.col("k") <= s.lookback)
    history = history.select("symbol", "day", F.lit("history").alias("kind"), F.col("price").alias("value"), none.alias("lower"), none.alias("upper"))
    ahead = forecast_path(bars, s, model).select("symbol", "day", F.lit("forecast").alias("kind"), F.col("point").alias("value"), "lower", "upper")
    return history.unionByName(ahead)

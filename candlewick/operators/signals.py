"""User-defined signals.

A signal is best written as column expressions (:class:`ColumnSignal`): it then
runs inside the panel's windows.  A pandas function of one code's bars is the
fallback; its group is one code, bounded by the number of dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["ts_code", "trade_date"]
SCHEMA = "ts_code string, trade_date date, signal double"


class ColumnSignal(Protocol):
    """Positive is bullish, negative bearish, null none."""

    space: dict[str, tuple[float, float]]

    def column(self, params: dict[str, float]) -> Column: ...


def middle_params(space: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Default parameters: the middle of each range."""
    return {name: (low + high) / 2 for name, (low, high) in space.items()}


def column_signal(panel: DataFrame, signal: ColumnSignal, params: dict[str, float] | None = None) -> DataFrame:
    value = signal.column(params or middle_params(signal.space)).cast("double")
    return panel.select(*KEYS, F.when(~F.isnan(value), value).alias("signal"))


def grouped_signal(panel: DataFrame, fn: Callable[[pd.DataFrame, dict], pd.Series], params: dict | None = None) -> DataFrame:
    """``fn(bars of one code in order, params) -> series of the same length``."""
    params = dict(params or {})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bars = pdf.sort_values("trade_date").reset_index(drop=True)
        values = pd.to_numeric(pd.Series(fn(bars, params)), errors="coerce")
        if len(values) != len(bars):
            raise ValueError("a signal must have one value per bar")
        return pd.DataFrame({"ts_code": bars["ts_code"], "trade_date": bars["trade_date"], "signal": values.to_numpy(dtype="float64")})

    return panel.groupBy("ts_code").applyInPandas(one, SCHEMA)


class RunningScore(Protocol):
    """A score of all bars of a code up to each date, worked forward bar by bar.

    ``start()`` is the state before the first bar; ``step(state, bar)`` takes the values
    of ``columns`` at the next bar and returns the state after it and the score
    there, or None for no score.
    """

    columns: list[str]

    def start(self) -> Any: ...

    def step(self, state: Any, bar: tuple) -> tuple[Any, float | None]: ...


def running_score(panel: DataFrame, score: RunningScore, min_rows: int = 60) -> DataFrame:
    """The score at every bar that has ``min_rows`` bars up to it, null before.

    One step per bar, so linear in the bars.  Codes are dealt to tasks by hash and
    stream through in order; a task holds the state of one code and one batch of
    bars, never a whole series.  Where a step fails for the bar's values
    (arithmetic, value or type error) there is no score and the state stays.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, state, seen = None, None, 0
        for bars in batches:
            out = []
            for this, *bar in bars[["ts_code", *score.columns]].itertuples(index=False, name=None):
                if this != code:
                    code, state, seen = this, score.start(), 0
                seen += 1
                try:
                    state, value = score.step(state, tuple(bar))
                except (ArithmeticError, ValueError, TypeError):
                    value = None
                out.append(value if seen >= min_rows else None)
            yield pd.DataFrame({"ts_code": bars["ts_code"], "trade_date": bars["trade_date"], "signal": pd.Series(out, dtype="float64")})

    ordered = panel.select(*KEYS, *[c for c in score.columns if c not in KEYS]).repartition("ts_code").sortWithinPartitions(*KEYS)
    return ordered.mapInPandas(fold, SCHEMA)


def growing_window_signal(panel: DataFrame, fn: Callable[[pd.DataFrame], float], min_rows: int = 60) -> DataFrame:
    """A score of the bars up to each date by a function of all of them.  Quadratic in
    the bars of a code: only for functions that cannot be worked forward
    (:func:`running_score`)."""

    def every(bars: pd.DataFrame, _: dict) -> pd.Series:
        return pd.Series([fn(bars.iloc[:i + 1]) if i + 1 >= min_rows else None for i in range(len(bars))], dtype="float64")

    return grouped_signal(panel, every)

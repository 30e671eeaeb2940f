"""Per-code state carried between micro-batches.

State is a few numbers per code.  The rows of a code in one micro-batch are bars
(already aggregated), so a group holds at most the bars of that batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state API needs this store; it is a session setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _new_bars(rows: Iterator[pd.DataFrame], last_day) -> pd.DataFrame:
    """Bars of the batch in order; one that is not newer than the state has been
    worked in already, or comes too late, and is left out."""
    bars = pd.concat(list(rows)).sort_values("trade_date").drop_duplicates("trade_date", keep="last")
    return bars if last_day is None else bars[bars["trade_date"] > last_day]


def _smoothed(x: pd.Series, last: float | None, **weight) -> pd.Series:
    """An exponential recursion that goes on from the stored value, or begins with the first one."""
    if last is None:
        return x.ewm(adjust=False, **weight).mean()
    return pd.concat([pd.Series([last]), x]).ewm(adjust=False, **weight).mean().iloc[1:].reset_index(drop=True)


class LineBreak(StatefulProcessor):
    """Day one under the slow line: observe.  Day two: sell."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date, close double, observing boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, close, observing = self.last.get() if self.last.exists() else (None, None, False)
        bars = _new_bars(rows, day)
        if bars.empty:
            return
        before = bars["close"].shift(fill_value=np.nan if close is None else close)
        under = bars["close"] < bars["trend_slow"]
        observe = under & (before >= bars["trend_slow"])
        broke = under & (before < bars["trend_slow"]) & observe.shift(fill_value=bool(observing))
        self.last.update((bars["trade_date"].iloc[-1], float(bars["close"].iloc[-1]), bool(observe.iloc[-1])))
        yield pd.DataFrame({"ts_code": key[0], "trade_date": bars["trade_date"], "observing": observe, "break_slow": broke})

    def close(self) -> None:
        pass


class RunningIndicators(StatefulProcessor):
    """EMA12, EMA26, the trend line and OBV, going on from the last bar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date, ema12 double, ema26 double, ema10 double, trend double, obv double, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        bars = _new_bars(rows, None if state is None else state[0])
        if bars.empty:
            return
        close, vol = bars["close"].reset_index(drop=True), bars["vol"].reset_index(drop=True)

        _, e12, e26, e10, trend, obv, before = state or (None,) * 7
        ema12, ema26, ema10 = _smoothed(close, e12, span=12), _smoothed(close, e26, span=26), _smoothed(close, e10, span=10)
        fast = _smoothed(ema10, trend, span=10)
        move = np.sign(close - close.shift(fill_value=np.nan if before is None else before)) * vol
        if before is None:
            move.iloc[0] = vol.iloc[0]
        volume = move.cumsum() + (obv or 0.0)
        day = bars["trade_date"].reset_index(drop=True)
        self.last.update((day.iloc[-1], *[float(x.iloc[-1]) for x in (ema12, ema26, ema10, fast, volume, close)]))
        yield pd.DataFrame({"ts_code": key[0], "trade_date": day, "ema12": ema12, "ema26": ema26, "trend_fast": fast, "obv": volume})

    def close(self) -> None:
        pass


class RunningKdj(StatefulProcessor):
    """K, D and J, going on from the last bar.

    Besides the last K and D the state is a list of the last ``n`` - 1 highs and
    lows, on which the windows of later bars look back.
    """

    def __init__(self, n: int = 9, m: int = 3):
        self.n, self.m = n, m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date, k double, d double")
        self.window = handle.getListState("window", "high double, low double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, last_k, last_d = self.last.get() if self.last.exists() else (None, None, None)
        bars = _new_bars(rows, day).reset_index(drop=True)
        if bars.empty:
            return
        before = list(self.window.get()) if self.window.exists() else []
        seen = pd.concat([pd.DataFrame(before, columns=["high", "low"], dtype="float64"), bars[["high", "low"]]], ignore_index=True)
        window = seen.rolling(self.n, min_periods=1)
        high, low = (x.iloc[len(before):].reset_index(drop=True) for x in (window["high"].max(), window["low"].min()))
        width = (high - low).where(high != low)
        rsv = ((bars["close"] - low) * 100 / width).fillna(50.0)
        k = _smoothed(rsv, last_k, alpha=1 / self.m)
        d = _smoothed(k, last_d, alpha=1 / self.m)
        self.last.update((bars["trade_date"].iloc[-1], float(k.iloc[-1]), float(d.iloc[-1])))
        if self.n > 1:
            self.window.put([(float(h), float(x)) for h, x in seen.tail(self.n - 1).itertuples(index=False)])
        yield pd.DataFrame({"ts_code": key[0], "trade_date": bars["trade_date"], "k": k, "d": d, "j": 3 * k - 2 * d})

    def close(self) -> None:
        pass


def line_break_stream(bars: DataFrame) -> DataFrame:
    """``bars``: (ts_code, trade_date, close, trend_slow) as a stream."""
    return bars.groupBy("ts_code").transformWithStateInPandas(
        LineBreak(), "ts_code string, trade_date date, observing boolean, break_slow boolean", "Append", "none")


def running_indicators(bars: DataFrame) -> DataFrame:
    """``bars``: (ts_code, trade_date, close, vol) as a stream."""
    return bars.groupBy("ts_code").transformWithStateInPandas(
        RunningIndicators(), "ts_code string, trade_date date, ema12 double, ema26 double, trend_fast double, obv double", "Append", "none")


def running_kdj(bars: DataFrame, n: int = 9, m: int = 3) -> DataFrame:
    """``bars``: (ts_code, trade_date, high, low, close) as a stream."""
    return bars.groupBy("ts_code").transformWithStateInPandas(
        RunningKdj(n, m), "ts_code string, trade_date date, k double, d double, j double", "Append", "none")

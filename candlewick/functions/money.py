"""Trading costs, position sizes and stops as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from candlewick.functions.series import col, ratio

# Rates of the cost model.
COMMISSION, MIN_COMMISSION = 0.00025, 5.0
STAMP_DUTY, TRANSFER_FEE, SLIPPAGE = 0.0005, 0.00001, 0.0005
SELL_COST = STAMP_DUTY + COMMISSION + TRANSFER_FEE + SLIPPAGE
FIXED_STOP = 0.03


def buy_cost(price, shares) -> tuple[Column, Column]:
    """(commission, cost basis), rounded to cents."""
    amount = col(price) * col(shares)
    fee = F.greatest(amount * COMMISSION, F.lit(MIN_COMMISSION))
    return F.round(fee, 2), F.round(amount + fee, 2)


def sell_result(buy_price, sell_price, shares) -> dict[str, Column]:
    """cost_basis, gross_proceeds, net_proceeds, profit_loss, profit_pct."""
    basis = col(buy_price) * col(shares) * (1 + COMMISSION)
    gross = col(sell_price) * col(shares)
    net = gross * (1 - SELL_COST)
    return {"cost_basis": F.round(basis, 2), "gross_proceeds": F.round(gross, 2), "net_proceeds": F.round(net, 2),
            "profit_loss": F.round(net - basis, 2), "profit_pct": F.round(ratio((net - basis) * 100, basis, 0), 4)}


def whole_lots(shares) -> Column:
    return F.floor(col(shares) / 100) * 100


def half_lots(shares) -> Column:
    """Half a position in whole lots, at least one lot."""
    return F.greatest(F.lit(100), F.floor(F.floor(col(shares) / 2) / 100) * 100)


def affordable_shares(cash, price, share: float = 0.95) -> Column:
    """Whole lots bought with a share of the cash, at least one; 0 without a price."""
    return F.when(col(price) > 0, F.greatest(whole_lots(ratio(col(cash) * share, price)), F.lit(100))).otherwise(F.lit(0))


def stop_pct(atr, price, times: float = 2.0, low: float = 1.5, high: float = 8.0, fallback: float = 3.0) -> Column:
    """Stop distance in percent: ATR based, kept in [low, high]; ``fallback`` without ATR."""
    raw = ratio(col(atr) * times * 100, price)
    ok = (col(atr) > 0) & (col(price) > 0)
    return F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), raw))).otherwise(F.lit(fallback))


def stop_price(atr, price, **kw) -> Column:
    return col(price) * (1 - stop_pct(atr, price, **kw) / 100)


def stop_hit(low, atr, buy_price, fixed_pct=None) -> Column:
    """Whether the day's low fell under the stop; without ATR under the
    position's own percentage (a fraction), 3 % by default."""
    fixed = F.lit(FIXED_STOP) if fixed_pct is None else F.when(col(fixed_pct) > 0, col(fixed_pct)).otherwise(FIXED_STOP)
    stop = F.when(col(atr) > 0, stop_price(atr, buy_price)).otherwise(col(buy_price) * (1 - fixed))
    return F.coalesce((col(low) > 0) & (col(buy_price) > 0) & (col(low) < stop), F.lit(False))


def expectancy(win_rate, avg_win, avg_loss) -> Column:
    w, a, b = col(win_rate), col(avg_win), col(avg_loss)
    return F.when((w <= 0) | (b <= 0), 0.0).otherwise(w * a - (1 - w) * b)


def kelly_share(win_rate, avg_win, avg_loss, fraction: float = 0.5, cap: float = 0.25) -> Column:
    """Fraction of capital: half Kelly up to ``cap``; 0 without an edge."""
    w, a, b = col(win_rate), col(avg_win), col(avg_loss)
    odds = ratio(a, b)
    full = ratio(w * odds - (1 - w), odds)
    edge = (b > 0) & (w > 0) & (w < 1) & (expectancy(w, a, b) > 0) & (full > 0)
    return F.when(edge, F.least(full * fraction, F.lit(cap))).otherwise(0.0)


# Change of a buy threshold by market state, and the extra by style.
STATE_SHIFT = {"bull": -1.0, "range": 0.0, "bear": 2.0}
STYLE_SHIFT = {"conservative": {"bull": 0.0, "range": 0.5, "bear": 1.0},
               "normal": {"bull": 0.0, "range": 0.0, "bear": 0.0},
               "aggressive": {"bull": -0.5, "range": 0.0, "bear": -0.5}}


def threshold_for(base, state, style: str = "normal") -> Column:
    shift = {s: STATE_SHIFT[s] + STYLE_SHIFT.get(style, STYLE_SHIFT["normal"])[s] for s in STATE_SHIFT}
    pairs = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])
    return col(base) + F.coalesce(F.try_element_at(pairs, col(state)), F.lit(0.0))


def cap_bucket(value) -> Column:
    """small / mid / large / xlarge at 5, 20 and 100 billion."""
    v = col(value)
    return F.when(v < 0, None).when(v < 5e9, "small").when(v < 20e9, "mid").when(v < 100e9, "large").when(v.isNotNull(), "xlarge")


def holding_bucket(days) -> Column:
    d = col(days)
    return (F.when(d <= 5, "0-5").when(d <= 10, "6-10").when(d <= 20, "11-20").when(d <= 30, "21-30")
            .when(d.isNotNull(), "30+"))

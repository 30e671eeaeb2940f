"""The panel views as SQL, for checking queries against another engine."""

_SYMBOL = "(['600','000','300'])[CAST({k} % 3 AS INTEGER) + 1] || lpad(CAST({k} AS VARCHAR), 3, '0')"
_ORDER = ("l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
          "l_quantity, l_discount, l_tax")


def symbol(key: str) -> str:
    return _SYMBOL.format(k=key)


def _bars(code: str, source: str) -> str:
    return f"""SELECT {code} AS ts_code, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
  first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
  sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM {source} GROUP BY ALL"""


VIEWS = {
    "bars_w": _bars(symbol("s_nationkey"), "lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "bars_s": _bars("CAST(l_suppkey AS VARCHAR)", "lineitem"),
    "bars_t": """SELECT event_type AS ts_code, date_trunc('hour', ts) AS bar_time,
  first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts) AS close, count(*) AS vol FROM events GROUP BY ALL""",
    "stock_info": """SELECT CAST(s_suppkey AS VARCHAR) AS ts_code, s_name AS name, n_name AS industry,
  r_name AS market, s_acctbal AS cap, CASE WHEN s_acctbal < 0 THEN 'D' ELSE 'L' END AS list_status
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""",
    "daily_basic": """SELECT b.ts_code, b.trade_date, b.amount, s_acctbal AS total_mv
  FROM bars_s b JOIN supplier ON b.ts_code = CAST(s_suppkey AS VARCHAR)""",
    "index_bars": """SELECT trade_date, avg(close) AS close, max(high) AS high, min(low) AS low,
  sum(vol) AS vol FROM bars_s GROUP BY trade_date""",
    "region_index": """SELECT market AS index_code, trade_date, avg(close) AS close
  FROM bars_s JOIN stock_info USING (ts_code) GROUP BY ALL""",
    "calendar": """SELECT d AS cal_date, (t.day IS NOT NULL AND isodow(d) < 6) AS is_open
  FROM (SELECT CAST(unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS DATE) AS d
        FROM lineitem)
  LEFT JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) t ON t.day = d""",
    "quarterly": f"""SELECT {symbol('c_nationkey')} AS ts_code,
  CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS ann_date,
  sum(o_totalprice) AS revenue, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "positions": f"""SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS code,
  {symbol('c_nationkey')} AS ts_code, o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS buy_date,
  coalesce(shares, 0.0) AS shares, o_totalprice AS cost,
  CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'holding' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN shipped END AS sell_date,
  CASE WHEN o_orderstatus = 'F' THEN proceeds - o_totalprice END AS profit_loss
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS shipped, sum(l_quantity) AS shares,
             sum(l_extendedprice * (1 - l_discount)) AS proceeds FROM lineitem GROUP BY l_orderkey)
  ON o_orderkey = l_orderkey""",
}

def over(fn: str, back: int, to: int = 0, view_order: str = "trade_date") -> str:
    """A ROWS window over one code, ``back`` rows ago to ``to`` rows ago."""
    end = "CURRENT ROW" if to == 0 else f"{to} PRECEDING" if to > 0 else f"{-to} FOLLOWING"
    start = "CURRENT ROW" if back == 0 else f"{back} PRECEDING" if back > 0 else f"{-back} FOLLOWING"
    return (f"({fn} OVER (PARTITION BY ts_code ORDER BY {view_order} "
            f"ROWS BETWEEN {start} AND {end}))")


def roll(fn: str, n: int) -> str:
    """The current bar and the n-1 before it."""
    return over(fn, n - 1)


def strict(fn: str, n: int, value: str) -> str:
    return f"CASE WHEN {roll(f'count({value})', n)} = {n} THEN {roll(fn, n)} END"


def ref(value: str, k: int = 1) -> str:
    return f"(lag({value}, {k}) OVER (PARTITION BY ts_code ORDER BY trade_date))"


def lead(value: str, k: int = 1) -> str:
    return f"(lead({value}, {k}) OVER (PARTITION BY ts_code ORDER BY trade_date))"


NUMBERED = "SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn FROM bars_w"


def snap(sql: str, digits: int = 4) -> str:
    """Rounding that does not depend on how an engine treats exact halves."""
    p = 10 ** digits
    return f"floor(({sql}) * {p}.0 + 0.50001) / {p}.0"


def signed_log(sql: str) -> str:
    """Compounded values span many magnitudes; their logarithm, with sign, rounds alike in every engine."""
    return f"(sign({sql}) * ln(1 + abs({sql})))"


def cents(sql: str, digits: int = 2) -> str:
    """Rounding of a double half up in its shortest decimal notation."""
    return f"CAST(round(CAST(CAST({sql} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"


def rounded(columns: dict[str, str], digits: int | None = 4) -> str:
    if digits is None:
        return ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in columns.items())
    return ", ".join(f"{snap(sql, digits)} AS {name}" for name, sql in columns.items())


# a view's own inputs
_NEEDS = {"daily_basic": ["bars_s"], "index_bars": ["bars_s"],
          "region_index": ["bars_s", "stock_info"]}


def with_views(names: str, body: str, **ctes: str) -> str:
    """``body`` preceded by the named views (and further CTEs) as WITH clauses."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    # materialised: a view used twice is built once, and floating sums agree
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered]
    # a CTE whose name starts with "loop" refers to itself
    parts += [f"{n} AS {'' if n.startswith('loop') else 'MATERIALIZED '}({sql})"
              for n, sql in ctes.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body

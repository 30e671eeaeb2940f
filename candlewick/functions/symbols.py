"""Instrument codes, boards, dates and labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from candlewick.functions.series import col

# Leading digits -> exchange suffix, one table per rule.
SUFFIX_RULES = {
    "six": [(("6",), "SH")],
    "prefix": [(("688", "600", "601", "603", "605"), "SH"),
               (("000", "001", "002", "003", "300"), "SZ"), (("920",), "BJ")],
    "digit": [(("6", "9", "5"), "SH"), (("0", "3", "2"), "SZ"), (("4", "8"), "BJ")],
    "north": [(("8", "4"), "BJ"), (("6",), "SH")],
}
# What a code gets when no entry matches; None leaves it without suffix.
SUFFIX_DEFAULT = {"six": "SZ", "prefix": None, "digit": None, "north": "SZ"}

BOARDS = [(("688",), "STAR"), (("300", "301"), "ChiNext"), (("8", "4"), "Beijing")]


def _starts(c: Column, heads) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(h) for h in heads])


def _chain(c: Column, table, default: Column) -> Column:
    out = None
    for heads, value in table:
        cond = _starts(c, heads)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def with_suffix(code, rule: str = "digit") -> Column:
    """600000 -> 600000.SH by one of the suffix rules."""
    c = F.trim(col(code)) if rule == "digit" else col(code)
    default = SUFFIX_DEFAULT[rule]
    suffix = _chain(c, SUFFIX_RULES[rule], F.lit(default))
    return F.when(suffix.isNull(), c).otherwise(F.concat(c, F.lit("."), suffix))


def to_dotted(code) -> Column:
    """300486, 300486.SZ -> sz.300486; already dotted codes stay."""
    c = col(code)
    bare = F.replace(F.replace(c, F.lit(".SH"), F.lit("")), F.lit(".SZ"), F.lit(""))
    market = F.when(bare.startswith("6"), "sh.").otherwise("sz.")
    return F.when(c.rlike("^s[zh]\\."), c).otherwise(F.concat(market, bare))


def from_dotted(code) -> Column:
    """sz.300486 -> 300486.SZ."""
    c = col(code)
    return (F.when(c.startswith("sz."), F.concat(F.replace(c, F.lit("sz."), F.lit("")), F.lit(".SZ")))
            .when(c.startswith("sh."), F.concat(F.replace(c, F.lit("sh."), F.lit("")), F.lit(".SH"))).otherwise(c))


def bare_code(code) -> Column:
    """300486.SZ -> 300486."""
    return F.substring_index(col(code), ".", 1)


def market_of(symbol) -> Column:
    """china / hk / us by prefix, length and alphabet."""
    s = F.upper(F.trim(col(symbol)))
    digits = s.rlike("^[0-9]+$")
    return (F.when(s.startswith("HK."), "hk").when(s.startswith("US."), "us")
            .when(_starts(s, "63480") & (F.length(s) == 6), "china")
            .when(digits & F.length(s).isin(4, 5), "hk")
            .when(s.rlike("^[A-Z]{1,5}$"), "us")
            .when(digits & (F.length(s) == 6), "china").otherwise("us"))


def news_market_of(symbol) -> Column:
    s = F.upper(F.trim(col(symbol)))
    return (F.when(s.startswith("HK."), "hk").when(s.startswith("US."), "us")
            .when(_starts(s, "60348") | s.rlike("^[0-9]+$"), "china")
            .when(F.length(s).isin(4, 5), "hk").when(s.rlike("^[A-Z]{1,5}$"), "us").otherwise("china"))


def board_of(code) -> Column:
    """Board of a bare or dotted code; dotted codes tell Shanghai's from Shenzhen's main board."""
    c = col(code)
    number = F.element_at(F.split(c, "\\."), -1)
    main = F.when(c.startswith("sh."), "Main (Shanghai)").when(c.startswith("sz."), "Main (Shenzhen)").otherwise("Main")
    return _chain(number, BOARDS, main)


def parse_day(value) -> Column:
    """Date of yyyyMMdd (text or number), yyyy-MM-dd or yyyy/MM/dd; else null."""
    text = F.regexp_replace(col(value).cast("string"), "[-/]", "")
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


# Accepted timestamp formats, in the order tried.
TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd HH:mm:ss"]


def parse_time(value) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col(value), F.lit(f)) for f in TIMESTAMP_FORMATS])


def label(value, names: dict[str, str], default) -> Column:
    """Name of a code, or ``default`` (a text or a column)."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(value)), default if isinstance(default, Column) else F.lit(default))


# Names shown for codes.
STRATEGY_NAMES = {"b1": "B1策略", "b2": "B2策略", "blk": "BLK策略", "blkB2": "BLKB2策略", "dl": "DL策略",
                  "dz30": "DZ30策略", "scb": "SCB策略"}
SECURITY_TYPES = {"1": "主板", "2": "指数", "4": "转债", "5": "ETF"}
LIST_STATUS = {"1": "L", "0": "D"}


def number_or_null(value) -> Column:
    """Number of a text; empty text and the tokens ``None`` and ``-`` are null."""
    text = F.trim(col(value).cast("string"))
    return F.when(~text.isin("", "None", "-"), text).try_cast("double")


def finite(value, default=None) -> Column:
    """NaN and infinities become ``default`` (null unless given)."""
    v = col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(v)


def excluded(name, code, prefixes=("30", "68", "8", "4")) -> Column:
    """Special-treatment names and boards left out of buying."""
    return F.coalesce(col(name).contains("ST"), F.lit(False)) | _starts(col(code), prefixes)

"""Column functions of the tape: prices, fees, quotes, labels. All are expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Supply of a token, default fee in basis points.
SUPPLY, DEFAULT_FEE_BPS = 1e9, 125
SECOND = 1_000_000


def price(vsol: Column, vtok: Column) -> Column:
    """Mid price; null without tokens."""
    return F.when(vtok != 0, vsol / vtok)


def market_cap(vsol: Column, vtok: Column) -> Column:
    return price(vsol, vtok) * SUPPLY


def fee_fraction(fee_bps: Column, creator_bps: Column) -> Column:
    """Fees as a fraction; the default where the fee is unknown."""
    return F.when(fee_bps.isNull(), DEFAULT_FEE_BPS / 1e4).otherwise((fee_bps + F.coalesce(creator_bps, F.lit(0))) / 1e4)


def quote_buy(vsol: Column, vtok: Column, sol: Column, fee: Column) -> Column:
    """Tokens out of a constant-product pool for SOL in, after the fee."""
    net = sol / (1 + fee)
    return vtok * net / (vsol + net)


def quote_sell(vsol: Column, vtok: Column, tok: Column, fee: Column) -> Column:
    """SOL out for tokens in, after the fee."""
    return vsol * tok / (vtok + tok) * (1 - fee)


def round_trip(vsol0: Column, vtok0: Column, vsol1: Column, vtok1: Column, size: Column, fee: Column) -> Column:
    """Net result of buying ``size`` at one state and selling all at another."""
    return quote_sell(vsol1, vtok1, quote_buy(vsol0, vtok0, size, fee), fee) - size


def log_impact(buy: Column, vsol: Column, sol: Column) -> Column:
    """Log price impact of a print from the reserves after it; null where it isn't finite."""
    before = F.when(buy, vsol - sol).otherwise(vsol + sol)
    return F.when(before > 0, 2 * F.log(vsol / before))


def mid_after(tok: Column, sol: Column, dtok: Column, dsol: Column, offset: Column) -> Column:
    """Mid price after a swap from logged reserves before it and the pool's constant offset."""
    return F.greatest(sol + dsol + offset, F.lit(0.0)) / F.greatest(tok + dtok, F.lit(1e-12))


def trusted(vsol: Column, rsol: Column) -> Column:
    return F.abs(vsol - rsol - 30) < 0.01


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held to a range; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def slippage_tier(volume: Column, tiers: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first tier whose bound the volume reaches."""
    out = F.lit(rest)
    for bound, value in sorted(tiers):
        out = F.when(volume >= bound, F.lit(value)).otherwise(out)
    return out


def split_label(at: Column, bounds: list[tuple[int, str]], last: str) -> Column:
    """Name of the first split whose end lies after the time."""
    out = F.lit(last)
    for end, name in sorted(bounds, reverse=True):
        out = F.when(at < end, F.lit(name)).otherwise(out)
    return out


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def book_vwap(levels: Column, notional: float) -> Column:
    """Mean price of taking a notional from (price, size) levels in order; null if they don't hold it."""

    def take(state: Column, level: Column) -> Column:
        use = F.least(state["left"], level["price"] * level["size"])
        return F.struct((state["left"] - use).alias("left"), (state["qty"] + use / level["price"]).alias("qty"))

    begin = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("qty"))
    return F.aggregate(levels, begin, take, lambda s: F.when((s["left"] <= 1e-9) & (s["qty"] > 0), F.lit(float(notional)) / s["qty"]))


def taker_fill(bid: Column, ask: Column, bid_size: Column, ask_size: Column, buy: Column, units: Column) -> Column:
    """Taker price: the touch, and one spread worse for what the touch does not hold."""
    touch, size = F.when(buy, ask).otherwise(bid), F.when(buy, ask_size).otherwise(bid_size)
    at_touch = F.least(units, size)
    beyond = F.when(buy, ask + (ask - bid)).otherwise(bid - (ask - bid))
    return (at_touch * touch + (units - at_touch) * beyond) / units


#: SQL functions of the same meaning, for those who write SQL: name, parameters, result, body.
SQL_FUNCTIONS = (
    ("tape_price", "s DOUBLE, k DOUBLE", "DOUBLE", "CASE WHEN k <> 0 THEN s / k END"),
    ("tape_cap", "s DOUBLE, k DOUBLE", "DOUBLE", f"CASE WHEN k <> 0 THEN s / k * {SUPPLY} END"),
    ("tape_fee", "bps DOUBLE, creator DOUBLE", "DOUBLE", f"CASE WHEN bps IS NULL THEN {DEFAULT_FEE_BPS / 1e4} ELSE (bps + coalesce(creator, 0)) / 1e4 END"),
    ("tape_quote_buy", "s DOUBLE, k DOUBLE, paid DOUBLE, fee DOUBLE", "DOUBLE", "k * (paid / (1 + fee)) / (s + paid / (1 + fee))"),
    ("tape_quote_sell", "s DOUBLE, k DOUBLE, sold DOUBLE, fee DOUBLE", "DOUBLE", "s * sold / (k + sold) * (1 - fee)"),
    ("tape_signed_log", "x DOUBLE", "DOUBLE", "signum(x) * ln(1 + abs(x))"),
)


def register(spark: SparkSession) -> None:
    """Make the SQL functions known to a session; Catalyst puts their bodies in place, so there is no call at run time."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

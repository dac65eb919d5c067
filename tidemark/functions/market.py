"""Scalar functions of market data as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ieee import ln, ratio


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def log_return_bps(now, was) -> Column:
    """0 where either isn't positive."""
    a, b = _c(now), _c(was)
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.log(a / b) * 1e4)


def simple_return_bps(later, now) -> Column:
    return F.round((_c(later) / _c(now) - 1) * 1e4, 4)


def ternary(value, threshold: float) -> Column:
    return F.when(_c(value) >= threshold, 1).when(_c(value) <= -threshold, -1).otherwise(0)


def mid(bid="bid", ask="ask") -> Column:
    return (_c(bid) + _c(ask)) / 2


def spread_bps(bid="bid", ask="ask") -> Column:
    return (_c(ask) - _c(bid)) / mid(bid, ask) * 1e4


def microprice(bid="bid", bid_sz="bid_sz", ask="ask", ask_sz="ask_sz") -> Column:
    """Each side weighted by the other one's size; the mid where both are empty."""
    total = _c(bid_sz) + _c(ask_sz)
    return F.when(total > 0, (_c(bid) * _c(ask_sz) + _c(ask) * _c(bid_sz)) / total).otherwise(mid(bid, ask))


def imbalance(bid, ask) -> Column:
    total = _c(bid) + _c(ask)
    return F.when(total > 0, (_c(bid) - _c(ask)) / total).otherwise(0.0)


def depth(levels: Column, n: int) -> Column:
    """Sum of the sizes of the best n levels of an array of (price, size) structs."""
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["size"])


def interpolate(x, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), the ends held."""
    v = _c(x)
    out = F.when(v <= xs[0], ys[0])
    for (a, p), (b, q) in zip(zip(xs, ys, strict=True), list(zip(xs, ys, strict=True))[1:], strict=False):
        out = out.when(v <= b, p + (v - a) * ((q - p) / (b - a)))
    return out.otherwise(ys[-1])


def canonical_coin(name) -> Column:
    """Upper case, quote currency and leading multiplier taken off."""
    base = F.regexp_replace(F.upper(_c(name)), "[-_/]?(USDT|USDC|USD|PERP)$", "")
    return F.regexp_replace(base, "^(1000000|100000|10000|1000|1M|K(?=[A-Z]{3,}$))", "")


def joined_symbol(name) -> Column:
    return F.regexp_replace(_c(name), "-", "")


def weekday(ts_ms) -> Column:
    """0 is Monday."""
    return F.pmod(F.floor(_c(ts_ms) / 86_400_000) + 3, F.lit(7))


def hour(ts_ms) -> Column:
    return F.pmod(F.floor(_c(ts_ms) / 3_600_000), F.lit(24))


def horizon_tag(seconds: float) -> str:
    return f"{seconds:g}".replace(".", "p") + "s"


def to_tick(x, tick: float) -> Column:
    """Down to a multiple of tick, in decimals."""
    d, t = _c(x).cast("decimal(28,10)"), F.lit(str(tick)).cast("decimal(28,10)")
    return (F.floor(d / t) * t).cast("double")


def parkinson_bps(high, low) -> Column:
    return ln(ratio(_c(high), _c(low))) / F.lit(2 * 0.8325546111576977) * 1e4


def liquidation_price(side, entry, leverage: float, mmr, buffer: float = 0.0) -> Column:
    """side 1 is long, -1 short; null where a long's isn't positive; never beyond entry."""
    e, m = _c(entry), _c(mmr)
    long = e * (1 - 1 / leverage) / (1 - m) * (1 + buffer)
    short = e * (1 + 1 / leverage) / (1 + m) * (1 - buffer)
    return F.when(_c(side) > 0, F.when(long > 0, F.least(long, e))).otherwise(F.greatest(short, e))


def max_safe_leverage(side, buffer: float, mmr) -> Column:
    m = _c(mmr)
    return F.when(_c(side) > 0, 1 / (1 - (1 - buffer) * (1 - m))).otherwise(1 / ((1 + buffer) * (1 + m) - 1))


def reasons(rules: dict[str, Column]) -> Column:
    """All of the rules' names that fail, in order; a rule that is null fails."""
    return F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def vol_size(equity: float, risk: float, price, vol_bps) -> Column:
    return equity * risk / (_c(price) * F.greatest(_c(vol_bps), F.lit(1.0)) / 1e4)

"""Price, yield, policy, FX and session columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions.numbers import round_half_up


def direction(change: Column, threshold: float) -> Column:
    return F.when(change > threshold, F.lit("UP")).when(change < -threshold, F.lit("DOWN")).otherwise(F.lit("FLAT"))


def price_change(latest: Column, previous: Column) -> Column:
    """Change value, per cent and direction; zero when either close is not positive."""
    a, p = round_half_up(latest.cast("double"), 4), round_half_up(previous.cast("double"), 4)
    ok = (a > 0) & (p > 0)
    value = F.when(ok, round_half_up(a - p, 4)).otherwise(F.lit(0.0))
    pct = F.when(ok, round_half_up((a - p) / p * F.lit(100.0), 4)).otherwise(F.lit(0.0))
    level = lambda c: F.when(a < 20.0, round_half_up(c, 4)).otherwise(round_half_up(c, 2))
    return F.struct(
        level(a).alias("latest_close"), level(p).alias("previous_close"), value.alias("change_value"),
        pct.alias("change_percent"), direction(pct, 0.05).alias("direction"),
    )


def yield_change(current: Column, previous: Column) -> Column:
    a, p = round_half_up(current.cast("double"), 3), round_half_up(previous.cast("double"), 3)
    bp = round_half_up((a - p) * F.lit(100.0), 1)
    return F.struct(a.alias("yield_percent"), bp.alias("change_bp"), direction(bp, 0.5).alias("direction"))


def policy_action(rate: Column, previous: Column, lower: Column, upper: Column, previous_lower: Column) -> Column:
    """HIKE, CUT or HOLD from a target range when there is one, else a single rate."""
    step = F.coalesce(
        F.when(lower.isNotNull() & upper.isNotNull(), F.coalesce(lower - previous_lower, F.lit(0.0))),
        rate - previous, F.lit(0.0),
    )
    bp = round_half_up(step * F.lit(100.0), 1)
    act = F.when(bp > 0.5, F.lit("HIKE")).when(bp < -0.5, F.lit("CUT")).otherwise(F.lit("HOLD"))
    return F.struct(bp.alias("change_bp"), act.alias("action"))


def signed_percent(pct: Column) -> Column:
    return F.format_string("%+,.2f%%", round_half_up(pct, 2))


# --- fixed values: wording by quote convention (rising pair: first currency or quote currency gains) ---
FX_WORDING = [
    ("GBP", "Sterling (GBP)", "against", "GBP/USD", "£1 buys", "US Dollars", True),
    ("EUR", "Euro (EUR)", "against", "EUR/USD", "€1 buys", "US Dollars", True),
    ("INR", "Indian Rupee (INR)", "versus", "USD/INR", "$1 buys", "Indian Rupees", False),
    ("JPY", "Japanese Yen (JPY)", "versus", "USD/JPY", "$1 buys", "Japanese Yen", False),
]


def fx_statement(symbol: Column, name: Column, move: Column, pct: Column) -> Column:
    s = F.upper(symbol)
    statement, detail = F.concat(name, F.lit(" "), move), F.lit("")
    for code, label, word, pair, buys, what, base_is_subject in reversed(FX_WORDING):
        up, down = ("strengthened", "weakened") if base_is_subject else ("weakened", "strengthened")
        said = (
            F.when(move == "UP", F.concat(F.lit(f"{label} {up} {word} USD ("), signed_percent(pct), F.lit(")")))
            .when(move == "DOWN", F.concat(F.lit(f"{label} {down} {word} USD ("), signed_percent(pct), F.lit(")")))
            .otherwise(F.lit(f"{label} held flat versus USD"))
        )
        more = (
            F.when(move == "UP", F.lit(f"{pair} rose — {buys} more {what}"))
            .when(move == "DOWN", F.lit(f"{pair} fell — {buys} fewer {what}"))
            .otherwise(F.lit(f"{pair} unchanged"))
        )
        statement = F.when(s.contains(code), said).otherwise(statement)
        detail = F.when(s.contains(code), more).otherwise(detail)
    return F.struct(statement.alias("statement"), detail.alias("detail"))


def market_moving(text: Column) -> Column:
    """Relationship and the 1-based numbers of the phrases that matched."""
    low = F.lower(text)
    hits = F.array_compact(
        F.array(*[F.when(low.rlike(p), F.lit(i + 1)) for i, p in enumerate(lx.MARKET_MOVING_PATTERNS)])
    )
    return F.struct(
        F.when(F.size(hits) > 0, F.lit("MARKET_MOVING")).otherwise(F.lit("RELATED")).alias("relationship"),
        hits.alias("patterns"),
    )


def exchange_array() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(region).alias("region"), F.lit(symbol).alias("symbol"), F.lit(zone).alias("zone"),
                F.array(*[F.struct(F.lit(o).alias("open"), F.lit(c).alias("close")) for o, c in sessions]).alias("sessions"),
                F.lit(pre).alias("pre_open"), F.lit(post).alias("post_close"),
            )
            for region, symbol, zone, sessions, pre, post in lx.EXCHANGES
        ]
    )


def session_state(instant: Column, exchange: Column) -> Column:
    """OPEN, PRE_MARKET, POST_MARKET or CLOSED at an instant, Monday to Friday."""
    local = F.from_utc_timestamp(instant, exchange["zone"])
    minute = (F.unix_micros(local) % F.lit(86400000000)) / F.lit(60000000.0)
    opened = F.exists(exchange["sessions"], lambda s: (s["open"] <= minute) & (minute <= s["close"]))
    first, last = exchange["sessions"][0]["open"], F.element_at(exchange["sessions"], -1)["close"]
    return (
        F.when(F.weekday(local) >= 5, F.lit("CLOSED"))
        .when(opened, F.lit("OPEN"))
        .when((exchange["pre_open"] <= minute) & (minute < first), F.lit("PRE_MARKET"))
        .when((last < minute) & (minute <= exchange["post_close"]), F.lit("POST_MARKET"))
        .otherwise(F.lit("CLOSED"))
    )


def daily_pick(day: Column, n: Column) -> Column:
    """SHA-256 of the ISO date modulo n, digit by digit."""
    digits = F.split(F.sha2(day.cast("string"), 256), "")
    value = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    return F.aggregate(value, F.lit(0).cast("bigint"), lambda acc, d: (acc * 16 + d) % n)

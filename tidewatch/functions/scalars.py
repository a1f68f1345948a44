"""Scalar functions of the flow model, as column expressions (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.schema import FLOW_FIELDS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_double(col: Column | str) -> Column:
    """A number as double; 0 for what isn't one (NaN stays)."""
    return F.coalesce(_c(col).try_cast("double"), F.lit(0.0))


def safe_long(col: Column | str) -> Column:
    """A number cut towards zero; 0 for what isn't finite or isn't a number."""
    x = F.trim(_c(col).cast("string")).try_cast("double")
    return F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).try_cast("long"), F.lit(0)).cast("long")


def country_of(ip: Column | str) -> Column:
    """Country of an address by the range of its first octet."""
    octet = F.element_at(F.split(_c(ip), r"\."), 1).try_cast("int")
    # First octet ranges.
    return F.when(octet.between(1, 9), "US").when(octet.between(10, 49), "CN").when(octet.between(50, 99), "EU").when(octet.between(100, 149), "RU").when(octet.between(150, 199), "IN").otherwise("OTHER")


def protocol_name(number: Column | str) -> Column:
    n = _c(number)
    return F.when(n == 6, "TCP").when(n == 17, "UDP").otherwise("OTHER")


#: Time formats, tried in order.
TIME_FORMATS = ("d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d H:m:s", "d-M-yyyy H:m:s")


def parse_time(text: Column | str) -> Column:
    """Epoch seconds of a time in one of TIME_FORMATS or of a number; 0 for neither.  Read as UTC whatever the session's zone."""
    s = F.trim(_c(text))
    shapes = (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",) * 2 + (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$")
    tried = [F.when(s.rlike(shape), F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(s, F.lit(fmt)), "UTC")) / 1e6) for shape, fmt in zip(shapes, TIME_FORMATS, strict=True)]
    return F.coalesce(*tried, F.when(~s.rlike("[a-zA-Z]"), s.try_cast("double")), F.lit(0.0))


def subnet(ip: Column | str, parts: int) -> Column:
    """The first `parts` dotted parts of an address (3: /24, 2: /16)."""
    return F.substring_index(_c(ip), ".", parts)


def duration(start: Column | str = "start_time", last: Column | str = "last_time") -> Column:
    return F.greatest(_c(last) - _c(start), F.lit(0.0))


def window_id(t: Column | str, dt: float) -> Column:
    return F.floor(_c(t) / F.lit(float(dt))).cast("long")


def context(ts: Column | str) -> tuple[Column, Column]:
    """(hour, day of week with Monday 0) of a timestamp."""
    return F.pmod(F.hour(_c(ts)), F.lit(24)), F.pmod(F.weekday(_c(ts)), F.lit(7))


def confidence(z: Column | str) -> Column:
    return F.least(F.abs(_c(z)) / 5.0, F.lit(1.0))


def requests_of(packets: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(_c(packets) / 3).cast("long"))


def is_tcp(proto: Column | str) -> Column:
    return F.upper(_c(proto)) == "TCP"


def flags(tcp_flags: Column | str) -> dict[str, Column]:
    """SYN, ACK, FIN and RST bits of a TCP flag byte."""
    f = _c(tcp_flags)
    return {name: f.bitwiseAND(F.lit(bit)) != 0 for name, bit in (("fin", 0x01), ("syn", 0x02), ("rst", 0x04), ("ack", 0x10))}


def filled(available: list[str]) -> list[Column]:
    """The 16 columns of a flow: what is there, defaults for what is missing or null."""
    return [(F.coalesce(F.col(n).cast(t), F.lit(d).cast(t)) if n in available else F.lit(d).cast(t)).alias(n) for n, t, d in FLOW_FIELDS]


def tier_of(score: Column | str, s: Settings) -> Column:
    """3, 2, 1, 0 (alert) or -1."""
    x = _c(score)
    return F.when(x >= s.tier3, 3).when(x >= s.tier2, 2).when(x >= s.tier1, 1).when(x >= s.alert, 0).otherwise(-1)


def action_text(score: Column | str, sources: Column | str, s: Settings) -> Column:
    """What the score calls for, in words; `sources` is their number."""
    x, n = _c(score), _c(sources).cast("string")
    # The texts.
    return (
        F.when(x < s.alert, F.lit("Monitoring"))
        .when(x < s.tier1, F.concat(F.lit("ALERT: Score "), F.format_string("%.3f", x), F.lit(" - manual review recommended")))
        .when(x < s.tier2, F.concat(F.lit("TIER-1: Rate limiting "), n, F.lit(" sources to 2x baseline")))
        .when(x < s.tier3, F.concat(F.lit("TIER-2: Aggressive limiting + challenges for "), n, F.lit(" sources")))
        .otherwise(F.concat(F.lit("TIER-3: BLOCKING "), n, F.lit(" top sources (5-min expiry)")))
    )

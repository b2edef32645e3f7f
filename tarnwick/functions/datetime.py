"""Date and time functions, in UTC.  Times of day are day-time intervals since midnight."""

from __future__ import annotations

#: Part names and abbreviations of DATEADD and DATEDIFF (fixed values).
PARTS = {
    "YEAR": ("year", "yy", "yyyy"), "QUARTER": ("quarter", "qq", "q"), "MONTH": ("month", "mm", "m"), "WEEK": ("week", "wk", "ww"), "DAY": ("day", "dd", "d"), "HOUR": ("hour", "hh"),
    "MINUTE": ("minute", "mi", "n"), "SECOND": ("second", "ss", "s"), "MILLISECOND": ("millisecond", "ms"),
}
#: strftime codes and their Spark patterns (fixed values).
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSS", "%j": "DDD", "%y": "yy", "%%": "%"}
_NOW = "cast(current_timestamp() as timestamp_ntz)"
_LOCAL = "cast(from_utc_timestamp(current_timestamp(), {zone}) as timestamp_ntz)"


def stamp(x: str) -> str:
    return f"cast({x} as timestamp_ntz)"


def part_of(text: str) -> str:
    name = text.strip("'`\"").lower()
    for unit, names in PARTS.items():
        if name in names:
            return unit
    raise ValueError(f"unknown date part {text}")


def since_midnight(x: str) -> str:
    return f"({stamp(x)} - date_trunc('DAY', {stamp(x)}))"


def dateadd(part: str, n: str, x: str) -> str:
    return f"timestampadd({part_of(part)}, {n}, {stamp(x)})"


def datediff(part: str, a: str, b: str) -> str:
    """b - a: years and months by calendar fields, the rest as elapsed whole units."""
    unit = part_of(part)
    if unit == "YEAR":
        return f"cast(year({b}) - year({a}) as bigint)"
    if unit == "MONTH":
        return f"cast((year({b}) - year({a})) * 12 + month({b}) - month({a}) as bigint)"
    return f"timestampdiff({unit}, {stamp(a)}, {stamp(b)})"


def strftime(pattern: str, x: str) -> str:
    if not pattern.startswith("'"):
        raise ValueError("STRFTIME needs a literal pattern")
    out, text, at = [], pattern[1:-1], 0
    while at < len(text):
        code = text[at : at + 2]
        if code in STRFTIME:
            out.append(STRFTIME[code])
            at += 2
        else:
            out.append(f"''{text[at]}''" if text[at].isalpha() else text[at])
            at += 1
    return f"date_format({stamp(x)}, '{''.join(out)}')"


def _total(divisor: str):
    return lambda x: f"(cast(extract(DAY FROM {x}) * 86400 + extract(HOUR FROM {x}) * 3600 + extract(MINUTE FROM {x}) * 60 + extract(SECOND FROM {x}) as double) / {divisor})"


def local(text: str) -> str:
    return _LOCAL.format(zone="current_timezone()") if text == "ts" else f"cast({local('ts')} as date)" if text == "date" else since_midnight(local("ts"))


RENDER = {
    "NOW": lambda: _NOW,
    "CURRENT_TIMESTAMP": lambda: _NOW,
    "CURRENT_DATE": lambda: "current_date()",
    "CURRENT_TIME": lambda: since_midnight(_NOW),
    "DATE": lambda x: f"to_date({x})",
    "TODATE": lambda x: f"try_cast({x} as date)",
    "DATETIME": stamp,
    "TIME": since_midnight,
    "MILLISECOND": lambda x: f"cast(floor(extract(SECOND FROM {stamp(x)}) * 1000) % 1000 as int)",
    "MS": lambda x: f"cast(floor(extract(SECOND FROM {stamp(x)}) * 1000) % 1000 as int)",
    "TOTAL_SECONDS": _total("1d"),
    "TOTAL_MINUTES": _total("60d"),
    "TOTAL_HOURS": _total("3600d"),
    "TOTAL_DAYS": _total("86400d"),
    "TOTAL_MILLISECONDS": _total("0.001d"),
    "DATEADD": dateadd,
    "DATEDIFF": datediff,
    "STRFTIME": strftime,
    "WEEK": lambda x: f"weekofyear({stamp(x)})",
    "MAKEDATE": lambda y, n: f"date_add(make_date({y}, 1, 1), cast({n} as int) - 1)",
    "MAKETIME": lambda h, m, s: f"make_dt_interval(0, {h}, {m}, {s})",
}
RENDER |= {n.upper(): (lambda x, n=n: f"{n}({stamp(x)})") for n in ("year", "month", "day", "hour", "minute", "second", "dayofweek", "dayofyear", "weekofyear", "quarter")}
RENDER |= {n: (lambda: local("ts")) for n in ("LOCALTIMESTAMP", "NOW_LOCAL")} | {n: (lambda: local("date")) for n in ("LOCALDATE", "CURRENT_DATE_LOCAL")} | {n: (lambda: local("time")) for n in ("LOCALTIME", "CURRENT_TIME_LOCAL")}

"""Numeric functions.  ROUND is half-even on doubles; FLOOR and CEIL give doubles; MOD by zero is NULL."""

from __future__ import annotations


def _double(x: str) -> str:
    return f"cast({x} as double)"


def _simple(name: str):
    return lambda x: f"{name}({_double(x)})"


def trunc(x: str, n: str = "0") -> str:
    return f"(signum({_double(x)}) * floor(abs({_double(x)}) * power(10d, {n})) / power(10d, {n}))"


def random(low: str | None = None, high: str | None = None) -> str:
    return "rand()" if low is None else f"cast(floor(rand() * (({high}) - ({low}) + 1)) + ({low}) as bigint)"


RENDER = {
    "ABS": lambda x: f"abs({x})",
    "ROUND": lambda x, n="0": f"bround({_double(x)}, {n})",
    "FLOOR": lambda x: f"cast(floor({x}) as double)",
    "CEIL": lambda x: f"cast(ceil({x}) as double)",
    "CEILING": lambda x: f"cast(ceil({x}) as double)",
    "TRUNC": trunc,
    "TRUNCATE": trunc,
    "POWER": lambda x, y: f"power({_double(x)}, {_double(y)})",
    "SIGN": lambda x: f"cast(signum({x}) as int)",
    "LOG": _simple("ln"),
    "LN": _simple("ln"),
    "MOD": lambda x, y: f"try_mod(cast({x} as bigint), cast({y} as bigint))",
    "PI": lambda: "pi()",
    "ATAN2": lambda y, x: f"atan2({_double(y)}, {_double(x)})",
    "RANDOM": random,
} | {n.upper(): _simple(n) for n in ("sqrt", "exp", "log10", "log2", "degrees", "radians", "sin", "cos", "tan", "asin", "acos", "atan")}

"""String functions.  Positions are 1-based code points; any NULL argument gives NULL; TRIM strips all Unicode white space."""

from __future__ import annotations

import re


def _text(x: str) -> str:
    return f"cast({x} as string)"


def _strip(pattern: str):
    def render(x: str, chars: str | None = None) -> str:
        if chars is None:
            return f"regexp_replace({_text(x)}, r'(?U){pattern}', '')"
        kind = {r"^\s+": "LEADING", r"\s+$": "TRAILING"}.get(pattern, "BOTH")
        return f"trim({kind} {chars} FROM {_text(x)})"

    return render


def substring(x: str, start: str, length: str | None = None) -> str:
    rest = "" if length is None else f", greatest(cast({length} as int), 0)"
    return f"substring({_text(x)}, greatest(cast({start} as int), 1){rest})"


def _pad(name: str):
    # the first character of the padding repeats
    return lambda x, n, pad="' '": f"{name}({_text(x)}, {n}, left({pad}, 1))"


def concat_ws(sep: str, *args: str) -> str:
    return f"CASE WHEN {' OR '.join(f'({a}) IS NULL' for a in (sep, *args))} THEN NULL ELSE concat_ws({sep}, {', '.join(map(_text, args))}) END"


def number_or_date_format(value: str, pattern: str) -> str:
    """FORMAT(value, 'N2' | 'F2' | 'D5' | 'P1' | date pattern); the arguments may be given in either order."""
    if value.startswith("'") and not pattern.startswith("'"):
        value, pattern = pattern, value
    if not pattern.startswith("'"):
        raise ValueError("FORMAT needs a literal pattern")
    p = pattern[1:-1]
    if m := re.fullmatch(r"([NnFfDdPp])(\d*)", p):
        kind, n = m[1].upper(), int(m[2] or ("0" if m[1] in "Dd" else "2"))
        return {
            "N": f"format_number(cast({value} as double), {n})",
            "F": f"format_string('%.{n}f', cast({value} as double))",
            "D": f"format_string('%0{n or 1}d', cast({value} as bigint))",
            "P": f"concat(format_number(cast({value} as double) * 100, {n}), ' %')",
        }[kind]
    return f"date_format({value}, '{p.replace('tt', 'a').replace('ffffff', 'SSSSSS').replace('fff', 'SSS')}')"


RENDER = {
    "LENGTH": lambda x: f"char_length({_text(x)})",
    "LEN": lambda x: f"char_length({_text(x)})",
    "CHAR_LENGTH": lambda x: f"char_length({_text(x)})",
    "OCTET_LENGTH": lambda x: f"octet_length({_text(x)})",
    "UPPER": lambda x: f"upper({_text(x)})",
    "LOWER": lambda x: f"lower({_text(x)})",
    "TRIM": _strip(r"^\s+|\s+$"),
    "LTRIM": _strip(r"^\s+"),
    "RTRIM": _strip(r"\s+$"),
    "SUBSTR": substring,
    "SUBSTRING": substring,
    "REPLACE": lambda x, a, b: f"replace({_text(x)}, {a}, {b})",
    "INSTR": lambda x, sub: f"instr({_text(x)}, {sub})",
    "POSITION": lambda sub, x: f"instr({_text(x)}, {sub})",
    "REVERSE": lambda x: f"reverse({_text(x)})",
    "CONCAT": lambda *a: f"concat({', '.join(map(_text, a))})",
    "CONCAT_WS": concat_ws,
    "REPEAT": lambda x, n: f"repeat({_text(x)}, {n})",
    "SPACE": lambda n: f"space({n})",
    "LPAD": _pad("lpad"),
    "RPAD": _pad("rpad"),
    "LEFT": lambda x, n: f"left({_text(x)}, {n})",
    "RIGHT": lambda x, n: f"right({_text(x)}, {n})",
    "FORMAT": number_or_date_format,
}
#: Functions whose result is text, for + as concatenation.
TEXT = set(RENDER) - {"LENGTH", "LEN", "CHAR_LENGTH", "OCTET_LENGTH", "INSTR", "POSITION"}

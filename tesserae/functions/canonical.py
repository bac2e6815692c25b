"""Canonical JSON (RFC 8785): members by UTF-16 code units, ECMAScript numbers, least escapes."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tesserae.errors import NotImplementedYet

EXACT = 1 << 53
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def number(x: float) -> str:
    """The shortest digits that give x again, laid out as ECMAScript does."""
    if not math.isfinite(x):
        raise NotImplementedYet("canonical JSON of a number that isn't finite")
    if x == 0:
        return "0"
    mantissa, _, power = f"{x!r}".partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa.startswith("-") else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(digits))  # digits before the decimal point
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    exponent = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + digits[0] + (f".{digits[1:]}" if n > 1 else "") + exponent


def integer(n: int) -> int | str:
    """As a JSON number up to 2 ** 53, as a string beyond."""
    return n if abs(n) <= EXACT else str(n)


def string(s: str) -> str:
    return '"' + "".join(_SHORT.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        return string(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(text(x) for x in value) + "]"
    members = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{string(k)}:{text(v)}" for k, v in members) + "}"


@pandas_udf(StringType())
def canonical(documents: pd.Series) -> pd.Series:
    """Canonical form of JSON texts."""
    return documents.map(lambda d: None if d is None else text(json.loads(d)))

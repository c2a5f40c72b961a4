"""Durations written like ``1h2m3.5s`` or ``250ms``."""

from __future__ import annotations

import re
from datetime import timedelta
from fractions import Fraction

UNITS = {"ns": Fraction(1, 1000), "us": Fraction(1), "µs": Fraction(1), "μs": Fraction(1), "ms": Fraction(1000), "s": Fraction(10**6), "m": Fraction(60 * 10**6), "h": Fraction(3600 * 10**6)}
TERM = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> timedelta:
    """Whole microseconds; finer parts are cut."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return timedelta(0)
    terms = list(TERM.finditer(body))
    if not terms or "".join(m[0] for m in terms) != body:
        raise ValueError(f"bad duration {text!r}")
    return timedelta(microseconds=int(sign * sum(Fraction(m[1].rstrip(".") if m[1][0] != "." else f"0{m[1]}") * UNITS[m[2]] for m in terms)))

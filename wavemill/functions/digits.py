"""Arabic digits in transcripts to Chinese numerals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column

from .text import arrow_udf

# Fixed values.
DIGITS = "零一二三四五六七八九"
UNITS = "度%倍个只台盏件套双点G"


def _group(n: int) -> str:
    """1 to 9999: every digit with its unit, a zero for each one inside and none at the ends."""
    spelt = "".join(DIGITS[int(d)] + (u if d != "0" else "") for d, u in zip(f"{n:04d}", ("千", "百", "十", ""))).strip(DIGITS[0])
    return spelt[1:] if spelt.startswith("一十") else spelt


def numeral(n: int) -> str | None:
    """0 to 99 999 999, negative numbers with a prefix; None beyond.  No zero stands between the two groups of four."""
    if n < 0:
        inner = numeral(-n)
        return None if inner is None else "负" + inner
    if n >= 10**8:
        return None
    if n == 0:
        return DIGITS[0]
    high, low = divmod(n, 10_000)
    return (_group(high) + "万" if high else "") + (_group(low) if low else "")


def decimal(s: str) -> str:
    whole, dot, fraction = s.partition(".")
    spelt = numeral(int(whole)) if whole else DIGITS[0]
    if spelt is None:
        return s
    read = "".join(DIGITS[int(d)] for d in fraction if d.isdigit())
    return spelt + ("点" + read if dot and read else "")


def _or(s: str, otherwise: str) -> str:
    return numeral(int(s)) or otherwise


# In order; a number too large keeps its text (with the percent prefix again, as the whole match stands for it).
_RULES = [
    (re.compile(r"百分之(\d+)"), lambda m: "百分之" + _or(m[1], m[0])),
    (re.compile(r"(\d+)%"), lambda m: "百分之" + _or(m[1], m[0])),
    (re.compile(r"\d+\.\d+"), lambda m: decimal(m[0])),
    (re.compile(rf"(\d+)([{UNITS}])"), lambda m: _or(m[1], m[1]) + m[2]),
    (re.compile(r"(?<![A-Za-z\d])\d+"), lambda m: _or(m[0], m[0])),
]


def verbalise(text: str | None) -> str | None:
    for pattern, spell in _RULES if text else ():
        text = pattern.sub(spell, text)
    return text


def normalize_digits(c: Column | str) -> Column:
    return arrow_udf("string", verbalise, c)


def number_to_numeral(c: Column | str) -> Column:
    return arrow_udf("string", lambda n: None if pd.isna(n) else numeral(int(n)), c)

"""Numbers in event fields."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:[+-]?inf(?:inity)?|nan))\z"


def number_of(text: Column) -> Column:
    """The double that a field holds, or null: no blanks, suffixes or overflow; `inf` and `nan` words count. Hexadecimal floats don't."""
    value = text.try_cast("double")
    return F.when(text.rlike(_NUMBER) & ((F.abs(value) != float("inf")) | text.rlike("^[+-]?[iI]")), value)


def parse_number(text: str) -> float:
    """The same on the driver, for rule values; ValueError if it is none."""
    text = str(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        out = float(text)
        if not math.isinf(out):
            return out
    if re.fullmatch(r"(?i)[+-]?inf(inity)?|nan", text):
        return float(text)
    raise ValueError(f"not a number: {text!r}")

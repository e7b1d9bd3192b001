"""Numbers as text, as the C formats print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, digits: int) -> Column:
    """A double with `digits` decimals, as C prints %.<digits>f: the nearest text, and of two equally near the one with an even
    last digit. null, NaN and infinities are as format_string gives them.

    format_string rounds the shortest text of a double half up. So only numbers whose shortest text ends in a 5 one digit further
    can come out one too high: a double is either below that text, equal to it or above it, which exact integers decide. In the
    first case, and in the second where the digit before is even, the text without its 5 is right. Texts with an exponent
    (numbers under 0.001) are left as format_string has them.
    """
    text = F.abs(v).cast("string")
    half = text.rlike(rf"^\d+\.\d{{{digits}}}5$")
    a = F.abs(v)
    part = ((a - F.floor(a)) * float(2**62)).try_cast("bigint").cast("decimal(19, 0)") * F.lit(10 ** (digits + 1)).cast(f"decimal({digits + 2}, 0)")
    shown = F.substring_index(text, ".", -1).try_cast(f"decimal({digits + 1}, 0)") * F.lit(2**62).cast("decimal(19, 0)")
    even = F.substring(text, -2, 1).isin(*"02468")
    down = (part < shown) | ((part == shown) & even)
    cut = F.concat(F.when(v < 0, F.lit("-")).otherwise(""), F.substring(text, F.lit(1), F.length(text) - 1))
    return F.when(half & F.coalesce(down, F.lit(False)), cut).otherwise(F.format_string(f"%.{digits}f", v))

"""Rounding: of exact ratios, in any order of the rows behind them, and as Python's round() on doubles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def py_round(c: Column, digits: int = 2) -> Column:
    """round(x, digits) of the exact double, ties to even: 2.675 gives 2.67, where bround gives 2.68.

    bround differs only on ties that binary can't hold and stays in generated code; this is for strict parity."""

    @F.pandas_udf(DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    return rounded(c)


def exact_ratio(top: Column, bottom: Column, digits: int = 2) -> Column:
    """top / bottom of whole numbers, rounded to ``digits`` places on the exact ratio, ties to even; null for 0.

    Sums of whole numbers don't depend on the order of their rows, and no double is rounded before the
    end, so equal rows give equal means however they are dealt. Holds for tops below 10 ** (38 - digits)."""
    scaled = top.cast("decimal(38,0)") * F.lit(10**digits).cast("decimal(6,0)")
    over = F.when(bottom > 0, bottom).cast("decimal(20,0)")
    left = F.pmod(scaled, over)
    whole = ((scaled - left) / over).cast("decimal(38,0)")
    up = (2 * left > over) | ((2 * left == over) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / 10.0**digits


def fixed(c: Column, digits: int) -> Column:
    """A value that was rounded to ``digits`` places, as a whole number of its last place."""
    return F.rint(c * 10.0**digits).cast("long")


def exact_ratio_sql(top: str, bottom: str, digits: int = 2) -> str:
    """The same rule in the SQL of the twins."""
    n = f"(({top})::HUGEINT * {10**digits})"
    d = f"nullif({bottom}, 0)"
    return f"(({n} // {d}) + CASE WHEN 2 * ({n} % {d}) > {d} OR 2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / {10**digits}"


def fixed_sql(x: str, digits: int) -> str:
    return f"round_even({x} * {10**digits}, 0)::HUGEINT"

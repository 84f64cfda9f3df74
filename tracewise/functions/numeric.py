"""Exact numeric helpers.

``py_round_ratio`` reproduces Python's ``round(k / n, digits)`` bit for bit
with integer arithmetic: Python rounds the *binary* double to the nearest
decimal and breaks exact ties to even, while Spark's ``round`` is half-up on
the shortest decimal form and ``bround`` half-even on it; both differ from
Python on ties such as 1/16 or 1/80.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO63 = "9223372036854775808"


def py_round_ratio(k, n, digits: int = 3) -> Column:
    """round(k / n, digits) with Python semantics, for 0 <= k <= n, n > 0.

    q, r = divmod(10^d * k, n).  If 2r != n the rational k/n is not a
    decimal tie and the double k/n cannot cross the tie either (its error is
    below 1/(2*10^d*n) for any realistic n), so the comparison 2r vs n
    decides.  On a rational tie the double fl(k/n) is compared exactly with
    the tie (2q+1)/(2*10^d) through its integer image fl(k/n)*2^63.
    """
    k = k.cast("long") if isinstance(k, Column) else F.lit(k).cast("long")
    n = n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long")
    scale = 10 ** digits
    num = k * F.lit(scale)
    q = F.floor(num / n).cast("long")
    r = num - q * n
    d = k.cast("double") / n.cast("double")
    image = (d * F.lit(float(2 ** 63))).cast("long").cast("decimal(38,0)")
    lhs = image * F.lit(2 * scale).cast("decimal(38,0)")
    rhs = (q * 2 + 1).cast("decimal(38,0)") * F.expr(f"cast({_TWO63} as decimal(38,0))")
    tie_up = (F.when(lhs > rhs, F.lit(1))
              .when(lhs < rhs, F.lit(0))
              .otherwise(F.when(q % 2 == 0, F.lit(0)).otherwise(F.lit(1))))
    up = (F.when(2 * r < n, F.lit(0))
          .when(2 * r > n, F.lit(1))
          .otherwise(tie_up))
    return (q + up).cast("double") / F.lit(float(scale))


def py_round_ratio_sql(k: str, n: str, digits: int = 3) -> str:
    """The same rounding as DuckDB SQL text (used by the oracles)."""
    s = 10 ** digits
    q = f"(({k})::BIGINT * {s} // ({n})::BIGINT)"
    r = f"(({k})::BIGINT * {s} - {q} * ({n})::BIGINT)"
    img = f"(CAST((({k})::DOUBLE / ({n})::DOUBLE) * {float(2 ** 63)!r} AS HUGEINT))"
    tie = (f"CASE WHEN {img} * {2 * s} > (2 * {q} + 1)::HUGEINT * {_TWO63}::HUGEINT THEN 1 "
           f"WHEN {img} * {2 * s} < (2 * {q} + 1)::HUGEINT * {_TWO63}::HUGEINT THEN 0 "
           f"WHEN {q} % 2 = 0 THEN 0 ELSE 1 END")
    return (f"(({q} + CASE WHEN 2 * {r} < ({n}) THEN 0 WHEN 2 * {r} > ({n}) THEN 1 "
            f"ELSE {tie} END)::DOUBLE / {float(s)!r})")


def py_round(x, digits: int) -> Column:
    """Python's ``round(x, digits)`` for a double column: the correctly
    rounded decimal of the exact binary value (ties to even only when exact),
    via ``format_number`` (DecimalFormat, HALF_EVEN), read back as a double."""
    col = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.format_number(col.cast("double"), int(digits)), ",", "").cast("double")

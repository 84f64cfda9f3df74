"""Number formatting with Python's format-spec semantics.

Java's ``format_string`` rounds half-up on the shortest decimal form, Python
rounds the exact binary value (so ``'%.2f' % 0.125 == '0.12'``).  Report and
alert texts must read like the reference; ``fixed`` does it with JVM-side
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pystr(c) -> Column:
    """Python ``str(float)``.

    The cast gives the same shortest digits, but writes exponents from 1e7 on
    and below 1e-3, Python from 1e16 on and below 1e-4, with a sign and two digits.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    text, size = x.cast("string"), F.abs(x)
    large = F.regexp_replace(x.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    small = F.regexp_replace(x.cast("decimal(38,24)").cast("string"), r"0+$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    spelt = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e"),
                     F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""),
                     F.abs(power).cast("string"))
    return (F.when(~text.contains("E"), text).when((size >= 1e7) & (size < 1e16), large)
            .when((size >= 1e-4) & (size < 1e-3), small).otherwise(spelt))


def fixed(c, decimals: int, plus: bool = False, none_text: str | None = None,
          settle_digits: int | None = 9) -> Column:
    """Python's ``format(x, '.Nf')`` (``'+.Nf'`` with ``plus``) as a JVM-side
    expression.

    Java's ``%.Nf`` rounds the shortest decimal form half-up, which differs
    from Python at ties such as 53.405.  ``format_number`` goes through
    ``DecimalFormat`` with HALF_EVEN, which rounds on the exact binary value
    (ties to even only when exact) -- Python's rule; only its grouping
    commas are removed.  ``settle_digits`` first rounds away last-bit noise
    of sums and means so that both engines print the same digits.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    if settle_digits is not None:
        x = F.round(x, settle_digits)
    out = F.regexp_replace(F.format_number(x, int(decimals)), ",", "")
    if plus:
        out = F.when(out.startswith("-"), out).otherwise(F.concat(F.lit("+"), out))
    if none_text is not None:
        out = F.when(x.isNull(), F.lit(none_text)).otherwise(out)
    return out

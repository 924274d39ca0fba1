"""Scalar Column functions.

Each returns a ``Column`` built only from ``pyspark.sql.functions``, so it
stays inside whole-stage code generation and filters on it can still be
pushed below projections by Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_pad(c, width: int) -> Column:
    """Left-pad with zeros to ``width`` like Python ``str.zfill``.

    Unlike ``lpad`` it never truncates a longer value, and a leading sign
    stays first (``'-42'`` -> ``'-00042'``).  Null stays null.
    """
    s = _c(c).cast("string")
    sign = F.substring(s, 1, 1)
    has_sign = sign.isin("-", "+")
    body = F.substring(s, 2, 1 << 30)
    padded = F.when(has_sign, F.concat(sign, F.lpad(body, width - 1, "0"))) \
              .otherwise(F.lpad(s, width, "0"))
    return F.when(s.isNull(), F.lit(None).cast("string")) \
            .when(F.length(s) >= width, s) \
            .otherwise(padded)


def composite_key(cols: Sequence, widths: Sequence[int]) -> Column:
    """Concatenate zero-padded parts, e.g. Major(6) || Minor(4) -> PIN."""
    if len(cols) != len(widths):
        raise ValueError("cols and widths differ in length")
    return F.concat(*[zero_pad(c, w) for c, w in zip(cols, widths)])


def safe_ratio(num, den) -> Column:
    """``num / den`` as double; null when the divisor is zero or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def not_in_keep_null(c, values: Iterable) -> Column:
    """``c`` differs from every value; a null ``c`` is kept (pandas ``!=``)."""
    cond = F.lit(True)
    for v in values:
        cond = cond & ~_c(c).eqNullSafe(F.lit(v))
    return cond


def not_blank(c, sentinel: str = "  ") -> Column:
    """Value is not null and not the blank sentinel (two spaces by default)."""
    return _c(c).isNotNull() & (_c(c) != F.lit(sentinel))


def flag(c, true_value="Y") -> Column:
    """1 when the value equals ``true_value``; everything else, null too, 0."""
    return F.coalesce(_c(c) == F.lit(true_value), F.lit(False)).cast("int")


def bool_to_int(c) -> Column:
    """Boolean to 0/1 with null -> 0."""
    return F.coalesce(_c(c).cast("boolean"), F.lit(False)).cast("int")


def numeric_key_to_string(c) -> Column:
    """A key stored as a floating number (``7732500.0``) to ``'7732500'``."""
    return _c(c).cast("bigint").cast("string")


def nan_to_null(c) -> Column:
    """NaN -> null so that sorts put it with the nulls (pandas semantics)."""
    return F.when(F.isnan(_c(c)), F.lit(None)).otherwise(_c(c))


def epoch_seconds(c, ntz: bool = True) -> Column:
    """Seconds since 1970-01-01 00:00 as double.  For a wall-clock
    (``timestamp_ntz``) column the value is computed from its date and time
    parts, so it does not depend on the session time zone."""
    col = _c(c)
    if not ntz:
        return F.unix_micros(col.cast("timestamp")).cast("double") / F.lit(1_000_000.0)
    days = F.datediff(F.to_date(col), F.lit("1970-01-01").cast("date")).cast("double")
    return days * F.lit(86400.0) + F.hour(col) * F.lit(3600.0) + F.minute(col) * F.lit(60.0) \
        + F.date_part(F.lit("SECOND"), col).cast("double")


def run_stamp() -> Column:
    """Run stamp ``yyyyMMdd-HHmmss`` of the query start time."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")

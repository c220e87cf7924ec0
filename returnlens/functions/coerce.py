"""Numeric coercion as Column expressions (TR1, TR2 building blocks).

``to_double`` is the one coercion used everywhere.  It follows
"convert or give NULL" semantics per cell:

* numeric columns are cast to DOUBLE and NaN becomes NULL (Spark orders NaN
  above every number, so a NaN must never reach a comparison or a clip);
* booleans become 1.0 / 0.0;
* strings convert only when the trimmed text is a plain decimal or
  scientific literal, or an explicit infinity.  ``try_cast`` alone is too
  loose ('1d' and 'nan' parse in Spark), so a regex guards it;
* anything else (dates, binary, nested) is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)

_DECIMAL_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITY_TEXT = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def trimmed(c: Column) -> Column:
    """Text without the white space of ``\\s`` around it."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def text_to_double(c: Column) -> Column:
    """Strict text → DOUBLE; NULL when the text is not a number."""
    return (
        F.when(c.rlike(_DECIMAL_TEXT), trimmed(c).try_cast("double"))
        .when(c.rlike(_INFINITY_TEXT),
              F.when(trimmed(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def to_double(c: Column, dtype: T.DataType) -> Column:
    """Coerce one column of the given type to DOUBLE (NULL when not numeric)."""
    if is_numeric_type(dtype):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return text_to_double(c)
    return F.lit(None).cast("double")


def column_to_double(df, name: str) -> Column:
    """``to_double`` for a named column of ``df``."""
    return to_double(F.col(_quote(name)), df.schema[name].dataType)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    """A column reference that tolerates dots and spaces in the name."""
    return F.col(_quote(name))

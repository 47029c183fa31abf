"""Type families: which columns count as integer, numeric, string or date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FAMILIES: dict[str, tuple[type, ...]] = {
    "integer": (T.IntegralType,),
    "numeric": (T.NumericType,),
    "float": (T.NumericType,),
    "string": (T.StringType,),
    "categorical": (T.StringType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "boolean": (T.BooleanType,),
}


def in_family(data_type: T.DataType, family: str) -> bool:
    """True when ``data_type`` belongs to the named family."""
    return isinstance(data_type, FAMILIES[family])


def has_type(data_type: T.DataType, name: str) -> bool:
    """True when ``name`` is a family of the type or one of its exact Spark names."""
    if name in FAMILIES:
        return in_family(data_type, name)
    exact = (type(data_type).__name__, data_type.typeName(), data_type.simpleString())
    return name in exact


def columns_of(df: DataFrame, family: str) -> list[str]:
    """Names of the columns in a type family, in schema order."""
    return [f.name for f in df.schema.fields if in_family(f.dataType, family)]


def quoted(column: str) -> str:
    """A column name as one name, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def has_nan(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def wider(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type both sides are cast to before they are compared as join keys.

    Numbers go to the wider number (64-bit integers and floats meet as double, as in
    Spark's own rule), dates to the timestamp, and anything else meets as string.
    """
    if left == right:
        return left
    if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
        return _with_decimal(left, right)
    if type(left) in _WIDTH and type(right) in _WIDTH:
        picked = max(left, right, key=lambda t: _WIDTH.index(type(t)))
        mixed = isinstance(left, T.IntegralType) != isinstance(right, T.IntegralType)
        return T.DoubleType() if mixed else picked
    if in_family(left, "date") and in_family(right, "date"):
        return left if isinstance(right, T.DateType) else right
    return T.StringType()


_DECIMAL_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def _with_decimal(left: T.DataType, right: T.DataType) -> T.DataType:
    def shape(t: T.DataType) -> tuple[int, int] | None:
        if isinstance(t, T.DecimalType):
            return t.precision - t.scale, t.scale
        digits = _DECIMAL_DIGITS.get(type(t))
        return (digits, 0) if digits else None

    shapes = shape(left), shape(right)
    if None in shapes:
        both_numeric = in_family(left, "numeric") and in_family(right, "numeric")
        return T.DoubleType() if both_numeric else T.StringType()
    whole = max(s[0] for s in shapes)
    scale = max(s[1] for s in shapes)
    return T.DecimalType(min(whole + scale, 38), scale) if whole + scale <= 38 else T.StringType()

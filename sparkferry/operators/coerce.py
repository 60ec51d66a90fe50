"""Values made fit for the destination's column types, as expressions that Spark compiles into the scan's stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.functions.definitions import FALSE, TRUE
from sparkferry.functions.types import normalize

#: Spellings of true and false in values: those of defaults but "y" and "n".
#: White space of any kind at either end.
BLANKS = r"(?U)^\s+|\s+$"
TRUE_TEXT, FALSE_TEXT = tuple(x for x in TRUE if x != "y"), tuple(x for x in FALSE if x != "n")


def to_boolean(value: Column, kind: T.DataType) -> Column:
    """A boolean for a PostgreSQL boolean column: integers and six-decimal numbers are true if they are 1, text by its spelling.

    Null stays null; text without a meaning becomes null (`unfit` finds it).
    """
    if isinstance(kind, T.BooleanType):
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.round(value.cast("double"), 6) == 1.0
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return value == 1
    if isinstance(kind, T.StringType):
        text = F.lower(F.regexp_replace(value, BLANKS, ""))
        return F.when(text.isin(*TRUE_TEXT), F.lit(True)).when(text.isin(*FALSE_TEXT), F.lit(False))
    return value.try_cast("boolean")


def to_tinyint(value: Column, kind: T.DataType) -> Column:
    """1 or 0 for a MySQL tinyint column from a boolean; other values as they are."""
    return F.when(value, F.lit(1)).when(~value, F.lit(0)).cast("tinyint") if isinstance(kind, T.BooleanType) else value


def _coerced(df: DataFrame, name: str, type_: str, dialect: str) -> Column:
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if dialect == "postgres" and normalize(type_) == "bool":
        return to_boolean(column, kind)
    if dialect == "mysql" and normalize(type_) == "tinyint":
        return to_tinyint(column, kind)
    return column


def coerce(df: DataFrame, types: dict[str, str], dialect: str) -> DataFrame:
    """df with the columns of `types` (name to the destination's type) made fit; other columns, and SQLite destinations, stay."""
    return df.select(*[_coerced(df, c, types[c], dialect).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def _loses(df: DataFrame, types: dict[str, str], dialect: str) -> list[Column]:
    """For each column that may lose a value, whether a row does. Only text can be unfit for a boolean; numbers always have an answer."""
    out = []
    for c in df.columns:
        if c in types and dialect == "postgres" and normalize(types[c]) == "bool" and not isinstance(df.schema[c].dataType, (T.BooleanType, T.NumericType)):
            out.append(F.col(f"`{c}`").isNotNull() & _coerced(df, c, types[c], dialect).isNull())
    return out


def may_lose(df: DataFrame, types: dict[str, str], dialect: str) -> bool:
    """Whether `coerce` can lose a value at all, by the types."""
    return bool(_loses(df, types, dialect))


def unfit(df: DataFrame, types: dict[str, str], dialect: str) -> DataFrame:
    """The rows that lose a value in `coerce`: a value that was not null becomes null."""
    return df.where(reduce(Column.__or__, _loses(df, types, dialect), F.lit(False)))


def fit(df: DataFrame, types: dict[str, str], dialect: str) -> DataFrame:
    """The other rows."""
    return df.where(~reduce(Column.__or__, _loses(df, types, dialect), F.lit(False)))

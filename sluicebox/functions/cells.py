"""Tests and conversions of raw string cells. A missing cell is NULL; `blank_to_null` makes it so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as an integer, a number, a truth value, an identifier and a moment in a raw cell.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
ENDLESS = r"^[+-]?infinity$"
TRUTH = ("true", "false", "yes", "no")
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_:\-]*$"
MOMENTS = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d H:m:s")


def blank_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with empty strings as NULL in the given string columns, or in all of them."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in names})


def is_integer(cell: Column) -> Column:
    return F.trim(cell).rlike(INTEGER)


def is_number(cell: Column) -> Column:
    """Numbers in the usual notations, and the word infinity; not inf and nan."""
    return F.trim(cell).rlike(NUMBER) | F.lower(F.trim(cell)).rlike(ENDLESS)


def is_truth(cell: Column) -> Column:
    return F.lower(F.trim(cell)).isin(*TRUTH)


def is_moment(cell: Column) -> Column:
    """Whether a cell is a date, or a date and time, in one of four formats."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(cell), F.lit(f)) for f in MOMENTS]).isNotNull()


def is_identifier(cell: Column) -> Column:
    return F.trim(cell).rlike(IDENTIFIER)


def number(cell: Column) -> Column:
    """The number in a raw cell; NULL if there is none."""
    plain = F.regexp_replace(F.trim(cell), "_", "")
    return F.when(F.trim(cell).rlike(NUMBER), plain.try_cast("double"))


def numbers(df: DataFrame, columns: list[str]) -> Column:
    """The numbers in cells of many columns, as one array; NULL where a cell holds none.

    One expression for any number of columns: generated code of one for each column outgrows what the JVM compiles.
    """
    types = dict(df.dtypes)
    if all(types[c] in ("tinyint", "smallint", "int", "bigint", "double") for c in columns):
        finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        return F.transform(F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>"), finite)
    return F.transform(F.array(*[F.col(c).cast("string") for c in columns]), number)


def format_number(x: Column) -> Column:
    """A whole number without a point, else up to six decimals without trailing zeros."""
    text = F.format_string("%.6f", x)
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def format_decimal(x: Column) -> Column:
    """A decimal as text: whole numbers without a point, others without trailing zeros, never with an exponent."""
    # The cast gives an exponent for very small numbers; format_number with all digits does not.
    text = F.regexp_replace(F.format_number(x, 38), ",", "")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0").otherwise(trimmed)


def slug(text: Column) -> Column:
    """Lower case, with runs of anything but letters and digits as one underscore."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """`x` within bounds; a NaN is the lower one."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.when(F.isnan(x), F.lit(low)).otherwise(x)))

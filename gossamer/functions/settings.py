"""Settings given as text: flags, whole numbers and numbers with a least value, each with why it is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the words that a flag may be
TRUE = ("1", "true", "yes", "on")
FALSE = ("0", "false", "no", "off")


def _read(value: Column, got: Column, default: Column, error: Column) -> Column:
    return F.struct(F.when(value.isNull(), default).when(error.isNull(), got).alias("value"), F.when(value.isNotNull(), error).alias("error"))


def flag(name: Column, value: Column, default: Column) -> Column:
    """value (boolean, the default where none is given) and error; case and blanks around a word don't matter."""
    word = F.lower(F.trim(value))
    got = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    return _read(value, got, default, F.when(got.isNull(), F.concat(name, F.lit(" must be a boolean value"))))


def _bounded(name: Column, value: Column, default: Column, least: Column, got: Column, kind: str) -> Column:
    error = F.when(got.isNull(), F.concat(name, F.lit(f" must be {kind}"))).when(got < least, F.concat(name, F.lit(" must be >= "), least.cast("string")))
    return _read(value, got, default, error)


def whole(name: Column, value: Column, default: Column, least: Column) -> Column:
    """value (long) and error; digits may be grouped by single underscores."""
    text = F.when(value.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.replace(F.trim(value), F.lit("_"), F.lit("")))
    return _bounded(name, value, default, least, text.try_cast("bigint"), "an integer")


def number(name: Column, value: Column, default: Column, least: Column) -> Column:
    """value (double) and error."""
    text = F.when(value.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(value))
    return _bounded(name, value, default, least, text.try_cast("double"), "a number")

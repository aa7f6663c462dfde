"""Typed reads from ``variant`` values with the library's JSON coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def leaf(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return kind(value).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(.*\))$")


def string_at(value: Column, path: str) -> Column:
    """The value at ``path`` when it is a JSON string, else null."""
    found = leaf(value, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def array_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def text_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), text).try_cast("double")


def number_at(value: Column, path: str) -> Column:
    """JSON number or numeric string as double; booleans are not numbers."""
    found = leaf(value, path)
    return (
        F.when(is_number(found), F.try_variant_get(found, "$", "double"))
        .when(kind(found) == "STRING", text_number(F.try_variant_get(found, "$", "string"))))


def whole_at(value: Column, path: str) -> Column:
    """JSON number or numeric string rounded half away from zero."""
    found = leaf(value, path)
    exact = F.when(kind(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))
    return F.coalesce(exact, F.round(number_at(value, path)).try_cast("bigint"))


def milliseconds_at(value: Column, path: str) -> Column:
    """Seconds at ``path`` as rounded milliseconds."""
    return F.round(number_at(value, path) * 1000).try_cast("bigint")


def clock_ms(text: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` with comma or dot decimals, as milliseconds."""
    parts = F.transform(F.split(F.regexp_replace(text, ",", "."), ":"), text_number)
    n = F.size(parts)
    seconds = (
        F.when(n == 2, F.get(parts, 0) * 60 + F.get(parts, 1))
        .when(n == 3, F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2)))
    return F.round(seconds * 1000).try_cast("bigint")

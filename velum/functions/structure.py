"""Structural equality: one form for all values that are equal, so that values of any type can be compared and grouped.

Spark's ``<=>`` takes neither maps nor variants, and JSON texts that say the same may be spelled in many ways. The form of
a map is its entries in the order of their keys, at any depth of structs, arrays and maps; that of a variant or of a JSON
text is its text with sorted keys, without spaces, and with numbers and strings spelled in one way. All of it is Column
code inside the projection.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

from velum.functions.jsontext import accepted_sql
from velum.functions.regex import given

#: A string, a number, or what stands between them; possessive, as strings may be long.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]+'


def _number(token: Column) -> Column:
    """A JSON number's one spelling: whole ones below 2^53 as digits, others as the nearest double is written."""
    value = token.try_cast("double")
    whole = (F.abs(value) < 2.0**53) & (F.rint(value) == value)
    return F.when(token.rlike("^-?[0-9]"), F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))).otherwise(token)


def json_form(text: Column) -> Column:
    """The one spelling of a JSON text. Keys are sorted at every depth; 1, 1.0 and 1e0 are one number, as numbers are
    doubles; escapes that need not be are resolved. Texts that aren't JSON, that have a key twice in one object, or that
    are nested over a thousand deep are their own form. Null for null."""
    whole = given(text, f"CASE WHEN {accepted_sql('t')} THEN t END")
    sorted_ = F.to_json(F.try_parse_json(whole))
    return F.coalesce(F.array_join(F.transform(F.regexp_extract_all(sorted_, F.lit(_TOKEN), F.lit(0)), _number), ""), text)


def is_plain(kind: DataType) -> bool:
    """Whether ``<=>`` compares values of this type as they are."""
    if isinstance(kind, StructType):
        return all(is_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return is_plain(kind.elementType)
    return not isinstance(kind, MapType | VariantType)


def form(value: Column, kind: DataType, json: Collection[str] = ()) -> Column:
    """The form of ``value``, of type ``kind``: equal for equal values, comparable, and fit for grouping and sorting.
    ``json`` names fields of a struct that hold JSON text. Null for null."""
    if isinstance(kind, StructType) and (json or not is_plain(kind)):
        fields = [json_form(value[f.name]) if f.name in json and isinstance(f.dataType, StringType) else form(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(fields, kind.fields, strict=True)]))
    if isinstance(kind, VariantType):
        return json_form(F.to_json(value))
    if is_plain(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: form(x, kind.elementType))
    entry = lambda e: F.struct(form(e["key"], kind.keyType).alias("key"), form(e["value"], kind.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(value), entry))


def same(x: Column, y: Column, kind: DataType) -> Column:
    """Whether two values of type ``kind`` are equal, whatever the order of their maps' entries. Null equals null."""
    return form(x, kind).eqNullSafe(form(y, kind))


__all__ = ["form", "is_plain", "json_form", "same"]

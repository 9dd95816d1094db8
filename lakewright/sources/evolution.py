"""Schema evolution: the least type that holds two, and columns read as it.

The order of types, each holding those left of it without loss::

    void < byte < short < int < long < decimal < string
                        int < double           < string
                      float < double           < string
                date < timestamp (with or without zone) < string
             boolean, binary, arrays, maps, structs      < string

Numbers that a double cannot hold exactly (long, decimal) meet floats in string only.  Arrays, maps and
structs widen inside; a struct takes the fields of both.  A nested value becomes JSON where its column is text,
binary becomes base64.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Decimal digits of whole types.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds every value of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = (type(a), type(b))
    if all(k in _WHOLE for k in kinds):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if all(k in _WHOLE or k is T.DecimalType for k in kinds):
        return _decimal(a, b)
    if all(k in (*_WHOLE[:3], T.FloatType, T.DoubleType) for k in kinds):
        return T.DoubleType()
    if set(kinds) in ({T.DateType, T.TimestampType}, {T.DateType, T.TimestampNTZType}):
        return b if isinstance(a, T.DateType) else a
    if kinds == (T.ArrayType, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if kinds == (T.MapType, T.MapType):
        return T.MapType(widest(a.keyType, b.keyType), widest(a.valueType, b.valueType), a.valueContainsNull or b.valueContainsNull)
    if kinds == (T.StructType, T.StructType):
        return widened(a, b)
    return T.StringType()


def _decimal(a: T.DataType, b: T.DataType) -> T.DataType:
    parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[type(t)], 0) for t in (a, b)]
    whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()


def widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """old with every column of new; names that differ in case alone are one column."""
    more = {f.name.lower(): f for f in new.fields}
    fields = [T.StructField(f.name, widest(f.dataType, more[f.name.lower()].dataType) if f.name.lower() in more else f.dataType, True) for f in old.fields]
    had = {f.name.lower() for f in old.fields}
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for k, f in more.items() if k not in had])


def adapted(value: Column, had: T.DataType, wanted: T.DataType) -> Column:
    """A value of one type as another that holds it."""
    if _plain(had) == _plain(wanted):
        return value
    if isinstance(wanted, T.StringType):
        return F.to_json(value) if isinstance(had, _NESTED) else F.base64(value) if isinstance(had, T.BinaryType) else value.cast("string")
    if isinstance(had, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: adapted(x, had.elementType, wanted.elementType))
    if isinstance(had, T.MapType) and isinstance(wanted, T.MapType):
        keyed = F.transform_keys(value, lambda k, _: adapted(k, had.keyType, wanted.keyType))
        return F.transform_values(keyed, lambda _, v: adapted(v, had.valueType, wanted.valueType))
    if isinstance(had, T.StructType) and isinstance(wanted, T.StructType):
        fields = {f.name.lower(): f for f in had.fields}
        inner = [adapted(value[fields[f.name.lower()].name], fields[f.name.lower()].dataType, f.dataType).alias(f.name) if f.name.lower() in fields else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    return value.cast(wanted)


def read_as(had: T.StructType, wanted: T.StructType) -> list[Column]:
    """The columns of a frame of one schema as those of a wider one; what it lacks is null."""
    fields = {f.name.lower(): f for f in had.fields}
    out = []
    for f in wanted.fields:
        own = fields.get(f.name.lower())
        out.append((F.lit(None).cast(f.dataType) if own is None else adapted(F.col(f"`{own.name}`"), own.dataType, f.dataType)).alias(f.name))
    return out


def _plain(kind: T.DataType) -> str:
    return kind.simpleString()


def changes(old: T.StructType, new: T.StructType) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """(columns only new has, columns only old has, ``name: old type > new type`` of the others), each sorted."""
    a, b = ({f.name.lower(): f for f in s.fields} for s in (old, new))
    names = lambda keys, of: tuple(sorted(of[k].name for k in keys))
    kinds = (f"{a[k].name}: {_plain(a[k].dataType)} > {_plain(b[k].dataType)}" for k in a.keys() & b.keys() if _plain(a[k].dataType) != _plain(b[k].dataType))
    return names(b.keys() - a.keys(), b), names(a.keys() - b.keys(), a), tuple(sorted(kinds))


def all_widened(schemas: Iterable[T.StructType]) -> T.StructType:
    out = T.StructType([])
    for s in schemas:
        out = widened(out, s)
    return out

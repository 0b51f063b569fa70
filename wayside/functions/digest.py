"""A fixed-size stand-in for a whole row, for counting and comparing wide rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def _plain(x: Column, kind: T.DataType) -> Column:
    """A value whose JSON tells it from others: instants as microseconds, maps in key order."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    if isinstance(kind, T.StructType):
        fields = [_plain(x.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _plain(v, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType, False),
                              T.StructField("value", kind.valueType)])
        return F.array_sort(F.transform(F.map_entries(x), lambda v: _plain(v, entry)))
    return x


def _text(name: str, kind: T.DataType) -> Column:
    """The value as text, different for different values (0.0 and -0.0 are equal)."""
    x = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("string")
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (x + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(x)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(x.isNotNull(), F.to_json(F.struct(_plain(x, kind).alias("v"))))
    return x.cast("string")


def row_digest(fields) -> Column:
    """SHA-256 (32 bytes) over all fields, each with its length in front so that neither
    nulls nor separators inside a value can make two rows look alike."""
    parts = []
    for field in fields:
        text = _text(field.name, field.dataType)
        measured = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(measured, F.lit("n")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))

"""Names of types as sources give them, and Spark's types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SIMPLE: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "HUGEINT": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "BLOB": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMPTZ": T.TimestampType(), "UUID": T.StringType(), "INTERVAL": T.DayTimeIntervalType(),
    "INT": T.IntegerType(), "TEXT": T.StringType(), "STRING": T.StringType(), "REAL": T.FloatType(),
}
if hasattr(T, "TimeType"):
    SIMPLE["TIME"] = T.TimeType()
#: Where two names share a Spark type, the first one is written.
NAMES = {v: k for k, v in reversed(SIMPLE.items())}
#: Types that Spark lacks, and the narrowest that holds them: a source has their rules, so they are read and not named again.
SIMPLE |= {"UTINYINT": T.ShortType(), "USMALLINT": T.IntegerType(), "UINTEGER": T.LongType(), "UBIGINT": T.DecimalType(20, 0)}


def to_spark(name: str) -> T.DataType:
    """DECIMAL(p,s), T[] and STRUCT(a T, ...) and MAP(K, V) nest; precision is 38 at most."""
    text = name.strip()
    if text.endswith("[]"):
        return T.ArrayType(to_spark(text[:-2]))
    if m := re.fullmatch(r"(?i)DECIMAL\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", text):
        return T.DecimalType(int(m[1]), int(m[2]))
    if re.fullmatch(r"(?is)ENUM\s*\(.*\)|VARCHAR\s*\(\s*\d+\s*\)", text):
        return T.StringType()
    if m := re.fullmatch(r"(?is)STRUCT\s*\((.*)\)", text):
        fields = [part.strip().split(None, 1) for part in split(m[1])]
        return T.StructType([T.StructField(n.strip('"'), to_spark(t)) for n, t in fields])
    if m := re.fullmatch(r"(?is)MAP\s*\((.*)\)", text):
        key, value = split(m[1])
        return T.MapType(to_spark(key), to_spark(value))
    if (found := SIMPLE.get(text.upper())) is None:
        raise ValueError(f"no Spark type stands for {name}")
    return found


def split(text: str) -> list[str]:
    """Parts between the commas that lie outside parentheses."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def to_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return to_name(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {to_name(f.dataType)}" for f in kind.fields) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({to_name(kind.keyType)}, {to_name(kind.valueType)})"
    if kind in NAMES:
        return NAMES[kind]
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    raise ValueError(f"no source type stands for {kind.simpleString()}")

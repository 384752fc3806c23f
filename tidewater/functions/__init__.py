"""Scalar functions under the names that sources know, with their meaning there, as Spark expressions.

`call(name, *args)` builds the expression; `CATEGORIES` is the whole named set by category. A name that is not in it is
passed through to Spark as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b in double precision: by zero it is an infinity or not a number, not an error."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(x.isNull() | F.isnan(x) | (x == 0), F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(F.signum(x) * F.lit(INF))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def divide_int(a: Column, b: Column) -> Column:
    """The quotient cut to an integer; null when b is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def round_double(x: Column, digits: int = 0) -> Column:
    """x in double precision, scaled, rounded half away from zero and scaled back, as sources round doubles. F.round goes by
    x's decimals: 1.005 to two digits is 1.01 there and 1.0 here. Where scaling overflows, x stays; to more digits before the
    point than a double has, it is 0."""
    x, by = x.cast("double"), F.lit(float(f"1e{abs(digits)}"))
    scaled = x / by if digits < 0 else x * by
    even = F.rint(scaled)
    whole = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even)
    back = whole * by if digits < 0 else whole / by
    return F.when(F.abs(back) < INF, back).otherwise(F.when(is_finite(x), F.lit(0.0)).otherwise(x) if digits < -308 else x)


def concat(*args: Column) -> Column:
    """Null arguments are skipped."""
    return F.concat_ws("", *[a.cast("string") for a in args])


def is_finite(x: Column) -> Column:
    return F.when(x.isNotNull(), ~F.isnan(x) & (F.abs(x) != F.lit(INF)))


def is_infinite(x: Column) -> Column:
    return F.when(x.isNotNull(), F.abs(x) == F.lit(INF))


def extract(part: str, x: Column) -> Column:
    return F.date_part(F.lit(part), x).cast("bigint")


def struct_pack(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def list_extract(x: Column, i: Column) -> Column:
    """1-based; null beyond the ends."""
    return F.when(i != 0, F.try_element_at(x, i.cast("int")))


CATEGORIES: dict[str, dict[str, Callable[..., Column]]] = {
    "arithmetic": {
        "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divide,
        "divide_int": divide_int,
        "modulus": lambda a, b: a % b, "negate": lambda a: -a, "abs": F.abs, "sqrt": F.sqrt, "power": F.pow, "exp": F.exp, "ln": F.ln,
    },
    "rounding": {"floor": lambda a: F.floor(a).cast("double"), "ceil": lambda a: F.ceil(a).cast("double"), "round": F.round},
    "bitwise": {"bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b)},
    "comparison": {
        "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
        "is_null": lambda a: a.isNull(), "is_not_null": lambda a: a.isNotNull(), "is_nan": F.isnan, "is_finite": is_finite, "is_infinite": is_infinite, "coalesce": F.coalesce,
        "is_distinct_from": lambda a, b: ~a.eqNullSafe(b), "is_not_distinct_from": lambda a, b: a.eqNullSafe(b),
    },
    "boolean": {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a},
    "string": {
        "like": lambda a, p: F.like(a, p), "not_like": lambda a, p: ~F.like(a, p), "ilike": lambda a, p: F.ilike(a, p), "not_ilike": lambda a, p: ~F.ilike(a, p),
        "substring": F.substring, "char_length": lambda a: F.char_length(a).cast("bigint"), "octet_length": lambda a: F.octet_length(a).cast("bigint"), "starts_with": F.startswith, "ends_with": F.endswith,
        "concat": concat, "lower": F.lower, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "replace": F.replace, "contains": F.contains,
    },
    "datetime": {"extract": extract},
    "list": {"list_position": lambda x, v: F.array_position(x, v), "list_extract": list_extract, "unnest": F.explode, "struct_pack": struct_pack},
}

NAMED = {name: build for group in CATEGORIES.values() for name, build in group.items()}


def call(name: str, *args: Column, **named: Column) -> Column:
    if name in NAMED:
        return NAMED[name](*args, **named)
    return F.call_function(name, *args)

"""Tagged property values and their total order, as Spark expressions.

A value is a struct with a tag and one filled field. Values of different kinds are ordered boolean < number < string;
integers and doubles compare by exact value, -0.0 equals 0.0, and NaN equals itself above all numbers. Null, bytes and
lists have no order and match no predicate. Comparisons are to literals, whose bounds are rewritten per field here, so
that what reaches a scan is a plain comparison of a column to a constant.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, BOOL, INT, DOUBLE, STRING, BYTES, LIST = range(7)
ITEM = "struct<tag:tinyint,b:boolean,i:bigint,d:double,s:string>"
VALUE = f"struct<tag:tinyint,b:boolean,i:bigint,d:double,s:string,x:binary,l:array<{ITEM}>>"
PROPS = f"map<string,{VALUE}>"
_FIELDS = {BOOL: "b", INT: "i", DOUBLE: "d", STRING: "s", BYTES: "x", LIST: "l"}
_TYPES = {"b": "boolean", "i": "bigint", "d": "double", "s": "string", "x": "binary", "l": f"array<{ITEM}>"}


def tag_of(value: Any) -> int:
    if value is None:
        return NULL
    for kind, tag in ((bool, BOOL), (int, INT), (float, DOUBLE), (str, STRING), (bytes, BYTES), (list, LIST), (tuple, LIST)):
        if isinstance(value, kind):
            return tag
    raise TypeError(f"not a property value: {value!r}")


def tagged(tag: int, value: Column | None = None) -> Column:
    """A value struct with the field of tag filled."""
    fields = [F.lit(tag).cast("tinyint").alias("tag")]
    fields += [(value if _FIELDS.get(tag) == f and value is not None else F.lit(None)).cast(t).alias(f) for f, t in _TYPES.items()]
    return F.struct(*fields)


def literal(value: Any) -> Column:
    """A property value from a Python value; lists hold scalars only."""
    tag = tag_of(value)
    if tag == LIST:
        items = [F.struct(*[(F.lit(tag_of(v)) if f == "tag" else F.lit(v) if _FIELDS.get(tag_of(v)) == f else F.lit(None)).cast(t).alias(f) for f, t in [("tag", "tinyint"), *list(_TYPES.items())[:4]]]) for v in value]
        return tagged(tag, F.array(*items).cast(f"array<{ITEM}>"))
    return tagged(tag, None if value is None else F.lit(bytearray(value) if tag == BYTES else value))


def props(**values: Column) -> Column:
    """A property map from tagged columns."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]) if values else F.create_map().cast(PROPS)


def is_scalar(v: Column) -> Column:
    return v["tag"].isin(BOOL, INT, DOUBLE, STRING)


def _int_least(bound: float | int) -> int | None:
    """Smallest integer at or above bound; None if there is none."""
    if isinstance(bound, int):
        return bound
    if math.isnan(bound) or bound == math.inf:
        return None
    return -(2**63) if bound == -math.inf else math.ceil(bound)


def _int_most(bound: float | int) -> int:
    if isinstance(bound, int):
        return bound
    if math.isnan(bound) or bound == math.inf:
        return 2**63 - 1
    return -(2**63) - 1 if bound == -math.inf else math.floor(bound)


def at_least(v: Column, bound: Any) -> Column:
    """v >= bound in the total order."""
    tag = tag_of(bound)
    if tag == BOOL:
        return ((v["tag"] == BOOL) & (v["b"] >= F.lit(bound))) | v["tag"].isin(INT, DOUBLE, STRING)
    if tag == STRING:
        return (v["tag"] == STRING) & (v["s"] >= F.lit(bound))
    least = _int_least(bound)
    ints = F.lit(False) if least is None or least > 2**63 - 1 else v["i"] >= F.lit(max(least, -(2**63)))
    f = float(bound)
    doubles = v["d"] > F.lit(f) if isinstance(bound, int) and int(f) < bound else v["d"] >= F.lit(f)
    return ((v["tag"] == INT) & ints) | ((v["tag"] == DOUBLE) & doubles) | (v["tag"] == STRING)


def at_most(v: Column, bound: Any) -> Column:
    """v <= bound in the total order."""
    tag = tag_of(bound)
    if tag == BOOL:
        return (v["tag"] == BOOL) & (v["b"] <= F.lit(bound))
    if tag == STRING:
        return v["tag"].isin(BOOL, INT, DOUBLE) | ((v["tag"] == STRING) & (v["s"] <= F.lit(bound)))
    most = _int_most(bound)
    ints = F.lit(False) if most < -(2**63) else v["i"] <= F.lit(min(most, 2**63 - 1))
    f = float(bound)
    doubles = v["d"] < F.lit(f) if isinstance(bound, int) and int(f) > bound else v["d"] <= F.lit(f)
    return (v["tag"] == BOOL) | ((v["tag"] == INT) & ints) | ((v["tag"] == DOUBLE) & doubles)


def matches(v: Column, eq: Any = None, least: Any = None, most: Any = None) -> Column:
    """Equality (eq given) or an inclusive range with either bound open; scalars only, never null."""
    tests = [is_scalar(v)]
    if eq is not None:
        least = most = eq
    if least is not None:
        tests.append(at_least(v, least))
    if most is not None:
        tests.append(at_most(v, most))
    return reduce(lambda a, b: a & b, tests)


def as_float(v: Column) -> Column:
    """Number or boolean as 32-bit float; null for other kinds."""
    return F.when(v["tag"] == INT, v["i"].cast("float")).when(v["tag"] == DOUBLE, v["d"].cast("float")).when(v["tag"] == BOOL, v["b"].cast("float"))


def merge(old: Column, changes: dict[str, Any], removed: set[str]) -> Column:
    """A property map with values set (null is a value) and keys removed."""
    keep = F.map_filter(old, lambda k, _: ~k.isin(*changes, *removed)) if changes or removed else old
    return F.map_concat(keep, F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), literal(v))]).cast(PROPS)) if changes else keep

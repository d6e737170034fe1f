"""The metadata filter language as boolean columns.

A filter maps top-level fields to a bare value or to operators; all must hold. Comparison is
strict: a number equals numbers only, a string strings only, a boolean booleans only. A record
without metadata passes no filter, not even the empty one. A field that is missing passes $ne and
$nin. Anything that is neither a scalar nor a known set of operators matches nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin")
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def field(metadata: Column, name: str) -> tuple[Column, Column]:
    """A field of variant metadata, and the name of its type (null where it is missing)."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    v = F.try_variant_get(metadata, f'$["{quoted}"]', "variant")
    return v, F.schema_of_variant(v)


def is_operators(condition: object) -> bool:
    return isinstance(condition, Mapping) and len(condition) > 0 and all(k in OPERATORS for k in condition)


def equals(v: Column, kind: Column, value: object) -> Column:
    """Strict equality with a scalar: of type and of value; never null."""
    if value is None:
        hit = kind == "VOID"
    elif isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    elif isinstance(value, (int, float)):
        hit = kind.rlike(NUMBER) & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    elif isinstance(value, str):
        hit = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def operator(v: Column, kind: Column, op: str, value: object) -> Column:
    if op == "$eq":
        return equals(v, kind, value)
    if op == "$ne":
        return ~equals(v, kind, value)
    if op in ("$in", "$nin"):
        found = reduce(lambda a, b: a | b, [equals(v, kind, x) for x in value], F.lit(False))
        return found if op == "$in" else ~found
    number = F.when(kind.rlike(NUMBER), F.try_variant_get(v, "$", "double"))
    bound = F.lit(float(value))
    hit = {"$gt": number > bound, "$gte": number >= bound, "$lt": number < bound, "$lte": number <= bound}[op]
    return F.coalesce(hit, F.lit(False))


def matches(metadata: Column, condition: Mapping[str, object]) -> Column:
    """Whether variant metadata passes a filter."""
    parts = [metadata.isNotNull()]
    for name, wanted in condition.items():
        v, kind = field(metadata, name)
        if is_operators(wanted):
            parts += [operator(v, kind, op, x) for op, x in wanted.items()]
        else:
            parts.append(equals(v, kind, wanted))
    return reduce(lambda a, b: a & b, parts)

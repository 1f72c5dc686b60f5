"""The JSON filter language, compiled to a Spark predicate.

``{"field": value}`` is equality; operators are $eq $ne $in $nin $gt $gte $lt $lte $exists; $and and $or nest.
A missing value passes $ne, $nin and {"$exists": false} only. For list fields $ne and $nin ask all
elements, the others any. Every leaf is true or false, never null, so pushed-down parts stay two-valued.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDER = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def _comparable(kind: T.DataType, arg: Any) -> bool:
    if isinstance(arg, bool) or isinstance(kind, T.BooleanType):
        return isinstance(arg, bool) and isinstance(kind, T.BooleanType)
    return isinstance(kind, T.NumericType) if isinstance(arg, (int, float)) else isinstance(kind, T.StringType) == isinstance(arg, str)


def _leaf(column: Column, kind: T.DataType, op: str, arg: Any) -> Column:
    listed = isinstance(kind, T.ArrayType)
    inner = kind.elementType if listed else kind
    if op == "$exists":
        return column.isNotNull() if arg else column.isNull()
    if op in ("$eq", "$in"):
        args = [a for a in (arg if op == "$in" else [arg]) if _comparable(inner, a)]
        test = (lambda x: x.isin(*args)) if args else (lambda x: F.lit(False))
        return F.coalesce(F.exists(column, test) if listed else test(column), F.lit(False))
    if op in ("$ne", "$nin"):
        args = [a for a in (arg if op == "$nin" else [arg]) if _comparable(inner, a)]
        test = (lambda x: ~x.isin(*args)) if args else (lambda x: F.lit(True))
        return F.coalesce(F.forall(column, test) if listed else test(column), F.lit(True))
    if op in _ORDER:
        if not _comparable(inner, arg):
            return F.lit(False)
        test = lambda x: getattr(x, _ORDER[op])(F.lit(arg))
        return F.coalesce(F.exists(column, test) if listed else test(column), F.lit(False))
    raise ValueError(f"unsupported filter operator {op}")


def compile_filter(spec: dict | None, schema: T.StructType) -> Column:
    """The predicate of ``spec`` on rows of ``schema``; fields that the schema lacks are missing values."""
    if not spec:
        return F.lit(True)
    kinds = {f.name: f.dataType for f in schema}
    parts = []
    for name, wanted in spec.items():
        if name in ("$and", "$or"):
            inner = [compile_filter(x, schema) for x in wanted]
            parts.append(reduce(lambda a, b: a & b if name == "$and" else a | b, inner, F.lit(name == "$and")) if inner else F.lit(name == "$and"))
            continue
        for op, arg in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            if name in kinds:
                parts.append(_leaf(F.col(name), kinds[name], op, arg))
            elif op in ("$ne", "$nin", "$exists") or op in ("$eq", "$in", *_ORDER):
                parts.append(F.lit(op in ("$ne", "$nin") or op == "$exists" and not arg))
            else:
                raise ValueError(f"unsupported filter operator {op}")
    return reduce(lambda a, b: a & b, parts)


def apply_filter(df: DataFrame, spec: dict | None) -> DataFrame:
    return df.where(compile_filter(spec, df.schema)) if spec else df


def all_of(*specs: dict | None) -> dict | None:
    parts = [s for s in specs if s]
    return {"$and": parts} if len(parts) > 1 else parts[0] if parts else None

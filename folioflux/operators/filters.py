"""Metadata filters: a Mongo-shaped mapping compiled to one boolean Column that is never null.

A filter applies to rows of chunks joined with their documents: columns chunk_id, doc_id,
ordinal, source_uri, and chunk_meta and doc_meta as VARIANT. A chunk's value goes before
its document's; a JSON null counts as missing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.errors import ConfigError

COLUMNS = {"chunk_id": str, "doc_id": str, "source_uri": str, "ordinal": int}
COMPARED = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


class Value:
    """A resolved value: present, as a number (booleans count 0 and 1) and as a string."""

    def __init__(self, present: Column, number: Column | None, string: Column | None):
        self.present, self.number, self.string = present, number, string

    def like(self, operand) -> Column | None:
        return self.string if isinstance(operand, str) else self.number


def _column(key: str) -> Value:
    c = F.col(key)
    return Value(c.isNotNull(), c.cast("double") if COLUMNS[key] is int else None, c.cast("string") if COLUMNS[key] is str else None)


def _metadata(key: str) -> Value:
    if '"' in key or not key:
        raise ConfigError("a metadata key is empty or holds a quote", filter_key=key)
    path = '$["' + key.replace("\\", "\\\\") + '"]'
    found = [F.try_variant_get(m, path, "variant") for m in ("chunk_meta", "doc_meta")]
    first, second = (F.when(~F.is_variant_null(v), v) for v in found)
    value = F.coalesce(first, second)
    kind = F.schema_of_variant(value)
    number = F.when(kind.isin("BIGINT", "BOOLEAN", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    return Value(value.isNotNull(), number, F.when(kind == "STRING", F.try_variant_get(value, "$", "string")))


def _scalar(key: str, operand, ordered: bool = False):
    if operand is None or not isinstance(operand, str | int | float):
        raise ConfigError("an operand must be a string, number or boolean", filter_key=key, operand=operand)
    if isinstance(operand, float) and not math.isfinite(operand):
        raise ConfigError("an operand must be finite", filter_key=key, operand=operand)
    if ordered and isinstance(operand, bool):
        raise ConfigError("booleans have no order", filter_key=key)
    if key in COLUMNS and (isinstance(operand, bool) or not isinstance(operand, COLUMNS[key])):
        raise ConfigError(f"{key} takes {COLUMNS[key].__name__}", filter_key=key, operand=operand)
    return operand


def _equal(v: Value, operand) -> Column:
    side = v.like(operand)
    if side is None:
        return F.lit(False)
    return F.coalesce(side == F.lit(operand if isinstance(operand, str) else float(operand)), F.lit(False))


def _any(v: Value, operands: list) -> Column:
    return reduce(lambda a, b: a | b, [_equal(v, x) for x in operands], F.lit(False))


def _operation(key: str, v: Value, name: str, operand) -> Column:
    if name == "$exists":
        if not isinstance(operand, bool):
            raise ConfigError("$exists takes a boolean", filter_key=key)
        return v.present if operand else ~v.present
    if name in ("$in", "$nin"):
        if not isinstance(operand, list | tuple):
            raise ConfigError(f"{name} takes a list", filter_key=key)
        found = _any(v, [_scalar(key, x) for x in operand])
        return v.present & (found if name == "$in" else ~found)
    if name in ("$eq", "$ne"):
        found = _equal(v, _scalar(key, operand))
        return found if name == "$eq" else v.present & ~found
    if name == "$prefix":
        if not isinstance(operand, str) or key in COLUMNS and COLUMNS[key] is not str:
            raise ConfigError("$prefix takes a string", filter_key=key)
        return F.coalesce(v.string.startswith(operand), F.lit(False))
    if name in COMPARED:
        side = v.like(_scalar(key, operand, ordered=True))
        if side is None:
            return F.lit(False)
        return F.coalesce(getattr(side, COMPARED[name])(F.lit(operand if isinstance(operand, str) else float(operand))), F.lit(False))
    raise ConfigError("unknown operator", filter_key=key, operator=name)


def _mapping(found) -> Column:
    if not isinstance(found, Mapping):
        raise ConfigError("a filter is a mapping", found=type(found).__name__)
    parts = []
    for key, operand in found.items():
        if not isinstance(key, str):
            raise ConfigError("a key is a string", found=type(key).__name__)
        if key in ("$and", "$or"):
            if not isinstance(operand, list | tuple) or not operand:
                raise ConfigError(f"{key} takes a non-empty list", found=operand)
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, map(_mapping, operand)))  # noqa: B023
        elif key == "$not":
            parts.append(~_mapping(operand))
        elif key.startswith("$"):
            raise ConfigError("unknown operator", operator=key)
        else:
            v = _column(key) if key in COLUMNS else _metadata(key)
            if not isinstance(operand, Mapping):
                parts.append(_operation(key, v, "$eq", operand))
            elif not operand:
                raise ConfigError("an operator mapping is empty", filter_key=key)
            else:
                parts += [_operation(key, v, name, x) for name, x in operand.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_filter(found: Mapping | None) -> Column:
    """The filter's Column; every mistake is a ConfigError before anything runs."""
    return _mapping(found or {})


def filter_chunk_ids(chunks: DataFrame, documents: DataFrame, found: Mapping | None) -> DataFrame:
    """chunk_id of the rows that a filter lets through."""
    docs = documents.select("doc_id", "source_uri", F.col("metadata").alias("doc_meta"))
    rows = chunks.select("chunk_id", "doc_id", "ordinal", F.col("metadata").alias("chunk_meta")).join(docs, "doc_id")
    return rows.where(compile_filter(found)).select("chunk_id")

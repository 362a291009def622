"""Inline values, typed fields and the formats of dataset sources."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import ORDER

_TYPES = {"number": "double", "integer": "double", "boolean": "boolean", "string": "string", "date": "string"}


def inline(spark: SparkSession, values, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a JSON value: an array gives rows, a scalar or object one row, null none; scalars become {data}.

    Numbers are doubles, rows keep their order. The schema is the union of all rows' fields."""
    rows = values if isinstance(values, list) else [] if values is None else [values]
    rows = [r if isinstance(r, dict) else {"data": r} for r in rows]
    if schema is None:
        fields: dict[str, T.DataType] = {}
        for r in rows:
            for k, v in r.items():
                fields[k] = _merge(fields.get(k), _infer(v))
        schema = T.StructType([T.StructField(k, t if not isinstance(t, T.NullType) else T.StringType()) for k, t in fields.items()])
    whole = T.StructType([*schema.fields, T.StructField(ORDER, T.LongType())])
    return spark.createDataFrame([tuple(_fit(r.get(f.name), f.dataType) for f in schema) + (i,) for i, r in enumerate(rows)], whole)


def _infer(v) -> T.DataType:
    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, (int, float)):
        return T.DoubleType()
    if isinstance(v, list):
        kind: T.DataType | None = None
        for x in v:
            kind = _merge(kind, _infer(x))
        return T.ArrayType(kind if kind is not None and not isinstance(kind, T.NullType) else T.StringType())
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _merge(None, _infer(x))) for k, x in v.items()])
    return T.StringType()


def _merge(a: T.DataType | None, b: T.DataType) -> T.DataType:
    if a is None or isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        return T.StructType([T.StructField(n, _merge(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else T.NullType())) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    return T.StringType()


def _fit(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in t) if isinstance(v, dict) else None
    if isinstance(t, T.ArrayType):
        return [_fit(x, t.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else json.dumps(v)
    return float(v) if isinstance(t, T.DoubleType) and not isinstance(v, bool) else v


def typed(column: Column, kind: str) -> Column:
    """A declared field type; a date becomes epoch milliseconds, NaN if it can't be read."""
    if kind == "boolean":
        return column.try_cast("boolean")
    if kind in ("number", "integer"):
        return column.try_cast("double")
    if kind == "date" or kind.startswith("date:"):
        fmt = kind[5:].strip("'\"") if ":" in kind else None
        time = F.try_to_timestamp(column.cast("string"), F.lit(fmt)) if fmt else F.try_to_timestamp(column.cast("string"))
        return F.when(column.isNotNull(), F.coalesce(F.unix_millis(time).cast("double"), F.lit(float("nan"))))
    if kind == "string":
        return column.cast("string")
    raise ValueError(f"unknown field type {kind!r}")


def typed_fields(df: DataFrame, parse: Mapping[str, str]) -> DataFrame:
    return df.withColumns({f: typed(F.col(f), k) for f, k in parse.items() if f in df.columns})


def typed_json(df: DataFrame, column: str, parse: Mapping[str, str], into: str = "value", property: str | None = None) -> DataFrame:
    """Reads declared fields out of a JSON text column into a struct; other fields are never decoded."""
    path = "$" + (f".{property}" if property else "")
    fields = [typed(F.get_json_object(F.col(column), f"{path}.{f}"), k).alias(f) for f, k in parse.items()]
    return df.withColumn(into, F.struct(*fields))


def exploded_json(df: DataFrame, column: str, property: str | None, schema: str) -> DataFrame:
    """A row for each element of the array at ``property`` of a JSON text column."""
    body = F.get_json_object(F.col(column), f"$.{property}") if property else F.col(column)
    return df.select(F.explode(F.from_json(body, f"array<{schema}>")).alias("row")).select("row.*")


def read(spark: SparkSession, path: str, kind: str = "json", parse: Mapping[str, str] | None = None, property: str | None = None, schema: str | None = None) -> DataFrame:
    """A url source: json, csv, tsv, parquet or text; csv and tsv have a header. A schema avoids a pass to infer one."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        df = reader.csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind == "json":
        df = reader.json(path, multiLine=True)
        if property:
            df = df.select(F.explode(F.col(property)).alias("row")).select("row.*")
    else:
        df = reader.format(kind).load(path)
    return typed_fields(df, parse or {})


def tree_rows(value: Mapping, children: str = "children") -> list[dict]:
    """A tree literal in pre-order: each node with ``parent``, its parent's row number; children become row numbers."""
    rows: list[dict] = []
    stack: list[tuple[Mapping, int | None]] = [(value, None)]
    while stack:
        node, parent = stack.pop()
        at = len(rows)
        rows.append({**{k: v for k, v in node.items() if k != children}, "parent": parent, children: []})
        if parent is not None:
            rows[parent][children].append(at)
        stack += [(c, at) for c in reversed(node.get(children) or [])]
    return rows


def treejson(spark: SparkSession, value: Mapping, children: str = "children") -> DataFrame:
    """The flattened tree; the root is row 0."""
    return inline(spark, tree_rows(value, children))

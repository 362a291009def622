"""Whole specifications: named datasets that form a graph, transforms, predicates, scales and marks.

Names are bound and cycles found before anything runs; each dataset is one lazy DataFrame, and one that
several others read is the same DataFrame, so Spark can reuse its exchanges."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import transforms as t
from millrace.operators.aggregates import ORDER, aggregate
from millrace.plans.expressions import Context, Value, kind_of
from millrace.plans.expressions import column as expression
from millrace.plans.predicates import Predicates
from millrace.sources import formats, topology


class SpecError(ValueError):
    pass


def apply(df: DataFrame, step: Mapping, spec: Spec | None = None, compat: bool = False) -> DataFrame:
    """One transform of a specification."""
    kind = step["type"]
    own = {k: v for k, v in step.items() if k != "type"}
    name = lambda x: spec.dataset(x) if spec is not None else None
    if kind == "filter":
        return t.filter_(df, own["test"], compat)
    if kind == "formula":
        return t.formula(df, own["field"], own["expr"], compat)
    if kind == "aggregate":
        return aggregate(df, own.get("groupby"), own.get("summarize"))
    if kind == "facet":
        steps = own.get("transform", [])

        def inner(rows: DataFrame, keys: list[str]) -> DataFrame:
            for s in steps:
                rows = _within(rows, s, keys, compat)
            return rows

        return t.facet(df, own.get("groupby", []), own.get("summarize"), inner if steps else None)
    if kind == "bin":
        return t.bin_(df, **own)
    if kind == "countpattern":
        return t.countpattern(df, **{{"as": "output"}.get(k, k): v for k, v in own.items()})
    if kind == "cross":
        return t.cross(df, name(own["with"]) if "with" in own else None, own.get("diagonal", True), own.get("filter"), own.get("output"), compat)
    if kind == "lookup":
        default = F.lit(own["default"]) if own.get("default") is not None else None
        on = name(own["on"])
        return t.lookup(df, on, own["keys"], own["as"], own.get("onKey"), default if default is None else None)
    if kind == "stack":
        return t.stack(df, own["field"], own.get("groupby"), own.get("sortby"), own.get("offset", "zero"), _output(own))
    if kind == "pie":
        return t.pie(df, own.get("field"), own.get("sort", False), own.get("startAngle", 0.0), own.get("endAngle", 6.283185307179586), _output(own))
    if kind == "sort":
        return t.sort(df, own["by"])
    if kind == "rank":
        return t.rank(df, own.get("by"), own.get("groupby"), own.get("normalize", False), own.get("output", {}).get("rank", "rank"))
    if kind == "fold":
        return t.fold(df, own["fields"], own.get("output"))
    if kind == "impute":
        return t.impute(df, own["field"], own.get("orderby", own.get("keys", [])), own.get("groupby"), own.get("method", "value"), own.get("value", 0.0))
    if kind == "treeify":
        return t.treeify(df, own["groupby"], own.get("output", {}).get("children", "values"))
    from millrace.layout import geo, graphs, linkpath, treemap, words

    if kind == "treemap":
        return treemap.treemap(df, **own)
    if kind == "force":
        return graphs.force(df, name(own["links"]), **{k: v for k, v in own.items() if k != "links"})
    if kind == "geo":
        return geo.geo(df, **own)
    if kind == "geopath":
        return geo.geopath(df, **own)
    if kind == "linkpath":
        return linkpath.linkpath(df, **own)
    if kind == "wordcloud":
        return words.wordcloud(df, **own)
    raise SpecError(f"unknown transform {kind!r}")


def _output(own: Mapping) -> dict[str, str] | None:
    return {k.replace("layout_", ""): v for k, v in own["output"].items()} if own.get("output") else None


def _within(df: DataFrame, step: Mapping, keys: list[str], compat: bool) -> DataFrame:
    """A sub-transform of a facet, on flat rows: what gathers rows does so by the keys."""
    kind = step["type"]
    if kind in ("filter", "formula", "bin", "fold"):
        return apply(df, step, None, compat)
    if kind in ("stack", "rank"):
        return apply(df, {**step, "groupby": [*keys, *[g for g in step.get("groupby", []) if g not in keys]]}, None, compat)
    if kind == "aggregate":
        return aggregate(df, [*keys, *[g for g in step.get("groupby", []) if g not in keys]], step.get("summarize"))
    if kind == "sort":
        by = [step["by"]] if isinstance(step["by"], str) else step["by"]
        return t.rank(df.drop(ORDER), by, keys, output=ORDER)
    raise SpecError(f"{kind!r} can't be a facet's sub-transform")


class Spec:
    """A specification (dict or JSON text) over a session; ``tables`` may supply datasets by name."""

    def __init__(self, spec: Mapping | str, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, compat: bool = False) -> None:
        self.spec = json.loads(spec) if isinstance(spec, str) else spec
        if self.spec.get("version", 2) != 2:
            raise SpecError("only version 2 specifications are supported")
        if self.spec.get("signals"):
            raise SpecError("signals are not supported")
        self.spark, self.tables, self.compat = spark, dict(tables or {}), compat
        self.data = {d["name"]: d for d in self.spec.get("data", [])}
        self._built: dict[str, DataFrame] = {}
        self._check()
        self.predicates = None

    def _check(self) -> None:
        """Every name is known and no dataset reads itself, however far round."""
        done: set[str] = set()

        def visit(n: str, path: tuple[str, ...]) -> None:
            if n in path:
                raise SpecError("datasets in a circle: " + " -> ".join([*path, n]))
            if n in done:
                return
            if n not in self.data:
                if n in self.tables:
                    return
                raise SpecError(f"unknown dataset {n!r}")
            d = self.data[n]
            reads = [d["source"]] if "source" in d else []
            for s in d.get("transform", []):
                reads += [s[k] for k in ("with", "on", "links") if isinstance(s.get(k), str)]
            for r in reads:
                visit(r, (*path, n))
            done.add(n)

        for n in self.data:
            visit(n, ())

    def dataset(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self.data:
                self._built[name] = self.tables[name]
            else:
                d = self.data[name]
                df = self._source(d)
                for step in d.get("transform", []):
                    df = apply(df, step, self, self.compat)
                self._built[name] = df
        return self._built[name]

    def _source(self, d: Mapping) -> DataFrame:
        fmt = d.get("format", {})
        kind = fmt.get("type", "json") if isinstance(fmt, Mapping) else fmt
        parse = fmt.get("parse") or {} if isinstance(fmt, Mapping) else {}
        if "source" in d:
            return self.dataset(d["source"])
        if "values" in d:
            values = d["values"]
            if isinstance(values, str) and kind in ("json", "treejson", "topojson"):
                values = json.loads(values)
            if kind == "treejson":
                return formats.typed_fields(formats.treejson(self.spark, values, fmt.get("children", "children")), parse)
            if kind == "topojson":
                if "mesh" in fmt:
                    return formats.inline(self.spark, [{"geometry": json.dumps(topology.mesh(values, fmt["mesh"]))}])
                return topology.features(self.spark, values, fmt["feature"])
            if fmt.get("property") if isinstance(fmt, Mapping) else None:
                for k in fmt["property"].split("."):
                    values = values[k]
            return formats.typed_fields(formats.inline(self.spark, values), parse)
        if "url" in d:
            return formats.read(self.spark, d["url"], kind, parse, fmt.get("property") if isinstance(fmt, Mapping) else None, d.get("schema"))
        return self.tables.get(d["name"], formats.inline(self.spark, []))

    # -- scales and marks

    def scale(self, name: str):
        from millrace.operators.scales import from_spec

        s = next((s for s in self.spec.get("scales", []) if s["name"] == name), None)
        if s is None:
            raise SpecError(f"unknown scale {name!r}")
        return from_spec(s, self)

    def mark(self, mark: Mapping) -> DataFrame:
        """A row a datum with the resolved visual properties of a mark's ``enter`` (and ``update``) set."""
        origin = mark.get("from", {})
        df = self.dataset(origin["data"]) if "data" in origin else self.spark.range(1).select(F.lit(0).alias(ORDER))
        if "mark" in origin:
            other = next(m for m in self.spec.get("marks", []) if m.get("name") == origin["mark"])
            df = self.mark(other)
        for step in origin.get("transform", []):
            df = apply(df, step, self, self.compat)
        properties = mark.get("properties", {})
        props = {**properties.get("enter", {}), **properties.get("update", {})}
        datum = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != ORDER])
        extra: dict[str, Column] = {}
        for k, v in props.items():
            df, extra[k] = self._property(df, v)
        if "x2" in extra and "x" in extra:
            extra["width"] = extra.get("width", F.abs(extra["x2"] - extra["x"]))
        if "y2" in extra and "y" in extra:
            extra["height"] = extra.get("height", F.abs(extra["y2"] - extra["y"]))
        order = [F.col(ORDER)] if ORDER in df.columns else []
        return df.select(*[c.alias(k) for k, c in extra.items()], datum.alias("datum"), *order)

    def _property(self, df: DataFrame, v) -> tuple[DataFrame, Column]:
        if isinstance(v, list) or (isinstance(v, Mapping) and "rules" in v):
            rules = v if isinstance(v, list) else v["rules"]
            own = Predicates(self.spec.get("predicates", []), {n: self.dataset(n) for n in self.data}, self.compat)
            out, default = None, F.lit(None)
            for r in rules:
                df, value = self._property(df, {k: x for k, x in r.items() if k not in ("predicate", "input")})
                if "predicate" not in r:
                    default = value
                    break
                p = r["predicate"] if isinstance(r["predicate"], str) else r["predicate"]["name"]
                df, test = own.flagged(df, p, r.get("input") or {k: x for k, x in (r["predicate"].items() if isinstance(r["predicate"], Mapping) else ()) if k != "name"})
                out = F.when(test, value) if out is None else out.when(test, value)
            return df, default if out is None else out.otherwise(default)
        if not isinstance(v, Mapping):
            return df, F.lit(v)
        if set(v) in ({*"rgb"}, {*"hsl"}, {*"lab"}, {*"hcl"}):
            from millrace.functions import colors

            parts = {}
            for k, x in v.items():
                df, parts[k] = self._property(df, x)
            return df, colors.of(parts)
        if "template" in v:
            from millrace.functions.templates import template

            return df, template(v["template"], Context(df.schema, self.compat))
        if "field" in v:
            f = v["field"]
            f = f["datum"] if isinstance(f, Mapping) and "datum" in f else f
            c = F.lit(self.spec.get(f["group"])) if isinstance(f, Mapping) and "group" in f else F.col(f)
        elif "value" in v:
            c = F.lit(v["value"])
        elif "expr" in v:
            c = expression(v["expr"], Context(df.schema, self.compat)).column
        else:
            c = F.lit(0.0) if "scale" in v and v.get("band") else F.lit(None)
        if "scale" in v:
            s = v["scale"]
            scale = self.scale(s if isinstance(s, str) else s["name"])
            c = F.lit(scale.band()) if v.get("band") else scale.apply(c)
        if "mult" in v:
            c = c * v["mult"]
        if "offset" in v:
            c = c + v["offset"]
        return df, c

    def axis(self, axis: Mapping) -> DataFrame:
        """(value, position, text) of an axis's ticks."""
        return self.scale(axis["scale"]).ticks_frame(self.spark, axis.get("ticks", 10), axis.get("values"), axis.get("format"))

    def run(self, transform: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
        """All datasets by name."""
        return {n: self.dataset(n) for n in self.data}


def value(df: DataFrame, column: str) -> Value:
    return Value(F.col(column), kind_of(df.schema[column].dataType), df.schema[column].dataType)

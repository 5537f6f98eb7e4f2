"""A subset of SHACL over DataFrames: targetNode and targetClass; path, minCount, maxCount, datatype, nodeKind, class, in, hasValue, pattern.

Shapes come as parsed triples and are small: they are read on the driver and each constraint
becomes one query of the data. Any other term of the vocabulary on a shape is refused."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.turtle import RDF, XSD, parse

SH = "http://www.w3.org/ns/shacl#"
SUPPORTED = frozenset("targetNode targetClass property path minCount maxCount datatype nodeKind class in hasValue pattern message name description severity".split())
KINDS = {"IRI": ("iri",), "Literal": ("literal",), "BlankNode": ("blank",), "IRIOrLiteral": ("iri", "literal"), "BlankNodeOrIRI": ("blank", "iri"), "BlankNodeOrLiteral": ("blank", "literal")}
VIOLATIONS = "shape string, focus string, path string, rule string"


class ShapeError(ValueError):
    """The shapes are not valid, or use what is not supported."""


@dataclass
class Property:
    path: str
    rules: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Shape:
    name: str
    nodes: list[str]
    classes: list[str]
    properties: list[Property]


def read_shapes(turtle: str) -> list[Shape]:
    """Node shapes of a Turtle text; TurtleError and ShapeError tell what is wrong with it."""
    by: dict[str, list[tuple]] = {}
    for s, p, o, kind, datatype in parse(turtle):
        by.setdefault(s, []).append((p, o, kind, datatype))

    def values(node: str, name: str) -> list[tuple]:
        return [v[1:] for v in by.get(node, ()) if v[0] == SH + name]

    def items(head: str) -> list[str]:
        out = []
        while head != RDF + "nil":
            out.append(next(o for p, o, *_ in by[head] if p == RDF + "first"))
            head = next(o for p, o, *_ in by[head] if p == RDF + "rest")
        return out

    def refuse(node: str) -> None:
        for p, *_ in by.get(node, ()):
            if p.startswith(SH) and p[len(SH) :] not in SUPPORTED:
                raise ShapeError(f"unsupported: {p}")

    def properties(node: str) -> Property:
        refuse(node)
        paths = values(node, "path")
        if len(paths) != 1 or paths[0][1] != "iri":
            raise ShapeError("unsupported: a property needs one path that is an IRI")
        out = Property(paths[0][0])
        for name in ("minCount", "maxCount"):
            for o, kind, datatype in values(node, name):
                if datatype != XSD + "integer" or not o.lstrip("+").isdigit():
                    raise ShapeError(f"{name} must be an integer")
                out.rules.append((name, int(o)))
        for name in ("datatype", "class", "hasValue", "pattern"):
            out.rules += [(name, o) for o, *_ in values(node, name)]
        out.rules += [("nodeKind", KINDS[o[len(SH) :]]) for o, *_ in values(node, "nodeKind")]
        out.rules += [("in", items(o)) for o, *_ in values(node, "in")]
        return out

    shapes = []
    for node, triples in by.items():
        typed = any(p == RDF + "type" and o == SH + "NodeShape" for p, o, *_ in triples)
        if typed or values(node, "targetNode") or values(node, "targetClass"):
            refuse(node)
            shapes.append(Shape(node, [v[0] for v in values(node, "targetNode")], [v[0] for v in values(node, "targetClass")], [properties(v[0]) for v in values(node, "property")]))
    return shapes


def validate(data: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(shape, focus, path, rule) of each violation in the triples (s, p, o, o_kind, o_datatype). An empty result conforms."""
    spark, found = data.sparkSession, None
    for shape in shapes:
        focus = data.where((F.col("p") == RDF + "type") & F.col("o").isin(shape.classes)).select(F.col("s").alias("focus")) if shape.classes else None
        if shape.nodes:
            named = spark.createDataFrame([(n,) for n in shape.nodes], "focus string")
            focus = named if focus is None else focus.union(named)
        if focus is None:
            continue
        focus = focus.distinct()
        for prop in shape.properties:
            values = data.where(F.col("p") == prop.path).select(F.col("s").alias("focus"), "o", "o_kind", "o_datatype").distinct()
            own = focus.join(values, "focus")
            for rule, want in prop.rules:
                if rule in ("minCount", "maxCount"):
                    n = focus.join(values.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                    bad = n.where(F.col("n") < want if rule == "minCount" else F.col("n") > want)
                elif rule == "hasValue":
                    bad = focus.join(values.where(F.col("o") == want), "focus", "left_anti")
                elif rule == "class":
                    members = data.where((F.col("p") == RDF + "type") & (F.col("o") == want)).select(F.col("s").alias("m"))
                    bad = own.join(members, F.col("o") == F.col("m"), "left_anti")
                elif rule == "datatype":
                    kind = F.when(F.col("o_kind") == "literal", F.coalesce("o_datatype", F.lit(XSD + "string")))
                    bad = own.where(~kind.eqNullSafe(F.lit(want)))
                else:
                    ok = {"nodeKind": lambda w: F.col("o_kind").isin(*w), "in": lambda w: F.col("o").isin(*w), "pattern": lambda w: F.col("o").rlike(w) & (F.col("o_kind") != "blank")}[rule](want)
                    bad = own.where(~ok)
                bad = bad.select(F.lit(shape.name).alias("shape"), "focus", F.lit(prop.path).alias("path"), F.lit(rule).alias("rule")).distinct()
                found = bad if found is None else found.union(bad)
    return spark.createDataFrame([], VIOLATIONS) if found is None else found

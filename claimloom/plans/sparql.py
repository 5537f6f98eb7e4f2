"""A small SPARQL: PREFIX, SELECT [DISTINCT] and ASK over basic graph patterns, GRAPH (name or variable), UNION, ";" and "," lists.

A query becomes joins of selections of a quads DataFrame, one for each pattern, on the
variables that they share; Catalyst orders and pushes what it can. Terms meet by value, kind and
datatype: a literal is no IRI of the same text. Joins are dealt out over the branches of a UNION, so that
a variable that one branch leaves unbound is bound by a later pattern there."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<t><[^<>\s]*>|"(?:[^"\\]|\\.)*"|\?\w+|[\w.-]*:[\w-]*(?:\.[\w-]+)*|\w+|\^\^|[{}.;,*])""", re.X)


class SparqlError(ValueError):
    pass


class _Query:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at:at + 20]!r}")
            if m["t"]:
                self.tokens.append(m["t"])
            at = m.end()
        self.at, self.prefixes, self.variables, self.distinct = 0, {}, None, False
        while self.peek().upper() == "PREFIX":
            self.take()
            name, iri = self.take(), self.take()
            self.prefixes[name.rstrip(":")] = iri[1:-1]
        self.form = self.take().upper()
        if self.form == "SELECT":
            if self.peek().upper() == "DISTINCT":
                self.take()
                self.distinct = True
            self.variables = []
            while self.peek().startswith("?") or self.peek() == "*":
                self.variables.append(self.take().lstrip("?"))
        elif self.form != "ASK":
            raise SparqlError(f"{self.form} is not supported")
        if self.peek().upper() == "WHERE":
            self.take()
        self.tree = self.group(None)
        if self.at < len(self.tokens):
            raise SparqlError(f"{self.peek()} is not supported")

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        word = self.peek()
        if not word or want and word != want:
            raise SparqlError(f"expected {want}, found {word or 'the end'}")
        self.at += 1
        return word

    def term(self) -> tuple[str, str]:
        """(var | iri | literal, value)"""
        word = self.take()
        if word.startswith("?"):
            return "var", word[1:]
        if word.startswith("<"):
            return "iri", word[1:-1]
        if word.startswith('"'):
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), word[1:-1])
            if self.peek() != "^^":
                return "literal", text
            self.take()
            kind, datatype = self.term()
            if kind != "iri":
                raise SparqlError("a datatype is an IRI")
            return f"literal^^{'' if datatype == XSD_STRING else datatype}", text
        if word == "a":
            return "iri", RDF_TYPE
        prefix, colon, rest = word.partition(":")
        if colon and prefix in self.prefixes:
            return "iri", self.prefixes[prefix] + rest
        raise SparqlError(f"{word} is not supported")

    def group(self, graph: tuple | None) -> list:
        """Patterns (g, s, p, o) and unions ("union", groups) that hold together."""
        self.take("{")
        out: list = []
        while self.peek() != "}":
            if self.peek() == "{":
                options = [self.group(graph)]
                while self.peek().upper() == "UNION":
                    self.take()
                    options.append(self.group(graph))
                out.append(("union", options))
            elif self.peek().upper() == "GRAPH":
                self.take()
                out += self.group(self.term())
            else:
                subject = self.term()
                while True:
                    predicate = self.term()
                    while True:
                        out.append((graph, subject, predicate, self.term()))
                        if self.peek() != ",":
                            break
                        self.take()
                    if self.peek() != ";":
                        break
                    self.take()
                    if self.peek() in (".", "}"):
                        break
            if self.peek() == ".":
                self.take()
        self.take("}")
        return out


#: Ends the name of the column that tells a variable's kind and datatype.
KIND = "\x00kind"


def _kind(quads: DataFrame, column: str):
    """iri, or literal^^ and the datatype; plain literals and strings are one."""
    if column != "o":
        return F.lit("iri")
    datatype = F.coalesce("o_datatype", F.lit("")) if "o_datatype" in quads.columns else F.lit("")
    return F.when(F.col("o_kind") == "literal", F.concat(F.lit("literal^^"), F.when(datatype == XSD_STRING, "").otherwise(datatype))).otherwise(F.lit("iri"))


def _pattern(quads: DataFrame, pattern: tuple) -> DataFrame:
    conditions, names = [], {}
    for column, term in zip("gspo", pattern):
        if term is None:
            continue
        kind, value = term
        if kind == "var":
            if value in names:
                conditions.append((F.col(column) == F.col(names[value])) & (_kind(quads, column) == _kind(quads, names[value])))
            else:
                names[value] = column
        else:
            conditions.append(F.col(column) == value)
            if column == "o":
                conditions.append(_kind(quads, "o") == ("literal^^" if kind == "literal" else kind))
            elif kind != "iri":
                conditions.append(F.lit(False))
    kept = quads.where(reduce(lambda a, b: a & b, conditions)) if conditions else quads
    columns = [x for v, c in names.items() for x in (F.col(c).alias(v), _kind(quads, c).alias(v + KIND))]
    rows = kept.select(*(columns or [F.lit(True).alias("_met")]))
    return rows.distinct() if pattern[0] is None else rows  # over all graphs a triple counts once


def _meet(parts: list[DataFrame]) -> DataFrame:
    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        if "_met" in b.columns:  # a pattern without variables holds or does not
            return a.join(b.limit(1).select(F.lit(1).alias("_one")), F.lit(1) == F.col("_one")).drop("_one")
        shared = [c for c in b.columns if c in a.columns]
        if not shared:
            raise SparqlError("patterns that share no variable are not supported")
        return a.join(b, shared)

    bound = sorted(parts, key=lambda p: "_met" in p.columns)
    ordered, rest = [bound[0]], bound[1:]
    while rest:  # next a pattern that shares a variable with those before
        known = {c for p in ordered for c in p.columns}
        i = next((k for k, p in enumerate(rest) if "_met" in p.columns or known & set(p.columns)), 0)
        ordered.append(rest.pop(i))
    return reduce(meet, ordered)


def _branches(quads: DataFrame, group: list) -> list[list[DataFrame]]:
    """The patterns of each way through a group's unions."""
    ways: list[list[DataFrame]] = [[]]
    for item in group:
        more = [w for g in item[1] for w in _branches(quads, g)] if item[0] == "union" else [[_pattern(quads, item)]]
        ways = [a + b for a in ways for b in more]
    return ways


def _solve(quads: DataFrame, group: list) -> DataFrame:
    ways = _branches(quads, group)
    if not all(ways):
        raise SparqlError("an empty pattern is not supported")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(_meet, ways))


def select(quads: DataFrame, text: str) -> DataFrame:
    """Solutions of a SELECT query over quads (g, s, p, o, o_kind, ...)."""
    query = _Query(text)
    if query.form != "SELECT":
        raise SparqlError("not a SELECT query")
    rows = _solve(quads, query.tree)
    names = query.variables if query.variables != ["*"] else [c for c in rows.columns if c != "_met" and not c.endswith(KIND)]
    if query.distinct:  # terms of one text and two kinds are two
        rows = rows.select(*names, *[c for c in rows.columns if c.endswith(KIND) and c.removesuffix(KIND) in names]).distinct()
    return rows.select(*names)


def ask(quads: DataFrame, text: str) -> bool:
    query = _Query(text)
    if query.form != "ASK":
        raise SparqlError("not an ASK query")
    return not _solve(quads, query.tree).isEmpty()

"""Turtle to triples: prefixes, base, a, lists of predicates and objects, blank nodes, collections, literals, numbers, booleans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    |(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w.-]*\w)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-]))*|[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES[m[1]], text, flags=re.S)


def parse(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """(s, p, o, o_kind, o_datatype), each once; o_kind is iri, blank or literal. Raises TurtleError."""
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unexpected {text[at:at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    prefixes, base, out, place, fresh = {}, "", {}, 0, 0

    def take(mark: str | None = None) -> tuple[str, str]:
        nonlocal place
        kind, word = tokens[place]
        if mark is not None and word != mark:
            raise TurtleError(f"expected {mark!r}, found {word!r}")
        if kind == "end":
            raise TurtleError("the text ends early")
        place += 1
        return kind, word

    def blank() -> tuple[str, str, None]:
        nonlocal fresh
        fresh += 1
        return f"_:b{fresh}", "blank", None

    def add(s: tuple, p: str, o: tuple) -> None:
        out[(s[0], p, *o)] = None

    def term() -> tuple[str, str, str | None]:
        kind, word = take()
        if kind == "iri":
            iri = word[1:-1]
            return (iri if ":" in iri else base + iri), "iri", None
        if kind == "blank":
            return word, "blank", None
        if kind == "number":
            return word, "literal", XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer")
        if kind in ("long", "short"):
            value = _unescaped(word[3:-3] if kind == "long" else word[1:-1])
            if tokens[place][0] == "word":
                take()
                return value, "literal", RDF + "langString"
            if tokens[place][1] == "^^":
                take()
                return value, "literal", term()[0]
            return value, "literal", None
        if kind == "name":
            if word in ("true", "false"):
                return word, "literal", XSD + "boolean"
            prefix, colon, rest = word.partition(":")
            if not colon or prefix not in prefixes:
                raise TurtleError(f"unknown name {word!r}")
            return prefixes[prefix] + rest, "iri", None
        if word == "[":
            node = blank()
            if tokens[place][1] != "]":
                properties(node)
            take("]")
            return node
        if word == "(":
            items = []
            while tokens[place][1] != ")":
                items.append(term())
            take(")")
            rest = (RDF + "nil", "iri", None)
            for item in reversed(items):
                node = blank()
                add(node, RDF + "first", item)
                add(node, RDF + "rest", rest)
                rest = node
            return rest
        raise TurtleError(f"unexpected {word!r}")

    def properties(subject: tuple) -> None:
        while True:
            if tokens[place] == ("name", "a"):
                take()
                predicate = RDF + "type"
            else:
                predicate, kind, _ = term()
                if kind != "iri":
                    raise TurtleError("a predicate must be an IRI")
            while True:
                add(subject, predicate, term())
                if tokens[place][1] != ",":
                    break
                take()
            if tokens[place][1] != ";":
                return
            while tokens[place][1] == ";":
                take()
            if tokens[place][1] in (".", "]"):
                return

    while tokens[place][0] != "end":
        kind, word = tokens[place]
        if word.lower() in ("@prefix", "prefix", "@base", "base"):
            take()
            if word.lower().endswith("prefix"):
                name = take()[1]
                iri = take()
                if not name.endswith(":") or iri[0] != "iri":
                    raise TurtleError("a prefix needs a name and an IRI")
                prefixes[name[:-1]] = iri[1][1:-1]
            else:
                base = take()[1][1:-1]
            if word.startswith("@"):
                take(".")
            continue
        opened = word == "["
        subject = term()
        if subject[1] == "literal":
            raise TurtleError("a subject cannot be a literal")
        if not (opened and tokens[place][1] == "."):
            properties(subject)
        take(".")
    return list(out)


@udtf(returnType="s string, p string, o string, o_kind string, o_datatype string, error string")
class ParseTurtle:
    """Rows of a Turtle text's triples; one row with error where it is not Turtle."""

    def eval(self, text: str):
        if text is None:
            return
        try:
            for row in parse(text):
                yield (*row, None)
        except TurtleError as error:
            yield None, None, None, None, None, str(error)


def triples(rows, text: str, *keep: str):
    """rows' columns keep with the triples of their Turtle."""
    return rows.lateralJoin(ParseTurtle(F.col(text).outer())).select(*keep, "s", "p", "o", "o_kind", "o_datatype", "error")

"""RDF terms: on the driver as small classes, in tables as one string column.

A term's string is ``<iri>``, ``_:label``, ``"lexical"``, ``"lexical"@lang`` or ``"lexical"^^datatype``.
Languages and datatypes hold no quote, so the last quote ends the lexical form and nothing needs
escaping: equal strings are equal terms, and joins on terms are joins on strings.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"

INTEGERS = tuple(XSD + x for x in "integer long int short byte nonNegativeInteger nonPositiveInteger positiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
NUMBERS = INTEGERS + tuple(XSD + x for x in ("decimal", "float", "double"))
STRINGS = ("", XSD + "string")


class _Name(str):
    """Equal names of different kinds are different terms; plain strings compare as strings."""

    __slots__ = ()
    __hash__ = str.__hash__

    def __eq__(self, other):
        return str.__eq__(self, other) if type(other) in (type(self), str) else False

    def __ne__(self, other):
        return not self == other


class Iri(_Name):
    __slots__ = ()


class Bnode(_Name):
    __slots__ = ()


class Var(_Name):
    __slots__ = ()


class Literal(NamedTuple):
    """A datatype excludes a language."""

    lex: str
    dt: str = ""
    lang: str = ""


Term = Iri | Bnode | Literal | Var


def literal(value) -> Literal:
    """A Python value as a typed literal."""
    if isinstance(value, bool):
        return Literal(str(value).lower(), XSD + "boolean")
    if isinstance(value, int):
        return Literal(str(value), XSD + "integer")
    if isinstance(value, float):
        return Literal(repr(value), XSD + "double")
    return Literal(str(value))


def encode(t: Iri | Bnode | Literal) -> str:
    if isinstance(t, Literal):
        return f'"{t.lex}"' + (f"^^{t.dt}" if t.dt else f"@{t.lang}" if t.lang else "")
    return f"_:{t}" if isinstance(t, Bnode) else f"<{t}>"


def decode(s: str) -> Iri | Bnode | Literal:
    if s.startswith("<"):
        return Iri(s[1:-1])
    if s.startswith("_:"):
        return Bnode(s[2:])
    lex, _, rest = s[1:].rpartition('"')
    return Literal(lex, rest[2:] if rest.startswith("^^") else "", rest[1:] if rest.startswith("@") else "")


# -- the parts of a term column --


def suffix(t: Column) -> Column:
    return F.substring_index(t, '"', -1)


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def is_subject(t: Column) -> Column:
    return is_iri(t) | is_blank(t)


def is_object(t: Column) -> Column:
    return is_iri(t) | is_blank(t) | is_literal(t)


def is_statement(s: Column, p: Column, o: Column) -> Column:
    """Whether three terms make a statement: no literal is a subject, only IRIs are predicates."""
    return F.coalesce(is_subject(s) & is_iri(p) & is_object(o), F.lit(False))


def is_pattern(s: Column, p: Column, o: Column) -> Column:
    """Whether they make a pattern, where NULL is any."""
    return F.coalesce(is_subject(s), F.lit(True)) & F.coalesce(is_iri(p), F.lit(True)) & F.coalesce(is_object(o), F.lit(True))


def lex(t: Column) -> Column:
    """The IRI, label or lexical form."""
    return (
        F.when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2))
        .when(is_blank(t), F.substring(t, F.lit(3), F.length(t)))
        .otherwise(F.substring(t, F.lit(2), F.length(t) - F.length(suffix(t)) - 2))
    )


def datatype(t: Column) -> Column:
    """The datatype, '' for a plain or tagged literal, null for other terms."""
    s = suffix(t)
    return F.when(is_literal(t), F.when(s.startswith("^^"), F.substring(s, F.lit(3), F.length(s))).otherwise(""))


def lang(t: Column) -> Column:
    s = suffix(t)
    return F.when(is_literal(t), F.when(s.startswith("@"), F.substring(s, F.lit(2), F.length(s))).otherwise(""))


@dataclass(frozen=True)
class Desc:
    """What is known of a column of terms before any row is read.

    kind None: the column holds term strings. U: keys of IRIs with ``prefix``. L: native values of
    datatype ``dt``, or strings of language ``lang``."""

    kind: str | None = None
    prefix: str = ""
    dt: str = ""
    lang: str = ""

    def text(self, col: Column) -> Column:
        """Lexical form of a static column."""
        if self.kind == "U":
            return F.concat(F.lit(self.prefix), col.cast("string"))
        if self.dt == XSD + "dateTime":
            return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        return col.cast("string")

    def term(self, col: Column) -> Column:
        if self.kind is None:
            return col
        if self.kind == "U":
            return F.concat(F.lit("<"), self.text(col), F.lit(">"))
        return F.concat(F.lit('"'), self.text(col), F.lit('"' + (f"^^{self.dt}" if self.dt else f"@{self.lang}" if self.lang else "")))


DYNAMIC = Desc()


def native(dt: str) -> str | None:
    """The Spark type that holds values of a datatype."""
    if dt in INTEGERS:
        return "bigint"
    return {XSD + "decimal": "decimal(38,18)", XSD + "float": "double", XSD + "double": "double", XSD + "boolean": "boolean", XSD + "dateTime": "timestamp", XSD + "date": "date"}.get(dt)

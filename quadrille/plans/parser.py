"""A recursive-descent parser for SPARQL queries."""

from __future__ import annotations

import re
from itertools import count
from urllib.parse import urljoin

from ..terms import RDF, TYPE, XSD, Bnode, Iri, Literal, Term, Var
from .algebra import BGP, Filter, Graph, Join, LeftJoin, Query, Triple, Union, Unit, bnode_var

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<var>[?$][^\W]\w*)
    |(?P<bnode>_:[^\W]\w*(?:[-.]\w+)*)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)|\d*\.\d+|\d+\.(?=\s*[^\w\s.;,\]})])\d*|\d+)
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w%](?:[\w.%-]*[\w%-])?)?)
    |(?P<word>[^\W\d]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;*/+\-!=<>|])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
BUILTINS = {"STR": 1, "LANG": 1, "LANGMATCHES": 2, "DATATYPE": 1, "BOUND": 1, "ISIRI": 1, "ISURI": 1, "ISBLANK": 1, "ISLITERAL": 1, "SAMETERM": 2, "REGEX": (2, 3)}
PREFIXES = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": XSD}


class SyntaxFault(ValueError):
    """The query text is not SPARQL."""


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), text, flags=re.S)


def tokenize(text: str) -> list[tuple[str, str, int]]:
    text = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))", lambda m: chr(int(m[1] or m[2], 16)), text)
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out + [("end", "", at)]


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.tokens, self.at = tokenize(text), 0
        self.prefixes = PREFIXES | (prefixes or {})
        self.base = base
        self.fresh = count()

    # -- tokens --

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def word(self, *names: str) -> str | None:
        """Takes one of the keywords if it is next."""
        if self.kind == "word" and self.text.upper() in names:
            return self.take().upper()
        return None

    def op(self, *names: str) -> str | None:
        if self.kind == "op" and self.text in names:
            return self.take()
        return None

    def need(self, symbol: str) -> None:
        if not self.op(symbol):
            self.fail(f"expected {symbol}")

    def fail(self, why: str):
        raise SyntaxFault(f"{why}, found {self.text!r} at {self.tokens[self.at][2]}")

    # -- terms --

    def resolve(self, iri: str) -> Iri:
        return Iri(urljoin(self.base, iri) if self.base and not re.match(r"[a-zA-Z][\w+.-]*:", iri) else iri)

    def iri(self) -> Iri | None:
        if self.kind == "iri":
            return self.resolve(self.take()[1:-1])
        if self.kind == "name":
            prefix, _, local = self.text.partition(":")
            if prefix not in self.prefixes:
                self.fail(f"unknown prefix {prefix!r}")
            self.take()
            return Iri(self.prefixes[prefix] + local)
        return None

    def string(self) -> str:
        raw = self.take()
        return unescape(raw[3:-3] if raw[:3] in ('"""', "'''") else raw[1:-1])

    def number(self, sign: str = "") -> Literal:
        raw = self.take()
        return Literal(sign + raw, XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"))

    def term(self) -> Term | None:
        """A variable or constant, if one is next."""
        if self.kind == "var":
            return Var(self.take()[1:])
        if self.kind == "bnode":
            return bnode_var(self.take()[2:])
        if self.kind == "string":
            lex = self.string()
            if self.kind == "lang":
                return Literal(lex, "", self.take()[1:])
            if self.op("^^"):
                dt = self.iri()
                return Literal(lex, str(dt)) if dt else self.fail("expected a datatype")
            return Literal(lex)
        if self.kind == "number":
            return self.number()
        if self.kind == "op" and self.text in "+-" and self.tokens[self.at + 1][0] == "number":
            return self.number(self.take().replace("+", ""))
        if self.kind == "word" and self.text in ("true", "false"):
            return Literal(self.take(), XSD + "boolean")
        return self.iri()

    # -- triples --

    def node(self, out: list[Triple]) -> Term | None:
        """A term, a collection or a blank node with properties."""
        if self.op("["):
            subject = bnode_var(f"x{next(self.fresh)}")
            if not self.op("]"):
                self.properties(subject, out)
                self.need("]")
            return subject
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node(out) or self.fail("expected a term"))
            if not items:
                return Iri(RDF + "nil")
            cells = [bnode_var(f"x{next(self.fresh)}") for _ in items]
            for k, (cell, item) in enumerate(zip(cells, items)):
                out.append(Triple(cell, Iri(RDF + "first"), item))
                out.append(Triple(cell, Iri(RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else Iri(RDF + "nil")))
            return cells[0]
        return self.term()

    def properties(self, subject: Term, out: list[Triple]) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.take()
                verb: Term | None = Iri(TYPE)
            else:
                verb = Var(self.take()[1:]) if self.kind == "var" else self.iri()
            if verb is None:
                self.fail("expected a predicate")
            while True:
                own: list[Triple] = []
                o = self.node(own)
                if o is None:
                    self.fail("expected an object")
                out.append(Triple(subject, verb, o))
                out += own
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.kind == "op" and self.text in ".]}" or self.kind == "word" and self.text != "a":
                return

    def triples(self) -> list[Triple]:
        """Triples up to what can't be one."""
        out: list[Triple] = []
        while True:
            bracket = self.kind == "op" and self.text in ("[", "(")
            before = self.at
            subject = self.node(out)
            if subject is None:
                return out
            alone = bracket and self.tokens[before][1] == "[" and out and (self.kind == "op" and self.text in ".}")
            if not alone:
                self.properties(subject, out)
            if not self.op("."):
                return out

    # -- patterns --

    def group(self):
        """A group; its filters hold for the whole of it, its elements are joined in order."""
        self.need("{")
        body, filters = None, []

        def joined(x):
            nonlocal body
            body = x if body is None else BGP(body.triples + x.triples) if isinstance(body, BGP) and isinstance(x, BGP) else Join(body, x)

        while not self.op("}"):
            if self.word("OPTIONAL"):
                right, condition = self.group(), None
                if isinstance(right, Filter):
                    condition, right = right.condition, right.body
                body = LeftJoin(body or Unit(), right, condition)
            elif self.word("GRAPH"):
                name = self.term()
                if not isinstance(name, (Iri, Var)):
                    self.fail("expected a graph")
                joined(Graph(name, self.group()))
            elif self.word("FILTER"):
                filters.append(self.constraint())
            elif self.kind == "op" and self.text == "{":
                x = self.group()
                while self.word("UNION"):
                    x = Union(x, self.group())
                joined(x)
            else:
                at = self.at
                found = self.triples()
                if self.at == at:
                    self.fail("expected a pattern")
                if found:
                    joined(BGP(found))
            self.op(".")
        body = body or Unit()
        if filters:
            condition = filters[0]
            for f in filters[1:]:
                condition = ("&&", condition, f)
            body = Filter(condition, body)
        return body

    # -- expressions --

    def constraint(self):
        if self.kind == "op" and self.text == "(":
            self.take()
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.op("||"):
            e = ("||", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            e = ("&&", e, self.relation())
        return e

    def relation(self):
        e = self.sum()
        if op := self.op("=", "!=", "<", ">", "<=", ">="):
            return (op, e, self.sum())
        return e

    def sum(self):
        e = self.product()
        while True:
            if op := self.op("+", "-"):
                e = (op, e, self.product())
            else:
                return e

    def product(self):
        e = self.unary()
        while op := self.op("*", "/"):
            e = (op, e, self.unary())
        return e

    def unary(self):
        if op := self.op("!", "+", "-"):
            return ("not" if op == "!" else "neg" if op == "-" else "pos", self.unary())
        return self.primary()

    def args(self) -> list:
        self.need("(")
        found = []
        while not self.op(")"):
            found.append(self.expression())
            if not self.op(",") and not (self.kind == "op" and self.text == ")"):
                self.fail("expected , or )")
        return found

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "word" and self.text.upper() in BUILTINS:
            name = self.take().upper()
            args, want = self.args(), BUILTINS[name]
            if len(args) not in (want if isinstance(want, tuple) else (want,)):
                self.fail(f"{name} takes {want} arguments")
            return ("call", name, args)
        t = self.term()
        if t is None:
            self.fail("expected an expression")
        if isinstance(t, Iri) and self.kind == "op" and self.text == "(":
            return ("call", t, self.args())
        return ("var", t) if isinstance(t, Var) else ("term", t)

    # -- queries --

    def query(self) -> Query:
        while True:
            if self.word("BASE"):
                self.base = self.take()[1:-1]
            elif self.word("PREFIX"):
                name = self.take()
                if self.kind != "iri" or not name.endswith(":"):
                    self.fail("expected a prefix declaration")
                self.prefixes[name[:-1]] = str(self.resolve(self.take()[1:-1]))
            else:
                break
        form = self.word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE") or self.fail("expected a query form")
        q = Query(form, Unit())
        if form == "SELECT":
            q.distinct = bool(self.word("DISTINCT"))
            if not self.op("*"):
                q.select = []
                while self.kind == "var":
                    q.select.append(Var(self.take()[1:]))
                    self.op(",")
                if not q.select:
                    self.fail("expected variables")
        elif form == "CONSTRUCT":
            self.need("{")
            q.template = self.triples()
            self.need("}")
        elif form == "DESCRIBE" and not self.op("*"):
            while self.kind in ("var", "iri", "name"):
                q.describe.append(self.term())
        while self.word("FROM"):
            named = self.word("NAMED")
            (q.from_named if named else q.from_).append(self.iri() or self.fail("expected a graph"))
        where = self.word("WHERE")
        if where or (self.kind == "op" and self.text == "{") or form != "DESCRIBE":
            q.body = self.group()
        if self.word("ORDER"):
            if not self.word("BY"):
                self.fail("expected BY")
            while True:
                if d := self.word("ASC", "DESC"):
                    q.order.append((self.constraint(), d == "ASC"))
                elif self.kind == "var":
                    q.order.append((("var", Var(self.take()[1:])), True))
                elif self.kind == "op" and self.text == "(" or self.kind == "word" and self.text.upper() in BUILTINS or self.kind in ("iri", "name"):
                    q.order.append((self.constraint(), True))
                else:
                    break
            if not q.order:
                self.fail("expected a sort key")
        while w := self.word("LIMIT", "OFFSET"):
            if self.kind != "number" or not self.text.isdigit():
                self.fail(f"{w} needs a whole number")
            setattr(q, w.lower(), int(self.take()))
        if self.kind != "end":
            self.fail("expected the end")
        return q


def parse(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> Query:
    return Parser(text, prefixes, base).query()


__all__ = ["Bnode", "Parser", "SyntaxFault", "parse", "tokenize", "unescape"]

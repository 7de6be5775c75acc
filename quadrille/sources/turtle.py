"""Turtle and N3 writers for graphs that fit on the driver."""

from __future__ import annotations

import re

from ..terms import RDF, TYPE, XSD, Bnode, Iri, Literal, encode

LOCAL = re.compile(r"[^\W\d](?:[\w-]*)$")


def _quoted(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"'


class Writer:
    def __init__(self, triples, prefixes: dict[str, str] | None = None):
        self.prefixes = {"rdf": RDF, "xsd": XSD} | (prefixes or {})
        self.by: dict = {}
        self.uses: dict = {}
        for s, p, o in dict.fromkeys(triples):
            self.by.setdefault(s, []).append((p, o))
            self.uses[o] = self.uses.get(o, 0) + 1
        self.done: set = set()
        self.used: set[str] = set()

    def term(self, t) -> str:
        if isinstance(t, Literal):
            if t.dt in (XSD + "integer", XSD + "boolean") and re.fullmatch(r"-?\d+|true|false", t.lex):
                return t.lex
            return _quoted(t.lex) + (f"^^{self.term(Iri(t.dt))}" if t.dt else f"@{t.lang}" if t.lang else "")
        if isinstance(t, Bnode):
            return f"_:{t}"
        for k, v in self.prefixes.items():
            if t.startswith(v) and LOCAL.match(t[len(v) :]):
                self.used.add(k)
                return f"{k}:{t[len(v):]}"
        return f"<{t}>"

    def items(self, head) -> list | None:
        """The items of a well-formed list of blank cells that nothing else refers to."""
        out, seen = [], set()
        while head != RDF + "nil":
            own = dict(self.by.get(head, []))
            if not isinstance(head, Bnode) or head in seen or len(self.by.get(head, [])) != 2 or set(own) != {RDF + "first", RDF + "rest"} or self.uses.get(head) != 1:
                return None
            seen.add(head)
            out.append(own[RDF + "first"])
            head = own[RDF + "rest"]
        self.done |= seen
        return out

    def node(self, t, depth: int) -> str:
        if t == RDF + "nil":
            return "()"
        if isinstance(t, Bnode) and self.uses.get(t) == 1 and t not in self.done and self.by.get(t):
            if (items := self.items(t)) is not None:
                return "( " + " ".join(self.node(x, depth) for x in items) + " )"
            self.done.add(t)
            return "[ " + self.properties(t, depth + 1) + " ]"
        return self.term(t)

    def properties(self, s, depth: int) -> str:
        groups: dict = {}
        for p, o in sorted(self.by[s], key=lambda x: (x[0] != TYPE, x[0], encode(x[1]))):
            groups.setdefault(p, []).append(o)
        gap = " ;\n" + "    " * depth
        return gap.join(("a" if p == TYPE else self.term(p)) + " " + ", ".join(self.node(o, depth) for o in own) for p, own in groups.items())

    def text(self) -> str:
        inline = lambda s: isinstance(s, Bnode) and self.uses.get(s) == 1
        body = []
        for late in (False, True):  # blank nodes that only refer to each other come last
            for s in sorted(self.by, key=encode):
                if s in self.done or inline(s) != late:
                    continue
                self.done.add(s)
                head = "[]" if isinstance(s, Bnode) and not self.uses.get(s) else self.term(s)
                body.append(f"{head} {self.properties(s, 1)} .")
        return "\n".join([*(f"@prefix {k}: <{v}> ." for k, v in sorted(self.prefixes.items()) if k in self.used), "", *body, ""])


def write(triples, prefixes: dict[str, str] | None = None) -> str:
    return Writer(triples, prefixes).text()


def write_n3(triples, rules=(), prefixes: dict[str, str] | None = None) -> str:
    """N3: the triples, then each (body, head) of triples as a rule."""
    w = Writer(triples, prefixes)
    text = w.text()

    def formula(part) -> str:
        return "{ " + " . ".join(" ".join(f"?{t}" if type(t).__name__ == "Var" else w.term(t) for t in x) for x in part) + " }"

    return text + "".join(f"{formula(b)} => {formula(h)} .\n" for b, h in rules)

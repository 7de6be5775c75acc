"""RDF/XML, TriX and RDFa."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import StringIO
from itertools import count
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import RDF, TYPE, XSD, Bnode, Iri, Literal, encode

XML = "http://www.w3.org/XML/1998/namespace"
TRIX = "http://www.w3.org/2004/03/trix/trix-1/"
XMLNS_LITERAL = RDF + "XMLLiteral"


def _q(tag: str) -> str:
    """A qualified name as an IRI."""
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _RdfXml:
    def __init__(self, base: str):
        self.base, self.fresh, self.out = base, count(), []

    def iri(self, ref: str, base: str) -> Iri:
        return Iri(urljoin(base, ref) if base else ref)

    def node(self, e: ET.Element, base: str, lang: str):
        base = e.get(f"{{{XML}}}base", base)
        lang = e.get(f"{{{XML}}}lang", lang)
        r = lambda n: e.get(f"{{{RDF}}}{n}")
        if r("about") is not None:
            s = self.iri(r("about"), base)
        elif r("ID") is not None:
            s = self.iri("#" + r("ID"), base)
        else:
            s = Bnode(r("nodeID") or f"x{next(self.fresh)}")
        if _q(e.tag) != RDF + "Description":
            self.out.append((s, Iri(TYPE), Iri(_q(e.tag))))
        self.attributes(s, e, base, lang)
        li = count(1)
        for c in e:
            if isinstance(c.tag, str):
                self.property(s, c, base, lang, li)
        return s

    def attributes(self, s, e: ET.Element, base: str, lang: str) -> bool:
        any_ = False
        for k, v in e.attrib.items():
            name = _q(k)
            if name == TYPE:
                self.out.append((s, Iri(TYPE), self.iri(v, base)))
            elif name.startswith(XML) or name.startswith(RDF) and name[len(RDF) :] in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID"):
                continue
            elif k.startswith("{"):
                self.out.append((s, Iri(name), Literal(v, "", lang)))
            else:
                continue
            any_ = True
        return any_

    def property(self, s, e: ET.Element, base: str, lang: str, li) -> None:
        base = e.get(f"{{{XML}}}base", base)
        lang = e.get(f"{{{XML}}}lang", lang)
        p = _q(e.tag)
        p = Iri(RDF + f"_{next(li)}" if p == RDF + "li" else p)
        r = lambda n: e.get(f"{{{RDF}}}{n}")
        children = [c for c in e if isinstance(c.tag, str)]
        kind = r("parseType")
        if kind == "Resource":
            o = Bnode(f"x{next(self.fresh)}")
            inner = count(1)
            for c in children:
                self.property(o, c, base, lang, inner)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in children]
            cells = [Bnode(f"x{next(self.fresh)}") for _ in items] + [Iri(RDF + "nil")]
            for cell, rest, x in zip(cells, cells[1:], items):
                self.out += [(cell, Iri(RDF + "first"), x), (cell, Iri(RDF + "rest"), rest)]
            o = cells[0]
        elif kind is not None:
            o = Literal((e.text or "") + "".join(ET.tostring(c, "unicode") for c in children), XMLNS_LITERAL)
        elif children:
            o = self.node(children[0], base, lang)
        elif r("resource") is not None or r("nodeID") is not None:
            o = self.iri(r("resource"), base) if r("resource") is not None else Bnode(r("nodeID"))
            self.attributes(o, e, base, lang)
        elif any(k.startswith("{") and not _q(k).startswith((XML, RDF)) or _q(k) == TYPE for k in e.attrib):
            o = Bnode(f"x{next(self.fresh)}")
            self.attributes(o, e, base, lang)
        else:
            dt = r("datatype")
            o = Literal(e.text or "", str(self.iri(dt, base)) if dt else "", "" if dt else lang)
        self.out.append((s, p, o))
        if r("ID") is not None:
            t = self.iri("#" + r("ID"), base)
            self.out += [(t, Iri(TYPE), Iri(RDF + "Statement")), (t, Iri(RDF + "subject"), s), (t, Iri(RDF + "predicate"), p), (t, Iri(RDF + "object"), o)]


def _elements(text: str) -> Iterator[tuple[list[ET.Element], bool]]:
    """The open elements from the root to one that begins or ends, and whether it ends."""
    path: list[ET.Element] = []
    for event, e in ET.iterparse(StringIO(text), ("start", "end")):
        if event == "start":
            path.append(e)
        yield path, event == "end"
        if event == "end":
            path.pop()


def stream_rdfxml(text: str, base: str = "") -> Iterator[tuple]:
    """The triples, node element by node element; none is kept once it is read."""
    p = None
    for path, ends in _elements(text):
        root = path[0]
        if p is None:
            p = _RdfXml(root.get(f"{{{XML}}}base", base))
            lang, within = root.get(f"{{{XML}}}lang", ""), int(_q(root.tag) == RDF + "RDF")
        if ends and len(path) == 1 + within:
            p.node(path[-1], p.base, lang)
            yield from p.out
            p.out.clear()
            if within:
                root.remove(path[-1])


def parse_rdfxml(text: str, base: str = "") -> list[tuple]:
    return list(stream_rdfxml(text, base))


def stream_trix(text: str) -> Iterator[tuple]:
    """(s, p, o, graph) of a TriX document, triple by triple; none is kept once it is read."""
    name = ""
    for path, ends in _elements(text):
        if not ends and len(path) == 2:
            name = ""
        elif ends and len(path) == 3:
            e = path[-1]
            kind = _q(e.tag).removeprefix(TRIX)
            if kind == "uri":
                name = (e.text or "").strip()
            elif kind == "triple":
                yield *[_trix_term(x) for x in e], name
            path[-2].remove(e)
        elif ends and len(path) == 2:
            path[-2].remove(path[-1])


def parse_trix(text: str) -> list[tuple]:
    return list(stream_trix(text))


def _trix_term(e: ET.Element):
    kind, text = _q(e.tag).removeprefix(TRIX), e.text or ""
    if kind == "uri":
        return Iri(text.strip())
    if kind == "id":
        return Bnode(text.strip())
    return Literal(text, e.get("datatype", ""), "" if e.get("datatype") else e.get(f"{{{XML}}}lang", ""))


def write_rdfxml(triples, prefixes: dict[str, str] | None = None, pretty: bool = False) -> str:
    """RDF/XML of (s, p, o) terms; pretty gathers a subject's statements and names its element by its type."""
    known = {v: k for k, v in ({"rdf": RDF} | (prefixes or {})).items()}

    def name(iri: str) -> str:
        cut = max(iri.rfind("#"), iri.rfind("/"), iri.rfind(":")) + 1
        prefix = known.setdefault(iri[:cut], f"ns{len(known)}")
        return f"{prefix}:{iri[cut:]}"

    def about(t) -> str:
        return f"rdf:nodeID={quoteattr(str(t))}" if isinstance(t, Bnode) else f"rdf:about={quoteattr(str(t))}"

    def prop(p, o) -> str:
        n = name(p)
        if isinstance(o, Literal):
            extra = f" rdf:datatype={quoteattr(o.dt)}" if o.dt else f" xml:lang={quoteattr(o.lang)}" if o.lang else ""
            return f"    <{n}{extra}>{escape(o.lex)}</{n}>"
        return f"    <{n} {'rdf:nodeID' if isinstance(o, Bnode) else 'rdf:resource'}={quoteattr(str(o))}/>"

    by: dict = {}
    for s, p, o in triples:
        by.setdefault(s, []).append((p, o))
    body = []
    for s, own in sorted(by.items(), key=lambda x: encode(x[0])):
        own = sorted(own, key=lambda x: (x[0], encode(x[1])))
        tag = "rdf:Description"
        if pretty and (types := [x for x in own if x[0] == TYPE and isinstance(x[1], Iri)]):
            tag = name(types[0][1])
            own.remove(types[0])
        body += [f"  <{tag} {about(s)}>", *[prop(p, o) for p, o in own], f"  </{tag}>"]
    ns = "".join(f' xmlns:{k}="{escape(v)}"' for v, k in known.items())
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', f"<rdf:RDF{ns}>", *body, "</rdf:RDF>", ""])


def write_trix(quads) -> str:
    """TriX of (s, p, o, graph) terms."""

    def term(t) -> str:
        if isinstance(t, Iri):
            return f"<uri>{escape(t)}</uri>"
        if isinstance(t, Bnode):
            return f"<id>{escape(t)}</id>"
        if t.dt:
            return f"<typedLiteral datatype={quoteattr(t.dt)}>{escape(t.lex)}</typedLiteral>"
        return f"<plainLiteral{f' xml:lang={quoteattr(t.lang)}' if t.lang else ''}>{escape(t.lex)}</plainLiteral>"

    by: dict = {}
    for s, p, o, g in quads:
        by.setdefault(g, []).append((s, p, o))
    out = [f'<TriX xmlns="{TRIX}">']
    for g, own in sorted(by.items(), key=lambda x: str(x[0])):
        out += [" <graph>", *([f"  <uri>{escape(g)}</uri>"] if g else []), *["  <triple>" + "".join(map(term, t)) + "</triple>" for t in own], " </graph>"]
    return "\n".join([*out, "</TriX>", ""])


class _Rdfa:
    """RDFa attributes of (X)HTML, by a forgiving scan of the tags."""

    def __init__(self, base: str):
        from html.parser import HTMLParser

        outer = self
        self.base, self.out, self.stack, self.fresh = base, [], [], count()

        class Scan(HTMLParser):
            def handle_starttag(self, tag, attrs):
                outer.open(tag, dict(attrs))
                if tag in ("meta", "link", "img", "br", "hr", "input", "base"):
                    outer.close(tag)

            handle_startendtag = lambda self, tag, attrs: (outer.open(tag, dict(attrs)), outer.close(tag))
            handle_endtag = lambda self, tag: outer.close(tag)
            handle_data = lambda self, data: [f["text"].append(data) for f in outer.stack if f["text"] is not None]

        self.scan = Scan(convert_charrefs=True)

    def curie(self, x: str, prefixes: dict) -> Iri | None:
        x = x.strip("[]")
        prefix, colon, local = x.partition(":")
        if colon and prefix in prefixes:
            return Iri(prefixes[prefix] + local)
        if colon and prefix == "_":
            return Bnode(local)
        return Iri(x) if colon else None

    def open(self, tag: str, a: dict) -> None:
        top = self.stack[-1] if self.stack else {"subject": Iri(self.base), "lang": "", "prefixes": {"rdf": RDF, "xsd": XSD, "dc": "http://purl.org/dc/terms/", "foaf": "http://xmlns.com/foaf/0.1/"}, "pending": [], "object": None}
        prefixes = dict(top["prefixes"])
        for k, v in a.items():
            if k.startswith("xmlns:"):
                prefixes[k[6:]] = v or ""
        words = (a.get("prefix") or "").split()
        prefixes |= {k.rstrip(":"): v for k, v in zip(words[::2], words[1::2])}
        if a.get("vocab"):
            prefixes[""] = a["vocab"]
        lang = a.get("xml:lang", a.get("lang", top["lang"])) or ""
        iri = lambda x: Iri(urljoin(self.base, x))
        names = lambda k: [t for x in (a.get(k) or "").split() for t in [self.curie(x, prefixes) or (Iri(prefixes[""] + x) if "" in prefixes else None)] if t]
        target = iri(a["resource"]) if a.get("resource") is not None else iri(a["href"]) if a.get("href") is not None else iri(a["src"]) if a.get("src") is not None else None
        parent = top["object"] or top["subject"]
        rels, revs, types, props = names("rel"), names("rev"), names("typeof"), names("property")
        if a.get("about") is not None:
            subject = (self.curie(a["about"], prefixes) if a["about"].startswith("[") else None) or iri(a["about"])
        elif not (rels or revs) and target is not None and not props:
            subject = target
        elif types and not (rels or revs):
            subject = Bnode(f"r{next(self.fresh)}")
        else:
            subject = parent
        for p, forward in top["pending"]:
            if subject != parent or target is not None:
                o = subject if subject != parent else target
                self.out.append((parent, p, o) if forward else (o, p, parent))
        self.out += [(subject, Iri(TYPE), t) for t in types]
        obj, pending = None, []
        if rels or revs:
            if target is not None:
                self.out += [(subject, p, target) for p in rels] + [(target, p, subject) for p in revs]
                obj = target
            else:
                pending = [(p, True) for p in rels] + [(p, False) for p in revs]
        frame = {"tag": tag, "subject": subject, "object": obj, "lang": lang, "prefixes": prefixes, "pending": pending, "props": props, "text": None}
        if props:
            dt = self.curie(a["datatype"], prefixes) if a.get("datatype") else ""
            frame["dt"] = str(dt or "")
            if a.get("content") is not None:
                self.out += [(subject, p, Literal(a["content"], frame["dt"], "" if dt else lang)) for p in props]
            elif target is not None and not (rels or revs) and "datatype" not in a:
                self.out += [(subject, p, target) for p in props]
            else:
                frame["text"] = []
        self.stack.append(frame)

    def close(self, tag: str) -> None:
        if tag not in [f["tag"] for f in self.stack]:
            return
        while self.stack:
            f = self.stack.pop()
            if f["text"] is not None:
                self.out += [(f["subject"], p, Literal("".join(f["text"]), f["dt"], "" if f["dt"] else f["lang"])) for p in f["props"]]
            if f["tag"] == tag:
                return


def parse_rdfa(text: str, base: str = "") -> list[tuple]:
    r = _Rdfa(base)
    r.scan.feed(text)
    r.scan.close()
    while r.stack:
        r.close(r.stack[-1]["tag"])
    return r.out


def rdfa_quads(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(s, p, o, g) of the RDFa in a table of pages, each page a graph."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(encode(s), encode(p), encode(o), f"<{u}>") for h, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if h for s, p, o in parse_rdfa(h, u or "")]
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4, ["s", "p", "o", "g"])

    return pages.select(F.col(html), F.col(url)).mapInArrow(run, "s string, p string, o string, g string")

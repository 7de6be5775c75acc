"""Query results as JSON, XML and CSV."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..plans.compile import Result

NS = "http://www.w3.org/2005/sparql-results#"


def _binding(c: Column) -> Column:
    tag, dt = T.lang(c), T.datatype(c)
    kind = F.when(T.is_iri(c), "uri").when(T.is_blank(c), "bnode").otherwise("literal")
    return F.when(c.isNotNull(), F.struct(kind.alias("type"), T.lex(c).alias("value"), F.when(tag != "", tag).alias("xml:lang"), F.when(dt != "", dt).alias("datatype")))


def json_rows(r: Result) -> DataFrame:
    """One JSON object of bindings per solution."""
    df = r.df
    return df.select(F.to_json(F.struct(*[_binding(F.col(f"`{v}`")).alias(v) for v in df.columns])).alias("value"))


def to_json(r: Result) -> str:
    if r.form == "ASK":
        return json.dumps({"head": {}, "boolean": bool(r)})
    rows = ",".join(x["value"] for x in json_rows(r).collect())
    return f'{{"head": {json.dumps({"vars": r.df.columns})}, "results": {{"bindings": [{rows}]}}}}'


def to_xml(r: Result) -> str:
    if r.form == "ASK":
        return f'<?xml version="1.0"?>\n<sparql xmlns="{NS}"><head/><boolean>{str(bool(r)).lower()}</boolean></sparql>\n'
    names = r.df.columns
    out = ['<?xml version="1.0"?>', f'<sparql xmlns="{NS}">', "<head>" + "".join(f"<variable name={quoteattr(v)}/>" for v in names) + "</head>", "<results>"]
    for row in r.df.collect():
        cells = []
        for v, x in zip(names, row):
            if x is None:
                continue
            t = T.decode(x)
            if isinstance(t, T.Literal):
                extra = f" datatype={quoteattr(t.dt)}" if t.dt else f" xml:lang={quoteattr(t.lang)}" if t.lang else ""
                own = f"<literal{extra}>{escape(t.lex)}</literal>"
            else:
                own = f"<bnode>{escape(t)}</bnode>" if isinstance(t, T.Bnode) else f"<uri>{escape(t)}</uri>"
            cells.append(f"<binding name={quoteattr(v)}>{own}</binding>")
        out.append("<result>" + "".join(cells) + "</result>")
    return "\n".join([*out, "</results>", "</sparql>", ""])


def write_csv(r: Result, path: str) -> None:
    """Lexical forms, unbound ones empty."""
    r.df.select(*[T.lex(F.col(f"`{v}`")).alias(v) for v in r.df.columns]).write.option("header", True).csv(path)


def to_python(r: Result) -> list:
    """One term per solution for a single variable, else tuples; None where unbound."""
    if r.form == "ASK":
        return [bool(r)]
    rows = [tuple(None if x is None else T.decode(x) for x in row) for row in r.df.collect()]
    return [x[0] for x in rows] if len(r.df.columns) == 1 else rows

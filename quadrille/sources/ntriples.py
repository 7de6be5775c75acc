"""N-Triples and N-Quads, read and written in parallel by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T

IRI = r"<[^<>\"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>\"{}|^`\\\x00-\x20]*)*>"
BLANK = r"_:[^\s<>\"]*[^\s<>\".]"
LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*|\^\^" + IRI + ")?"
LINE = rf"^\s*({IRI}|{BLANK})\s*({IRI})\s*({IRI}|{BLANK}|{LITERAL})\s*({IRI}|{BLANK})?\s*\.\s*(?:#.*)?$"
_ESCAPED = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'"))


def _decoded(c: Column) -> Column:
    """Escapes resolved; a doubled backslash is set aside first."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in _ESCAPED:
        out = F.replace(out, F.lit(a), F.lit(b))
    code = lambda hexes: F.decode(F.unhex(F.lpad(hexes, 8, "0")), "UTF-32")
    split = F.split(out, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})")
    unicode = F.array_join(
        F.transform(
            split,
            lambda x: F.when(x.startswith("\\u"), F.concat(code(F.substring(x, 3, 4)), F.substring(x, F.lit(7), F.length(x))))
            .when(x.startswith("\\U"), F.concat(code(F.substring(x, 3, 8)), F.substring(x, F.lit(11), F.length(x))))
            .otherwise(x),
        ),
        "",
    )
    out = F.when(F.contains(out, F.lit("\\u")) | F.contains(out, F.lit("\\U")), unicode).otherwise(out)
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def _term(c: Column) -> Column:
    """From the written form to the term string; ``^^<dt>`` loses its brackets."""
    plain = F.when(F.contains(c, F.lit('"^^<')) & c.rlike(r"\^\^<[^\"]*>$"), F.regexp_replace(c, r"\^\^<([^\"]*)>$", r"^^$1")).otherwise(c)
    return F.when(F.contains(c, F.lit("\\")), _decoded(plain)).otherwise(plain)


def parse_lines(lines: DataFrame, graph: Column | str = "") -> DataFrame:
    """(s, p, o, g) of a column of lines; comments and blank lines are left out, anything else must parse."""
    line = F.col(lines.columns[0])
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    # one match a line: no part holds a line break, so that breaks tell the parts from each other
    rows = rows.select("*", F.split(F.regexp_replace(line, LINE, "$1\n$2\n$3\n$4\n"), "\n").alias("_parts"))
    broken = F.contains(line, F.lit("\n"))
    part = lambda k: F.when(broken, F.regexp_extract(line, LINE, k)).when(F.size("_parts") == 5, F.get("_parts", F.lit(k - 1))).otherwise("")
    fault = F.raise_error(F.concat(F.lit("not a statement: "), line))
    g = graph if isinstance(graph, Column) else F.lit(f"<{graph}>" if graph else "")
    out = rows.select(F.when(part(1) != "", _term(part(1))).otherwise(fault.cast("string")).alias("s"), _term(part(2)).alias("p"), _term(part(3)).alias("o"), F.when(part(4) != "", _term(part(4))).otherwise(g).alias("g"))
    return out


def read(spark: SparkSession, path: str, graph: str = "", graph_from_file: bool = False) -> DataFrame:
    """The quads of files; a file's name can name its graph."""
    lines = spark.read.text(path)
    if not graph_from_file:
        return parse_lines(lines, graph)
    named = lines.select("value", F.concat(F.lit("<"), F.input_file_name(), F.lit(">")).alias("_file"))
    return parse_lines(named, F.col("_file"))


def _written(c: Column) -> Column:
    s = T.suffix(c)
    body = T.lex(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(a), F.lit(b))
    tail = F.when(s.startswith("^^"), F.concat(F.lit("^^<"), F.substring(s, F.lit(3), F.length(s)), F.lit(">"))).otherwise(s)
    return F.when(T.is_literal(c), F.concat(F.lit('"'), body, F.lit('"'), tail)).otherwise(c)


def lines(quads: DataFrame) -> DataFrame:
    """One line per row; a fourth term where ``g`` isn't empty."""
    g = F.when(F.col("g") != "", F.concat(F.lit(" "), "g")).otherwise("") if "g" in quads.columns else F.lit("")
    return quads.select(F.concat(_written(F.col("s")), F.lit(" "), "p", F.lit(" "), _written(F.col("o")), g, F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    lines(quads).write.text(path)

"""Reading and writing graphs by format, whole folders, and tables on disk."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import components
from ..terms import decode, encode
from . import n3, ntriples, turtle, xmlformats

FORMATS = {".nt": "nt", ".nq": "nt", ".ttl": "n3", ".n3": "n3", ".rdf": "xml", ".owl": "xml", ".xml": "xml", ".trix": "trix", ".html": "rdfa", ".xhtml": "rdfa"}
SCHEMA = "s string, p string, o string, g string"
#: How many triples a document of ``write_folder`` has about, and how many a batch of the parsers' has at most.
DOCUMENT, BATCH = 50_000, 10_000


def parse_text(text: str, form: str, base: str = "", graph: str = "") -> Iterator[tuple[str, str, str, str]]:
    """A document's quads as term strings, as they are read. Blank labels are the document's own."""
    if not text.strip():
        return
    if form == "n3":
        found = n3.N3Parser(text, base).stream()
    elif form == "xml":
        found = xmlformats.stream_rdfxml(text, base)
    elif form == "trix":
        found = xmlformats.stream_trix(text)
    elif form == "rdfa":
        found = xmlformats.parse_rdfa(text, base)
    else:
        raise ValueError(f"unknown format {form}")
    for t in found:
        if not any(isinstance(x, n3.Formula) for x in t):
            yield encode(t[0]), encode(t[1]), encode(t[2]), f"<{t[3] if len(t) > 3 and t[3] else graph}>" if (len(t) > 3 and t[3]) or graph else ""


def read(spark: SparkSession, path: str, form: str | None = None, graph: str = "") -> DataFrame:
    """The quads of a file or glob. N-Triples are read by line in parallel; other formats file by file, each
    file a task's row, blank labels kept apart by file."""
    form = form or FORMATS[Path(path).suffix]
    if form == "nt":
        return ntriples.read(spark, path, graph)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                where = b.column(0)[k].as_py()
                found = parse_text(b.column(1)[k].as_py().decode("utf-8"), form, where, graph)
                while rows := list(islice(found, BATCH)):
                    yield pa.record_batch([*[pa.array(c, pa.string()) for c in zip(*rows)], pa.array([where] * len(rows), pa.string())], ["s", "p", "o", "g", "file"])

    rows = files.mapInArrow(run, SCHEMA + ", file string")
    apart = lambda c: F.when(F.col(c).startswith("_:"), F.concat(c, F.lit("_"), F.substring(F.sha1("file"), 1, 8))).otherwise(F.col(c)).alias(c)
    return rows.select(apart("s"), "p", apart("o"), "g").distinct()


def read_folder(spark: SparkSession, folder: str, graph_from_file: bool = True) -> DataFrame:
    """All files with a known extension below a folder; a file's name names its graph. A folder of documents with such
    an extension, as ``write_folder`` makes it, counts as one file."""
    parts = []
    for suffix, form in FORMATS.items():
        found = sorted(Path(folder).rglob("*" + suffix))
        for f in [f for f in found if f.is_dir()]:
            found.remove(f)
            if any(f.glob("part-*")):
                parts.append(read(spark, f"{f}/part-*", form, f.resolve().as_uri() if graph_from_file else ""))
        for f in found if form != "nt" else []:
            parts.append(read(spark, str(f), form, f.resolve().as_uri() if graph_from_file else ""))
        if found and form == "nt":
            parts.append(ntriples.read(spark, [str(f) for f in found], graph_from_file=graph_from_file))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def save(quads: DataFrame, path: str) -> None:
    """Quads as Parquet, a folder per predicate and sorted by subject, each quad once: a pattern with a
    constant predicate reads one folder."""
    rows = quads.select("s", "p", "o", "g").distinct()
    rows.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("p", "s").write.partitionBy("p").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s string, o string, g string, p string").parquet(path).select("s", "p", "o", "g")


def serialize(quads: DataFrame, form: str, prefixes: dict[str, str] | None = None) -> str:
    """A graph that fits on the driver, as text."""
    rows = [(decode(r["s"]), decode(r["p"]), decode(r["o"])) for r in quads.select("s", "p", "o").distinct().collect()]
    if form == "n3":
        return turtle.write(rows, prefixes)
    if form in ("xml", "pretty-xml"):
        return xmlformats.write_rdfxml(rows, prefixes, form == "pretty-xml")
    if form == "nt":
        return "\n".join(sorted(r["value"] for r in ntriples.lines(quads.select("s", "p", "o").distinct()).collect())) + "\n"
    if form == "trix":
        return xmlformats.write_trix([(decode(r["s"]), decode(r["p"]), decode(r["o"]), r["g"][1:-1]) for r in quads.collect()])
    raise ValueError(f"unknown format {form}")


def _apart(rows: DataFrame, documents: int) -> DataFrame:
    """Triples with blank nodes in one partition for all that are linked by these."""
    blank = lambda c: F.col(c).startswith("_:")
    linked = components(rows.where(blank("s") & blank("o")).select(F.col("s").alias("a"), F.col("o").alias("b"))).toDF("node", "component")
    own = rows.withColumn("node", F.when(blank("s"), F.col("s")).otherwise(F.col("o"))).join(linked, "node", "left")
    return own.repartition(documents, F.coalesce("component", "node")).select(*rows.columns)


def write_folder(quads: DataFrame, path: str, form: str, documents: int | None = None, prefixes: dict[str, str] | None = None) -> None:
    """A graph of any size as a folder of documents, each written by a task from neighbouring triples in the order of
    their terms. There are as many documents as keep each at about ``DOCUMENT`` triples, unless their number is given.

    Labels of blank nodes hold within a document, so triples that blank nodes link lie in one document, however
    many they are; N-Triples have no documents and no such limit."""
    if form == "nt":
        ntriples.write(quads, path)
        return
    if form not in ("n3", "xml", "pretty-xml", "trix"):
        raise ValueError(f"unknown format {form}")
    blank = F.col("s").startswith("_:") | F.col("o").startswith("_:")
    many, loose = quads.agg(F.count(F.lit(1)), F.count(F.when(blank, 1))).first()
    share = lambda n: documents or -(-n // DOCUMENT) or 1

    def run(batches):
        rows = [tuple(decode(c) if c else None for c in r) for b in batches for r in zip(*[x.to_pylist() for x in b.columns])]
        if rows:
            if form == "trix":
                text = xmlformats.write_trix([(s, p, o, g or "") for s, p, o, g in rows])
            else:
                text = turtle.write([r[:3] for r in rows], prefixes) if form == "n3" else xmlformats.write_rdfxml([r[:3] for r in rows], prefixes, form == "pretty-xml")
            yield pa.record_batch([pa.array([text], pa.string())], ["value"])

    rows = quads.select("s", "p", "o", "g") if form == "trix" else quads.select("s", "p", "o", F.lit("").alias("g"))
    rows = rows.distinct()
    if documents == 1 or not many:
        parts = rows.repartition(1)
    else:
        parts = rows.where(~blank).repartitionByRange(share(many - loose), "s", "p", "o")
        if loose:
            parts = parts.union(_apart(rows.where(blank), share(loose)))
    parts.mapInArrow(run, "value string").write.text(path)


def convert(spark: SparkSession, source: str, target: str, form: str | None = None) -> None:
    """One file in another format."""
    text = serialize(read(spark, source), form or FORMATS[Path(target).suffix])
    Path(target).write_text(text, encoding="utf-8")

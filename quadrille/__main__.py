"""Command line: convert files, run queries and rules.

    python -m quadrille convert IN OUT
    python -m quadrille query DATA QUERY_FILE [json|xml|csv:DIR]
    python -m quadrille rules DATA RULES.n3 [closure|derived|firings] [--owl ONTOLOGY]
    python -m quadrille load DATA STORE
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.stores import QuadStore
from .plans.compile import Engine
from .rules.ast import from_n3
from .rules.engine import Engine as Rules
from .rules.owl import rules_from
from .sources import loader, n3, results


def data(spark: SparkSession, path: str):
    """A folder that ``load`` wrote, a folder of files, or a file."""
    p = Path(path)
    if p.is_dir():
        return loader.load(spark, path) if any(p.glob("p=*")) else loader.read_folder(spark, path)
    return loader.read(spark, path)


def main(args: list[str]) -> str:
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    what, rest = (args[0], args[1:]) if args else ("", [])
    if what == "convert":
        loader.convert(spark, *rest[:2])
        return ""
    if what == "load":
        loader.save(data(spark, rest[0]), rest[1])
        return ""
    if what == "query":
        r = Engine(QuadStore(data(spark, rest[0]))).query(Path(rest[1]).read_text())
        form = rest[2] if len(rest) > 2 else "json"
        if form.startswith("csv:"):
            results.write_csv(r, form[4:])
            return ""
        if r.triples is not None:
            return loader.serialize(r.triples, "nt" if form == "json" else "xml")
        return results.to_json(r) if form == "json" else results.to_xml(r)
    if what == "rules":
        owl = rest[rest.index("--owl") + 1] if "--owl" in rest else None
        form = rest[2] if len(rest) > 2 and not rest[2].startswith("--") else "closure"
        rules = from_n3(n3.parse(Path(rest[1]).read_text())) + (rules_from(n3.parse(Path(owl).read_text()).triples) if owl else [])
        out = Rules(rules, provenance=form == "firings").run(data(spark, rest[0]))
        if form == "firings":
            return "\n".join(f"{n}\t{rule}" for rule, n in sorted(out.firings.items()))
        return loader.serialize((out.known if form == "closure" else out.derived).select("s", "p", "o", F.lit("").alias("g")), "nt")
    raise SystemExit(__doc__)


if __name__ == "__main__":
    print(main(sys.argv[1:]))

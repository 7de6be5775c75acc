"""The driver's relational tables as one graph below http://ex/."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import MappedStore, TableMap
from ..terms import XSD, Desc

EX = "http://ex/"
_TYPES = {"bigint": "integer", "int": "integer", "double": "double", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "boolean": "boolean"}
#: table: (key columns, foreign keys by column)
KEYS: dict[str, tuple[list[str], dict[str, str]]] = {
    "region": (["r_regionkey"], {}),
    "nation": (["n_nationkey"], {"n_regionkey": "region"}),
    "customer": (["c_custkey"], {"c_nationkey": "nation"}),
    "supplier": (["s_suppkey"], {"s_nationkey": "nation"}),
    "part": (["p_partkey"], {}),
    "orders": (["o_orderkey"], {"o_custkey": "customer"}),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": (["event_id"], {}),
    "documents": (["doc_id"], {}),
    "labels": (["doc_id"], {}),
    "pages": (["page_id"], {}),
    "benchmark": (["item_id"], {}),
    "conversations": (["conv_id", "turn"], {}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def direct_map(name: str, df: DataFrame, keys: list[str], links: dict[str, str], **options) -> TableMap:
    """A row is an IRI, a column a predicate; foreign keys point at other tables' rows."""
    key = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("_", *keys)
    columns = {}
    for c, kind in df.dtypes:
        if c in links:
            columns[EX + c] = (Desc("U", f"{EX}{links[c]}/"), F.col(c))
        elif kind in _TYPES or kind == "string":
            columns[EX + c] = (Desc("L", dt=XSD + _TYPES[kind] if kind in _TYPES else ""), F.col(c))
    return TableMap(df, f"{EX}{name}/", key, options.pop("rdf_class", EX + name.capitalize()), columns, **options)


def graph(spark: SparkSession, sf_dir: str, *names: str) -> MappedStore:
    """The named tables, all by default. Each event lies in a graph named by its type; a document's text is
    tagged with its language, and its labels are statements on the document."""
    maps = []
    for name in names or KEYS:
        keys, links = KEYS[name]
        df = table(spark, sf_dir, name)
        if name == "events":
            maps.append(direct_map(name, df, keys, links, graph=(Desc("U", EX + "graph/"), F.col("event_type"))))
        elif name == "documents":
            m = direct_map(name, df, keys, links)
            m.columns[EX + "text"] = (Desc(), F.concat(F.lit('"'), "text", F.lit('"@'), "lang"))
            maps.append(m)
        elif name == "labels":
            m = direct_map(name, df, keys, links, rdf_class="")
            m.prefix = EX + "documents/"
            m.columns.pop(EX + "doc_id")
            maps.append(m)
        else:
            maps.append(direct_map(name, df, keys, links))
    return MappedStore(maps)

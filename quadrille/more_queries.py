"""Further registered queries: scans, formats, lists, built-ins and services over the driver's tables."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .operators import closure, text
from .operators.graph import Collection, Graph, Namespaces
from .operators.stores import QuadStore
from .plans.algebra import features
from .plans.compile import Engine
from .plans.parser import parse as parse_query
from .queries import ANCESTOR, PREFIXES, _graph, _key, _part_facts, _parts, _PARTS, _rules, _spread, query, sparql
from .rules import ast as R
from .rules import magic, owl
from .rules.engine import Engine as Rules
from .service import Service
from .sources import loader, n3, ntriples, results, xmlformats
from .sources.tables import EX, graph, table
from .storage import new_folder, written
from .streaming.ingest import Changes
from .terms import RDF, TYPE, XSD, Iri, Literal, Var, is_blank, is_iri, is_literal, is_pattern, is_statement, lex


def _iri(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"<{EX}{kind}/"), key, F.lit(">"))


def _local(c: str, name: str):
    return F.regexp_extract(c, "([A-Za-z_]+)>$", 1).alias(name)


# -- scans --


@query("SELECT event_id AS s, unnest(['user_id', 'value']) AS p FROM events WHERE event_type LIKE 'cl%' OR event_type LIKE 'pu%'")
def regex_predicate_and_graph(spark, sf):
    """Compiled patterns for the predicate and the graph."""
    found = _graph(spark, sf, "events").quads(None, re.compile(".*/(user_id|value)$"), None, re.compile(".*/(cl|pu)"))
    return found.select(_key("s"), _local("p", "p"))


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7 AND c_mktsegment = 'BUILDING') AS building, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3) AS lives, false AS other")
def membership(spark, sf):
    g = _graph(spark, sf, "customer")
    row = (g.contains(Iri(EX + "customer/7"), Iri(EX + "c_mktsegment"), Literal("BUILDING")), g.contains(None, Iri(EX + "c_nationkey"), Iri(EX + "nation/3")), g.contains(None, Iri(EX + "c_nationkey"), Iri(EX + "region/3")))
    return spark.createDataFrame([row], "building boolean, lives boolean, other boolean")


@query("SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1")
def project_subjects(spark, sf):
    return _graph(spark, sf, "nation").subjects(Iri(EX + "n_regionkey"), Iri(EX + "region/1")).select(_key("s", "n", "int"))


@query("SELECT column_name AS p FROM (DESCRIBE customer) UNION ALL SELECT 'type'")
def project_predicates(spark, sf):
    return _graph(spark, sf, "customer").predicates().distinct().select(F.regexp_extract("p", "([A-Za-z_]+)>$", 1).alias("p"))


@query("SELECT DISTINCT c_nationkey AS n FROM customer")
def project_objects(spark, sf):
    return _graph(spark, sf, "customer").objects(None, Iri(EX + "c_nationkey")).distinct().select(_key("o", "n", "int"))


@query("SELECT c_custkey AS c, 'c_nationkey' AS p FROM customer WHERE c_nationkey = 4")
def project_subject_predicates(spark, sf):
    return _graph(spark, sf, "customer").subject_predicates(Iri(EX + "nation/4")).select(_key("s", "c"), _local("p", "p"))


@query("SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment']) AS p, unnest([c_custkey::VARCHAR, c_name, c_mktsegment]) AS v FROM customer WHERE c_custkey = 11")
def project_predicate_objects(spark, sf):
    found = _graph(spark, sf, "customer").predicate_objects(Iri(EX + "customer/11")).select(_local("p", "p"), lex(F.col("o")).alias("v"))
    return found.where(F.col("p").isin("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT c_custkey AS x FROM customer WHERE (c_custkey * c_custkey) % 1000 = c_custkey % 1000")
def variable_twice_in_a_pattern(spark, sf):
    """Customers and the square of their number, both modulo 1000: a pattern with one variable at both ends."""
    c = table(spark, sf, "customer")
    at = lambda x: F.concat(F.lit(f"<{EX}slot/"), F.pmod(x, F.lit(1000)), F.lit(">"))
    quads = c.select(at(F.col("c_custkey")).alias("s"), F.concat(F.lit(f"<{EX}by/"), "c_custkey", F.lit(">")).alias("p"), at(F.col("c_custkey") * F.col("c_custkey")).alias("o"), F.lit("").alias("g"))
    found = Engine(QuadStore(quads, False), PREFIXES).query("SELECT ?p { ?x ?p ?x }").solutions.texts()
    return found.select(F.regexp_extract("p", "([0-9]+)$", 1).cast("long").alias("x"))


@query("SELECT user_id AS u, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS contexts FROM events GROUP BY user_id")
def contexts_of_triples(spark, sf):
    """Each statement once, with all graphs that hold it."""
    df = table(spark, sf, "events")
    g = Graph(df.select(_iri("user", "user_id").alias("s"), F.lit(f"<{EX}is>").alias("p"), F.lit('"active"').alias("o"), _iri("graph", "event_type").alias("g")).distinct())
    return g.resolved().select(_key("s", "u"), F.array_join(F.transform("contexts", lambda x: F.regexp_extract(x, "([a-z]+)>$", 1)), ",").alias("contexts"))


@query("SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'")
def stored_partitions(spark, sf):
    """Loaded twice into a store that has a folder per predicate, and queried there: each quad counts once."""
    quads = _graph(spark, sf, "orders").quads_df.where(F.col("p").isin(f"<{EX}o_custkey>", f"<{EX}o_orderstatus>"))
    path = new_folder(spark, "store")
    loader.save(quads.union(quads), path)
    found = Engine(QuadStore(loader.load(spark, path), False), PREFIXES).query("SELECT ?c ?o { ?o :o_custkey ?c ; :o_orderstatus 'F' }").solutions.texts()
    return found.select(F.regexp_extract("c", "([0-9]+)$", 1).cast("long").alias("c"), F.regexp_extract("o", "([0-9]+)$", 1).cast("long").alias("o"))


@query("SELECT n_nationkey AS n FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 5 = 2")
def lax_datatypes(spark, sf):
    """A plain literal in a pattern matches the typed literals of its form only if datatypes are lax."""
    n = table(spark, sf, "nation")
    quads = n.select(_iri("nation", "n_nationkey").alias("s"), F.lit(f"<{EX}rest>").alias("p"), F.concat(F.lit('"'), F.expr("n_nationkey % 5"), F.lit('"'), F.when(F.col("n_nationkey") >= 10, F.lit(f"^^{XSD}integer")).otherwise("")).alias("o"), F.lit("").alias("g"))
    ask = "SELECT ?n { ?n :rest '2' }"
    lax, strict = (Engine(QuadStore(quads, False, lax=x), PREFIXES).query(ask).solutions.texts() for x in (True, False))
    return lax.exceptAll(strict).select(F.regexp_extract("n", "([0-9]+)$", 1).cast("int").alias("n"))


sparql("codepoint_escapes", "nation", "SELECT ?n { ?c :n_n\\u0061me ?n FILTER(?n != 'NATION_\\u0033') }", "SELECT n_name AS n FROM nation WHERE n_name <> 'NATION_3'")


# -- formats --

_CUSTOMERS = "SELECT c_custkey AS c, c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer"


def _customers(quads: DataFrame) -> DataFrame:
    """Customers read off quads."""
    value = lambda p: F.max(F.when(F.col("p") == f"<{EX}{p}>", lex(F.col("o"))))
    rows = quads.groupBy("s").agg(value("c_name").alias("name"), value("c_acctbal").cast("double").alias("balance"), F.regexp_extract(value("c_nationkey"), "([0-9]+)$", 1).cast("int").alias("nation"))
    return rows.select(_key("s", "c"), "name", "balance", "nation")


@query(_CUSTOMERS)
def ntriples_values(spark, sf):
    return _customers(ntriples.parse_lines(ntriples.lines(_spread(spark, sf, "customer").quads_df)))


def _through(form: str, suffix: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = new_folder(spark, "documents")
        loader.write_folder(_graph(spark, sf, "customer").quads_df, path, form, prefixes={"ex": EX})
        return _customers(loader.read(spark, f"{path}/part-*", suffix))

    run.__doc__ = "Customers written as a folder of documents by the executors, and parsed again."
    return run


for _name, _form, _parser in (("turtle_documents", "n3", "n3"), ("rdfxml_documents", "xml", "xml"), ("pretty_rdfxml_documents", "pretty-xml", "xml"), ("trix_documents", "trix", "trix")):
    _run = _through(_form, _parser)
    _run.__name__ = _name
    query(_CUSTOMERS)(_run)


@query("SELECT page_id AS page, url, url AS graph FROM pages")
def rdfa_pages(spark, sf):
    """The real pages, each with a statement about itself in front, parsed for RDFa."""
    pages = table(spark, sf, "pages").select("url", F.concat(F.lit(f'<div xmlns:ex="{EX}" about=""><span property="ex:page" content="'), "page_id", F.lit('"></span></div>'), "html").alias("html"))
    found = xmlformats.rdfa_quads(pages).where(F.col("p") == f"<{EX}page>")
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    return found.select(lex(F.col("o")).cast("long").alias("page"), inner("s").alias("url"), inner("g").alias("graph"))


@query("SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def results_as_json(spark, sf):
    r = Engine(graph(spark, sf, "customer", "nation"), PREFIXES).query("SELECT ?name ?nation { ?c :c_name ?name ; :c_acctbal ?b ; :c_nationkey ?n . ?n :n_name ?nation FILTER(?b > 0) }")
    return results.json_rows(r).select(F.get_json_object("value", "$.name.value").alias("name"), F.get_json_object("value", "$.nation.value").alias("nation"))


@query("SELECT d.doc_id::VARCHAR AS d, quality::VARCHAR AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def results_as_csv(spark, sf):
    r = Engine(graph(spark, sf, "documents", "labels"), PREFIXES).query("SELECT ?d ?q { ?x :doc_id ?d OPTIONAL { ?x :quality ?q } }")
    path = new_folder(spark, "csv")
    results.write_csv(r, path)
    return spark.read.csv(path, header=True)


@query("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def results_as_xml(spark, sf):
    r = Engine(graph(spark, sf, "nation", "region"), PREFIXES).query("SELECT ?n ?r { ?x :n_name ?n ; :n_regionkey ?y . ?y :r_name ?r }")
    rows = [tuple(b.findtext("{*}literal") for b in x) for x in ET.fromstring(results.to_xml(r)).iter("{%s}result" % results.NS)]
    return spark.createDataFrame(rows, "n string, r string")


@query("SELECT 'a' AS file, count(*) AS triples FROM customer UNION ALL SELECT 'b', count(*) FROM nation UNION ALL SELECT 'c', count(*) FROM region")
def folder_of_formats(spark, sf):
    """A folder with documents in each of three formats, written and read by the executors; their name names their graph."""
    path = new_folder(spark, "mixed")
    for name, t, p, form in (("a.ttl", "customer", "c_name", "n3"), ("b.rdf", "nation", "n_name", "xml"), ("c.nt", "region", "r_name", "nt")):
        loader.write_folder(_graph(spark, sf, t).quads(None, Iri(EX + p), None), f"{path}/{name}", form)
    return loader.read_folder(spark, path.removeprefix("file://")).groupBy(F.regexp_extract("g", "([a-z])[.][a-z]+>$", 1).alias("file")).agg(F.count(F.lit(1)).alias("triples"))


@query("SELECT n_nationkey AS n, n_name AS name FROM nation")
def converted_file(spark, sf):
    from pathlib import Path

    path = Path(new_folder(spark, "converted").removeprefix("file://"))
    path.mkdir(parents=True)
    (path / "n.nt").write_text(loader.serialize(_graph(spark, sf, "nation").quads(None, Iri(EX + "n_name"), None), "nt"), encoding="utf-8")
    loader.convert(spark, f"{path}/n.nt", f"{path}/n.rdf")
    return loader.read(spark, f"{path}/n.rdf").select(_key("s", "n", "int"), lex(F.col("o")).alias("name"))


# -- structure --


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT b AS node FROM e WHERE a IN (90, 91) UNION SELECT e.b FROM t JOIN e ON node = a) SELECT * FROM t")
def generic_closure(spark, sf):
    e = _parts(spark, sf)
    return closure.transitive_generic(lambda nodes: e.join(nodes.toDF("a"), "a").select("b"), spark.createDataFrame([(90,), (91,)], "node long")).toDF("node")


def _turns(spark, sf) -> Graph:
    """Conversation 3 as a list of its roles, beside all others."""
    df = table(spark, sf, "conversations")
    cell = lambda t: F.concat(F.lit("_:c"), "conv_id", F.lit("_"), t.cast("string"))
    rows = df.join(df.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    first = rows.select(cell(F.col("turn")).alias("s"), F.lit(f"<{RDF}first>").alias("p"), F.concat(F.lit('"'), "role", F.lit('"')).alias("o"), F.lit("").alias("g"))
    rest = rows.select(cell(F.col("turn")), F.lit(f"<{RDF}rest>"), F.when(F.col("turn") < F.col("last"), cell(F.col("turn") + 1)).otherwise(f"<{RDF}nil>"), F.lit(""))
    return Graph(written(first.union(rest), "turns"))


@query("WITH t AS (SELECT row_number() OVER (ORDER BY turn) - 1 AS k, role FROM conversations WHERE conv_id = 3) SELECT CASE WHEN k = 0 THEN 0 ELSE k - 1 END AS position, CASE WHEN k = 0 THEN 'opened' ELSE role END AS item FROM t WHERE k <> 1 UNION ALL SELECT max(k), 'closed' FROM t UNION ALL SELECT max(k) + 1, 'archived' FROM t")
def collection_edits(spark, sf):
    """A list whose first item is replaced, whose second is removed, and which two items are appended to."""
    from .terms import Bnode

    first = table(spark, sf, "conversations").where("conv_id = 3").agg(F.min("turn")).first()[0]
    c = Collection(_turns(spark, sf), Bnode(f"c3_{first}")).set(0, Literal("opened")).append(Literal("closed"), Literal("archived")).delete(1)
    return c.graph.items(c.head).select(F.col("position").cast("long").alias("position"), lex(F.col("item")).alias("item"))


@query("SELECT DISTINCT conv_id AS c FROM conversations WHERE role = 'user'")
def on_collection(spark, sf):
    """The lists that hold an item."""
    return _turns(spark, sf).on_collection(Literal("user")).select(F.regexp_extract("head", "c([0-9]+)_", 1).cast("long").alias("c"))


@query("SELECT true AS same, false AS other")
def ground_isomorphism(spark, sf):
    g = _graph(spark, sf, "nation")
    return spark.createDataFrame([(g.same_ground(Graph(g.quads_df.repartition(3))), g.same_ground(g.remove(Iri(EX + "nation/3"))))], "same boolean, other boolean")


@query("SELECT false AS cycles, true AS shifted")
def isomorphism_of_cycles(spark, sf):
    """Nations in cycles of blank nodes without names: five rings of five aren't one of 25, though every node looks
    alike; a ring is like itself turned round."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))

    def ring(prefix: str, size: int) -> Graph:
        node = lambda k: F.concat(F.lit(f"_:{prefix}"), k.cast("string"))
        after = F.expr(f"k - k % {size} + (k % {size} + 1) % {size}")
        return Graph(n.select(node(F.col("k")).alias("s"), F.lit(f"<{EX}next>").alias("p"), node(after).alias("o"), F.lit("").alias("g")))

    return spark.createDataFrame([(ring("a", 5).isomorphic(ring("b", 25)), ring("a", 25).isomorphic(ring("z", 25)))], "cycles boolean, shifted boolean")


@query("SELECT 'ex:' || column_name AS name FROM (DESCRIBE orders) UNION ALL SELECT 'rdf:type'")
def qualified_names(spark, sf):
    names = Namespaces({"ex": EX})
    found = _graph(spark, sf, "orders").predicates().distinct().collect()  # one row a predicate
    return spark.createDataFrame([(names.qname(r["p"][1:-1]),) for r in found], "name string")


@query("SELECT c_custkey AS k, 'customer' AS kind FROM customer WHERE c_custkey = 17 UNION ALL SELECT n_nationkey, 'nation' FROM nation, customer WHERE c_custkey = 17 AND n_nationkey = c_nationkey UNION ALL SELECT n_regionkey, 'region' FROM nation, customer WHERE c_custkey = 17 AND n_nationkey = c_nationkey")
def cluster(spark, sf):
    """What is found from a customer by going on from objects."""
    found = _graph(spark, sf, "customer", "nation", "region").cluster(Iri(EX + "customer/17")).select("s").distinct()
    return found.select(_key("s", "k"), F.regexp_extract("s", "/([a-z]+)/[0-9]+>$", 1).alias("kind"))


@query("SELECT 'SELECT' AS form, 3 AS triples, 1 AS optional, 1 AS union_, 2 AS filter, 10 AS limit_")
def query_features(spark, sf):
    f = features(parse_query("PREFIX : <http://ex/> SELECT ?x { ?x :a ?y OPTIONAL { ?x :b ?z FILTER(?z > 1) } { FILTER(?y > 2) } UNION { ?x :c ?y } } LIMIT 10"))
    return spark.createDataFrame([(f["form"], f["triples"], f["optional"], f["union"], f["filter"], f["limit"])], "form string, triples int, optional int, union_ int, filter int, limit_ int")


@query("SELECT o_orderkey AS o, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS shown, strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S+05:30') AS there FROM orders")
def web_dates(spark, sf):
    """Dates shown and read back, in two zones; what differs would be NULL."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), seconds.alias("t"))
    rows = rows.select("o", "t", dates.date_time(F.col("t")).alias("shown"), dates.date_time(F.col("t"), 330).alias("there"))
    same = (dates.parse_date_time(F.col("shown")) == F.col("t")) & (dates.parse_date_time(F.col("there")) == F.col("t"))
    return rows.select("o", F.when(same, F.col("t")).alias("seconds"), "shown", "there")


@query("SELECT count(*) * 6 AS statements, count(*) * 7 AS patterns, count(*) AS literals FROM customer")
def checked_statements(spark, sf):
    """The customers' statements, and as many with a literal for a subject."""
    q = _graph(spark, sf, "customer").quads_df
    names = q.where(F.col("p") == f"<{EX}c_name>")
    rows = q.select("s", "p", "o").union(names.select("o", "p", "s")).union(names.select("s", F.lit(None).cast("string"), "o"))
    ok = F.count(F.when(is_statement(F.col("s"), F.col("p"), F.col("o")), 1))
    return rows.agg(ok.alias("statements"), F.count(F.when(is_pattern(F.col("s"), F.col("p"), F.col("o")), 1)).alias("patterns"), F.count(F.when(is_literal(F.col("s")) & ~is_iri(F.col("s")) & ~is_blank(F.col("s")), 1)).alias("literals"))


@query(r"WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents WHERE doc_id % 3 <> 1) SELECT term, count(*) AS n FROM w WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ") GROUP BY term")
def text_index_maintained(spark, sf):
    """An index of two thirds of the documents is made by removing one third from it and adding another again."""
    t = _graph(spark, sf, "documents").quads(None, Iri(EX + "text"), None).select("s", "p", "o")
    third = F.pmod(F.regexp_extract("s", "([0-9]+)>$", 1).cast("long"), F.lit(3))
    t = written(text.word_lists(t), "words")  # the texts are cut into words once
    lists = text.without_words(t, t.where(third != 0), t.where(third == 0))
    return text.postings(text.with_words(lists, t.where(third == 2))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS n, 'here' AS name FROM nation WHERE n_nationkey = 2 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 2")
def set_value(spark, sf):
    g = _graph(spark, sf, "nation").set(Iri(EX + "nation/2"), Iri(EX + "n_name"), Literal("here"))
    return g.subject_objects(Iri(EX + "n_name")).select(_key("s", "n", "int"), lex(F.col("o")).alias("name"))


@query("SELECT event_type AS g, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type")
def remove_context(spark, sf):
    g = _graph(spark, sf, "events").remove_context(EX + "graph/click")
    return g.quads(None, Iri(EX + "user_id"), None).groupBy(F.regexp_extract("g", "([a-z]+)>$", 1).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'add' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'remove', count(*) FROM region UNION ALL SELECT 'any', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def change_events(spark, sf):
    """Subscribers to additions, removals and both."""
    heard: list[tuple[str, DataFrame]] = []
    changes = Changes()
    for kinds in (("add",), ("remove",), ()):
        changes.subscribe(lambda kind, quads, name=(kinds or ("any",))[0]: heard.append((name, quads)), *kinds)
    changes.dispatch("add", _graph(spark, sf, "nation").quads(None, Iri(EX + "n_name"), None))
    changes.dispatch("remove", _graph(spark, sf, "region").quads(None, Iri(EX + "r_name"), None))
    rows = [q.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n")) for name, q in heard]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("kind").agg(F.sum("n").alias("n"))


# -- rules --


@query("SELECT 'near' AS rule, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'far', count(DISTINCT c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_firings(spark, sf):
    rules = _rules("{ ?x :c_nationkey ?n . ?n :n_regionkey ?r } => { ?x :in ?r } . { ?x :in ?r } => { ?x a :Placed } .")
    rules = [R.Rule(r.head, r.body, name) for r, name in zip(rules, ("near", "far"))]
    facts = _graph(spark, sf, "customer", "nation").triples().where(F.col("p").isin(f"<{EX}c_nationkey>", f"<{EX}n_regionkey>"))
    fired = Rules(rules, provenance=True).run(facts).firings
    return spark.createDataFrame(sorted(fired.items()), "rule string, n long")


def _of_supplier(spark, sf):
    return _graph(spark, sf, "supplier").triples().where(F.col("p").isin(f"<{EX}s_acctbal>", f"<{EX}s_name>"))


@query("SELECT s_suppkey AS x FROM supplier WHERE s_acctbal > 9000 OR s_acctbal < 0")
def horn_rules(spark, sf):
    """A disjunctive body and a conjunctive head as Horn rules; the doubled rule counts once."""
    x, b = Var("x"), Var("b")
    kind = lambda n: R.Atom(x, Iri(TYPE), Iri(EX + n))
    limit = lambda op, n: R.Builtin(R.MATH + op, b, Literal(str(n), XSD + "integer"))
    body = R.And((R.Atom(x, Iri(EX + "s_acctbal"), b), R.Or((limit("greaterThan", 9000), limit("lessThan", 0)))))
    rules = R.horn(body, R.And((kind("Odd"), kind("Noted"))))
    out = Rules(R.distinct_rules([*rules, *rules])).run(_of_supplier(spark, sf)).derived
    odd, noted = (out.where(F.col("o") == f"<{EX}{n}>").select("s") for n in ("Odd", "Noted"))
    return odd.intersect(noted).select(_key("s", "x"))


@query("SELECT c_custkey AS x FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_mktsegment <> 'MACHINERY'")
def negated_disjunction(spark, sf):
    """De Morgan: neither of two classes."""
    x, m = Var("x"), Var("m")
    kind = lambda n: R.Atom(x, Iri(TYPE), Iri(EX + n))
    segment = lambda n: R.Rule((kind(n),), (R.Atom(x, Iri(EX + "c_mktsegment"), Literal(n)),))
    rules = [segment("BUILDING"), segment("MACHINERY"), *R.horn(R.And((R.Atom(x, Iri(EX + "c_mktsegment"), m), R.Not(R.Or((kind("BUILDING"), kind("MACHINERY")))))), kind("Other"))]
    facts = _graph(spark, sf, "customer").triples(None, Iri(EX + "c_mktsegment"), None)
    return Rules(rules).run(facts).derived.where(F.col("o") == f"<{EX}Other>").select(_key("s", "x"))


_OWL_HEAD = f"@prefix : <{EX}>. @prefix owl: <{owl.OWL}>. @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>. "


@query("SELECT n_nationkey AS n FROM nation WHERE n_regionkey NOT IN (1, 2)")
def universal_restriction(spark, sf):
    """Nations all of whose regions are outside two classes, by closed-world reading."""
    onto = _OWL_HEAD + "[ owl:intersectionOf ( :Nation [ owl:onProperty :n_regionkey; owl:allValuesFrom [ owl:complementOf [ owl:unionOf ( :One :Two ) ] ] ] ) ] rdfs:subClassOf :Free ."
    g = _graph(spark, sf, "nation")
    facts = g.triples().where((F.col("p") == f"<{EX}n_regionkey>") | (F.col("p") == f"<{TYPE}>"))
    marks = spark.createDataFrame([(f"<{EX}region/{k}>", f"<{TYPE}>", f"<{EX}{c}>") for k, c in ((1, "One"), (2, "Two"))], "s string, p string, o string")
    out = Rules(owl.rules_from(n3.parse(onto).triples)).run(facts.union(marks)).derived
    return out.where(F.col("o") == f"<{EX}Free>").select(_key("s", "n", "int"))


@query("SELECT 'type ' || t AS leaf FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS t FROM part) WHERE t <> 'PROMO' AND NOT starts_with(t, 'S')")
def expanded_complement(spark, sf):
    """(Type and not Small): the leaf classes, from the data's first words of types."""
    words = [r["t"] for r in table(spark, sf, "part").select(F.split("p_type", " ").getItem(0).alias("t")).distinct().collect()]  # the schema
    name = lambda w: Iri(EX + "t/" + w)
    sub = Iri("http://www.w3.org/2000/01/rdf-schema#subClassOf")
    triples = [(name(w), sub, Iri(EX + ("Small" if w == "PROMO" or w.startswith("S") else "Type"))) for w in words] + [(Iri(EX + "Small"), sub, Iri(EX + "Type"))]
    triples += n3.parse(_OWL_HEAD + ":X owl:intersectionOf ( :Type [ owl:complementOf :Small ] ) .").triples
    found = owl.expand_complements(owl.Ontology(triples), Iri(EX + "X"))
    return spark.createDataFrame(sorted((str(c).replace(EX + "t/", "type "),) for c in found), "leaf string")


@query("SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey > 3")
def stored_and_derived(spark, sf):
    """A predicate that is stored and derived: stored triples are read under another name."""
    facts = _part_facts(spark, sf)
    rules, renamed = magic.split_mixed(_rules("{ ?x :up ?y . ?y :up ?z } => { ?x :parent ?z } ."), {EX + "parent"})
    stored = facts.withColumn("p", F.lit(f"<{renamed[EX + 'parent']}>")).union(facts.withColumn("p", F.lit(f"<{EX}up>")))
    out = Rules(rules).run(stored).derived.where(F.col("p") == f"<{EX}parent>")
    return out.select(_key("s", "a"), _key("o", "b")).distinct()


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def log_builtins(spark, sf):
    facts = _graph(spark, sf, "nation").triples(None, Iri(EX + "n_regionkey"), None)
    out = Rules(_rules("{ ?x :n_regionkey ?r . ?y :n_regionkey ?s . ?r log:equalTo ?s . ?x log:notEqualTo ?y } => { ?x :beside ?y } .")).run(facts).derived
    return out.select(_key("s", "x", "int"), _key("o", "y", "int"))


@query("SELECT s_suppkey AS x, unnest([CASE WHEN s_name > 'Supplier#000000050' THEN 'After' END, CASE WHEN contains(s_name, '7') THEN 'Seven' END, CASE WHEN upper(s_name) = 'SUPPLIER#000000003' THEN 'Third' END, CASE WHEN ends_with(s_name, '9') THEN 'Nine' END]) AS c FROM supplier")
def string_builtins(spark, sf):
    source = '''{ ?x :s_name ?n . ?n string:greaterThan "Supplier#000000050" } => { ?x a :After } . { ?x :s_name ?n . ?n string:contains "7" } => { ?x a :Seven } .
      { ?x :s_name ?n . ?n string:equalIgnoringCase "SUPPLIER#000000003" } => { ?x a :Third } . { ?x :s_name ?n . ?n string:endsWith "9" } => { ?x a :Nine } .'''
    out = Rules(_rules(source)).run(_of_supplier(spark, sf)).derived.select(_key("s", "x"), _local("o", "c"))
    nothing = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("x"), F.explode(F.array(*[F.lit(c) for c in ("After", "Seven", "Third", "Nine")])).alias("c")).exceptAll(out)
    return out.union(nothing.select("x", F.lit(None).cast("string")))


@query("SELECT s_suppkey AS x FROM supplier WHERE length(s_name) > 5 AND right(s_name, 1) = '4'")
def user_builtin(spark, sf):
    """A built-in predicate of one's own."""
    parsed = R.from_n3(n3.parse(f"@prefix : <{EX}>. {{ ?x :s_name ?n . ?n :endsIn 4 }} => {{ ?x a :Four }} ."), {EX + "endsIn"})
    out = Rules(parsed, builtins={EX + "endsIn": lambda a, b: F.right(a.text, F.lit(1)).cast("double") == b.families["num"]}).run(_of_supplier(spark, sf)).derived
    return out.select(_key("s", "x"))


@query("SELECT a.o_orderkey AS x, a.o_custkey AS c FROM orders a WHERE a.o_totalprice > 400000")
def owl_property_rules(spark, sf):
    """Domain, inverse and subproperty as rules: large orders, seen from their customers."""
    onto = _OWL_HEAD + ":placed owl:inverseOf :by . :o_custkey rdfs:subPropertyOf :by . :o_totalprice rdfs:domain :Priced ."
    facts = _graph(spark, sf, "orders").triples().where(F.col("p") == f"<{EX}o_custkey>")
    large = table(spark, sf, "orders").where("o_totalprice > 400000").select(_iri("orders", "o_orderkey").alias("s"), F.lit(f"<{EX}o_totalprice>").alias("p"), F.lit('"1"').alias("o"))
    out = Rules(owl.rules_from(n3.parse(onto).triples)).run(facts.join(large.select("s"), "s", "left_semi").select("s", "p", "o").union(large)).derived
    priced = out.where(F.col("o") == f"<{EX}Priced>").select("s")
    placed = out.where(F.col("p") == f"<{EX}placed>").select(F.col("s").alias("c"), F.col("o").alias("s")).join(priced, "s", "left_semi")
    return placed.select(_key("s", "x"), _key("c", "c"))


@query("SELECT DISTINCT c_custkey AS a, o_orderkey AS b FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def pd_inverse_functional(spark, sf):
    """pD* rules: two names with one value of an inverse functional property are the same."""
    big = table(spark, sf, "orders").where("o_totalprice > 450000")
    key = F.concat(F.lit('"'), "o_orderkey", F.lit('"'))
    facts = big.select(_iri("orders", "o_orderkey").alias("s"), F.lit(f"<{EX}code>").alias("p"), key.alias("o")).union(big.select(F.concat(F.lit(f"<{EX}buyer_of/"), "o_orderkey", F.lit("_"), "o_custkey", F.lit(">")), F.lit(f"<{EX}code>"), key))
    rules = owl.rules_from(n3.parse(_OWL_HEAD + ":code a owl:InverseFunctionalProperty .").triples)
    same = Rules(rules).run(facts).derived.where((F.col("p") == f"<{owl.OWL}sameAs>") & F.col("s").contains("buyer_of") & F.col("o").contains("/orders/"))
    return same.select(_key("s", "a"), _key("o", "b"))


@query("SELECT c_custkey AS c FROM customer WHERE c_nationkey = 7")
def class_extent(spark, sf):
    """A class built by operators; its members after the rules have run."""
    space = owl.Space()
    local = space.cls(EX + "Local")
    local += space.prop(EX + "c_nationkey").value(Iri(EX + "nation/7"))
    facts = _graph(spark, sf, "customer").triples(None, Iri(EX + "c_nationkey"), None)
    known = Rules(owl.rules_from(space.triples)).run(facts).known
    return local.extent(Graph(known.withColumn("g", F.lit("")))).select(_key("s", "c"))


# -- services --


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000")
def saved_query(spark, sf):
    """A saved query with parameters, run under a ticket, its JSON read again."""
    service = Service(spark, Engine(graph(spark, sf, "orders"), PREFIXES))
    service.save("dear", "SELECT ?k { ?o :o_orderkey ?k ; :o_orderstatus $status$ ; :o_totalprice ?p FILTER(?p > $least$) }")
    shown = service.run(service.expand("dear", status=Literal("P"), least=Literal("300000", XSD + "integer")), ticket=service.ticket())
    return spark.createDataFrame([(int(b["k"]["value"]),) for b in json.loads(shown)["results"]["bindings"]], "o long")


@query("SELECT 'Customer' AS class, count(*) AS instances FROM customer UNION ALL SELECT 'Nation', count(*) FROM nation")
def classes_of_store(spark, sf):
    return Service(spark, Engine(graph(spark, sf, "customer", "nation"), PREFIXES)).classes().select(_local("class", "class"), "instances")


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT a FROM e WHERE b = 3 UNION SELECT e.a FROM t JOIN e ON t.a = e.b) SELECT a FROM t")
def magic_goal_backwards(spark, sf):
    """A goal that is bound at its other end is rewritten by magic sets."""
    goal = R.Atom(Var("z"), Iri(EX + "ancestor"), Iri(EX + "part/3"))
    return magic.answers(_part_facts(spark, sf), _rules(ANCESTOR.replace("?x :parent ?y . ?y :ancestor ?z", "?x :ancestor ?y . ?y :parent ?z")), goal).select(_key("s", "a"))

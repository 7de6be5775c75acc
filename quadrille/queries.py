"""The registered queries of the graph engine over the driver's tables, each with SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import closure, joins, text
from .operators.graph import Graph
from .operators.stores import QuadStore
from .plans.algebra import Triple
from .plans.compile import Engine, dataset_description, match
from .rules import ast as R
from .rules import magic
from .rules.engine import Engine as Rules
from .rules.engine import skolem  # noqa: F401
from .rules.owl import rules_from
from .sources import n3, ntriples
from .sources.tables import EX, graph, table
from .terms import XSD, Iri, Literal, Var, lex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PREFIXES = {"": EX, "xsd": XSD}


def query(sql: str | None):
    """Registers a function by its name, with its SQL."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def sparql(name: str, tables: str, text_: str, sql: str, **bindings) -> None:
    """Registers a query text; what it selects are keys and native values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(graph(spark, sf_dir, *tables.split()), PREFIXES).query(text_, bindings or None).values

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


sparql(
    "flagship", "customer orders",
    "SELECT ?name ?total { ?o :o_custkey ?c ; :o_totalprice ?total . ?c :c_name ?name ; :c_mktsegment 'BUILDING' FILTER(?total > 200000) } ORDER BY DESC(?total) ?o LIMIT 10",
    "SELECT c_name AS name, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 ORDER BY total DESC, 'http://ex/orders/' || o_orderkey LIMIT 10",
)
sparql("bgp_star", "customer", "SELECT ?c ?n ?b { ?c a :Customer ; :c_name ?n ; :c_acctbal ?b }", "SELECT c_custkey AS c, c_name AS n, c_acctbal AS b FROM customer")
sparql("bgp_chain", "customer nation region", "SELECT ?c ?n ?r { ?c :c_nationkey ?x . ?x :n_name ?n ; :n_regionkey ?y . ?y :r_name ?r }", "SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("bgp_cross", "nation region", "SELECT ?a ?b { ?x :n_name ?a . ?y :r_name ?b }", "SELECT n_name AS a, r_name AS b FROM nation, region")
sparql("bgp_wide_join", "lineitem orders part", "SELECT ?o ?p ?q ?s { ?l :l_orderkey ?o ; :l_partkey ?p ; :l_quantity ?q . ?o :o_orderstatus ?s . ?p :p_brand ?b FILTER(?q >= 49 && ?s = 'F') }",
       "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND o_orderstatus = 'F'")
sparql("constant_subject", "customer", "SELECT ?n { <http://ex/customer/7> :c_name ?n }", "SELECT c_name AS n FROM customer WHERE c_custkey = 7")
sparql("constant_object", "customer", "SELECT ?c { ?c :c_nationkey <http://ex/nation/3> }", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3")
sparql("repeated_variable", "orders customer", "SELECT ?o { ?o :o_orderstatus ?s ; :o_orderstatus ?s ; :o_custkey ?c . ?c :c_custkey ?k }", "SELECT o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
sparql("filter_num", "orders", "SELECT ?o ?p { ?o :o_totalprice ?p FILTER(?p >= 400000) }", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice >= 400000")
sparql("filter_and_or_not", "customer", "SELECT ?c { ?c :c_acctbal ?b ; :c_mktsegment ?m FILTER((?b > 5000 || ?b < 0) && !(?m = 'BUILDING')) }", "SELECT c_custkey AS c FROM customer WHERE (c_acctbal > 5000 OR c_acctbal < 0) AND NOT c_mktsegment = 'BUILDING'")
sparql("filter_error", "customer", "SELECT ?c { ?c :c_name ?n ; :c_acctbal ?b FILTER(?n > 5 || ?b > 9000) }", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000")
sparql("filter_date", "orders", 'SELECT ?o { ?o :o_orderdate ?d FILTER(?d < "1995-02-01T00:00:00"^^xsd:dateTime) }', "SELECT o_orderkey AS o FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01'")
sparql("filter_constant", "region", "SELECT ?r { ?r a :Region FILTER(true) }", "SELECT r_regionkey AS r FROM region")
sparql("filter_regex_flags", "part", "SELECT ?p ?t { ?p :p_type ?t FILTER regex(?t, '^[a-m].*d', 'i') }", "SELECT p_partkey AS p, p_type AS t FROM part WHERE regexp_matches(p_type, '(?i)^[a-m].*d')")
sparql("filter_lang", "documents", "SELECT ?d { ?d :text ?t FILTER(lang(?t) = 'de') }", "SELECT doc_id AS d FROM documents WHERE lang = 'de'")
sparql("langmatches", "documents", "SELECT ?d { ?d :text ?t FILTER(langMatches(lang(?t), 'FR')) }", "SELECT doc_id AS d FROM documents WHERE lang = 'fr'")
sparql("filter_datatype", "region", "SELECT ?r ?p { ?r ?p ?v FILTER(datatype(?v) = xsd:integer) }", "SELECT '<http://ex/region/' || r_regionkey || '>' AS r, '<http://ex/r_regionkey>' AS p FROM region")
sparql("isx", "nation", "SELECT ?s ?p { ?s ?p ?v FILTER(isIRI(?v) && !isBlank(?v) && !isLiteral(?v) && ?p != rdf:type) }", "SELECT '<http://ex/nation/' || n_nationkey || '>' AS s, '<http://ex/n_regionkey>' AS p FROM nation")
sparql("sameterm", "nation", "SELECT ?a ?b { ?a :n_regionkey ?x . ?b :n_regionkey ?y FILTER(sameTerm(?x, ?y) && str(?a) < str(?b)) }",
       "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey::VARCHAR < b.n_nationkey::VARCHAR")
sparql("str_function", "customer", "SELECT ?c { ?c :c_nationkey ?n FILTER(str(?n) = 'http://ex/nation/5') }", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 5")
sparql("cast_xsd", "customer", "SELECT ?c { ?c :c_acctbal ?b FILTER(xsd:integer(?b) = xsd:integer('-12') || xsd:double(str(?b)) > 9990.5) }", "SELECT c_custkey AS c FROM customer WHERE trunc(c_acctbal) = -12 OR c_acctbal > 9990.5")
sparql("arithmetic", "lineitem", "SELECT ?o ?n { ?l :l_orderkey ?o ; :l_linenumber ?n ; :l_quantity ?q ; :l_discount ?d FILTER(?q * 2 - -?d / 2 + 1 > 100.93) }",
       "SELECT l_orderkey AS o, l_linenumber::BIGINT AS n FROM lineitem WHERE l_quantity * 2 - (0 - l_discount) / 2 + 1 > 100.93")
QUERIES["arithmetic"] = (lambda f: lambda spark, sf: f(spark, sf).withColumn("n", F.col("n").cast("long")))(QUERIES["arithmetic"])
sparql("ebv", "labels documents", "SELECT ?d { ?d :toxic ?t FILTER(?t) }", "SELECT doc_id AS d FROM labels WHERE toxic <> 0")
sparql("optional", "documents labels", "SELECT ?d ?q { ?d :source ?s OPTIONAL { ?d :quality ?q } }", "SELECT d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sparql("optional_filter", "documents labels", "SELECT ?d ?q { ?d :n_chars ?n OPTIONAL { ?d :quality ?q FILTER(?n > 1000) } }", "SELECT d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 1000")
sparql("nested_optional", "documents labels", "SELECT ?d ?q ?x { ?d :lang 'en' OPTIONAL { ?d :quality ?q FILTER(?q = 0) OPTIONAL { ?d :toxic ?x FILTER(?x = 1) } } }",
       "SELECT d.doc_id AS d, a.quality AS q, b.toxic AS x FROM documents d LEFT JOIN labels a ON d.doc_id = a.doc_id AND a.quality = 0 LEFT JOIN labels b ON a.doc_id = b.doc_id AND b.toxic = 1 WHERE lang = 'en'")
sparql("leading_optional", "region", "SELECT ?n { OPTIONAL { ?r :r_name ?n } }", "SELECT r_name AS n FROM region")
sparql("optional_not_bound", "documents labels", "SELECT ?d { ?d :source ?s OPTIONAL { ?d :quality ?q } FILTER(!bound(?q)) }", "SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sparql("nullable_join", "documents labels", "SELECT ?d ?e ?q { ?d :source 'src0' OPTIONAL { ?d :quality ?q } . { ?e :toxic 1 ; :quality ?q } }",
       "SELECT d.doc_id AS d, e.doc_id AS e, e.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN labels e ON e.toxic = 1 AND (l.quality IS NULL OR e.quality = l.quality) WHERE source = 'src0'")
QUERIES["nullable_join"] = lambda spark, sf: Engine(graph(spark, sf, "documents", "labels"), PREFIXES).query(
    'SELECT ?d ?e ?q { ?d :source "src0" OPTIONAL { ?d :quality ?q } . { ?e :toxic "1"^^xsd:integer ; :quality ?q } }'
).values
sparql("union", "events", "SELECT ?e ?u { { ?e :event_type 'click' ; :user_id ?u } UNION { ?e :event_type 'purchase' ; :user_id ?u } }", "SELECT event_id AS e, user_id AS u FROM events WHERE event_type IN ('click', 'purchase')")
sparql("union_padded", "events", "SELECT ?e ?u ?v { { ?e :event_type 'click' ; :user_id ?u } UNION { ?e :event_type 'error' ; :value ?v } }",
       "SELECT event_id AS e, user_id AS u, NULL::DOUBLE AS v FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, value FROM events WHERE event_type = 'error'")
sparql("graph_var", "events", "SELECT DISTINCT ?g { GRAPH ?g { ?e :user_id ?u } }", "SELECT DISTINCT event_type AS g FROM events")
sparql("graph_iri", "events", "SELECT ?e { GRAPH <http://ex/graph/signup> { ?e :user_id ?u } }", "SELECT event_id AS e FROM events WHERE event_type = 'signup'")
sparql("from_named", "events", "SELECT ?e ?g FROM NAMED <http://ex/graph/view> FROM NAMED <http://ex/graph/error> { GRAPH ?g { ?e :value ?v FILTER(?v > 90) } }", "SELECT event_id AS e, event_type AS g FROM events WHERE event_type IN ('view', 'error') AND value > 90")
sparql("from_default", "events", "SELECT ?e FROM <http://ex/graph/signup> { ?e :user_id ?u }", "SELECT event_id AS e FROM events WHERE event_type = 'signup'")
sparql("distinct", "orders", "SELECT DISTINCT ?s ?p { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
sparql("order_limit_offset", "orders", "SELECT ?o ?p { ?o :o_totalprice ?p ; :o_orderkey ?k } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 5", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 20 OFFSET 5")
sparql("order_unprojected", "supplier", "SELECT ?n { ?s :s_name ?n ; :s_acctbal ?b ; :s_suppkey ?k } ORDER BY ?b ?k LIMIT 5", "SELECT s_name AS n FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5")
sparql("limit_zero", "region", "SELECT ?r { ?r :r_name ?n } LIMIT 0", "SELECT r_regionkey AS r FROM region LIMIT 0")
sparql("ask", "orders", "ASK { ?o :o_totalprice ?p FILTER(?p > 1e9) }", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e9) AS answer")
sparql("construct", "customer nation", "CONSTRUCT { ?c :livesIn ?n . ?n :hosts ?c } { ?c :c_nationkey ?x . ?x :n_name ?n FILTER(?n = 'NATION_3') }",
       "SELECT '<http://ex/customer/' || c_custkey || '>' AS s, '<http://ex/livesIn>' AS p, '\"' || n_name || '\"' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
sparql("describe", "nation region", "DESCRIBE <http://ex/region/2>",
       "SELECT '<http://ex/region/2>' AS s, '<http://ex/r_regionkey>' AS p, '\"2\"^^http://www.w3.org/2001/XMLSchema#integer' AS o UNION ALL SELECT '<http://ex/region/2>', '<http://ex/r_name>', '\"' || r_name || '\"' FROM region WHERE r_regionkey = 2 UNION ALL SELECT '<http://ex/region/2>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://ex/Region>' UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>', '<http://ex/n_regionkey>', '<http://ex/region/2>' FROM nation WHERE n_regionkey = 2")
sparql("initial_bindings", "customer", "SELECT ?c ?n { ?c :c_name ?n ; :c_mktsegment ?m }", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'MACHINERY'", m=Literal("MACHINERY"))
QUERIES["initial_bindings"] = lambda spark, sf: Engine(graph(spark, sf, "customer"), PREFIXES).query("SELECT ?c ?n { ?c :c_name ?n ; :c_mktsegment ?m }", {"m": Literal("MACHINERY")}).values


@query("SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 9000")
def programmatic_query(spark, sf):
    store = graph(spark, sf, "customer", "supplier")
    c, b = Var("c"), Var("b")
    found = match(store, ["c", "b"], [[Triple(c, Iri(EX + "c_acctbal"), b)], [Triple(c, Iri(EX + "s_acctbal"), b)]], constraints=[lambda s: V.of(s.col("b"), s.descs["b"]).families["num"] > 9000])
    return found.texts().select(F.regexp_extract("c", "([0-9]+)$", 1).cast("long").alias("c"), F.col("b").cast("double").alias("b"))


@query("SELECT o_orderkey AS o FROM orders WHERE upper(o_orderstatus) = 'F' AND o_totalprice > 490000")
def extension_function(spark, sf):
    V.register(EX + "upper", lambda v: V.typed(F.upper(v.text), ""))
    return Engine(graph(spark, sf, "orders"), PREFIXES).query("SELECT ?o { ?o :o_orderstatus ?s ; :o_totalprice ?p FILTER(:upper(?s) = 'F' && ?p > 490000) }").values


# -- graphs --


def _graph(spark: SparkSession, sf: str, *tables: str) -> Graph:
    return Graph(graph(spark, sf, *tables).quads())


def _spread(spark: SparkSession, sf: str, *tables: str) -> Graph:
    """The same, for work on each triple: a table's rows go to all cores first, however few row groups its file has."""
    store = graph(spark, sf, *tables)
    for m in store.tables:
        m.df = m.df.repartition(m.key)
    return Graph(store.quads())


def _term(iri: str, key: str) -> str:
    return f"'<{EX}{iri}/' || {key} || '>'"


@query("SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 4, 9)")
def triples_choices(spark, sf):
    g = _graph(spark, sf, "nation")
    return g.triples_choices([Iri(f"{EX}nation/{k}") for k in (1, 4, 9)], Iri(EX + "n_name"), None).select(lex(F.col("o")).alias("name"))


@query("SELECT c_custkey AS c FROM customer WHERE regexp_matches(c_name, '^Customer#0+1')")
def regex_scan(spark, sf):
    g = _graph(spark, sf, "customer")
    return g.triples(None, Iri(EX + "c_name"), re.compile("Customer#0+1")).select(F.regexp_extract("s", "([0-9]+)>$", 1).cast("long").alias("c"))


@query("SELECT event_type AS g, count(*) * 7 AS triples FROM events GROUP BY event_type")
def graph_description(spark, sf):
    return dataset_description(graph(spark, sf, "events")).select(F.regexp_extract("g", "([a-z]+)>$", 1).alias("g"), "triples")


@query(f"SELECT DISTINCT {_term('graph', 'event_type')} AS g FROM events WHERE user_id = 5")
def contexts(spark, sf):
    return _graph(spark, sf, "events").contexts(None, Iri(EX + "user_id"), Literal("5", XSD + "integer"))


@query("SELECT count(*) AS n FROM (SELECT unnest(['k', 'n', 'r', 't']) FROM nation)")
def triple_count(spark, sf):
    return _graph(spark, sf, "nation").triples().agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_term('nation', 'n_nationkey')} AS s, '\"' || n_name || '\"' AS o FROM nation")
def subject_objects(spark, sf):
    return _graph(spark, sf, "nation").subject_objects(Iri(EX + "n_name"))


@query("SELECT n_name AS value FROM nation WHERE n_nationkey = 3")
def functional_lookup(spark, sf):
    v = _graph(spark, sf, "nation").value(Iri(EX + "nation/3"), Iri(EX + "n_name"), any=False)
    return spark.createDataFrame([(v.lex,)], "value string")


def _users(spark, sf, kind):
    """The users of a kind of event, as a graph."""
    df = table(spark, sf, "events").where(F.col("event_type") == kind)
    return Graph(df.select(F.concat(F.lit(f"<{EX}user/"), "user_id", F.lit(">")).alias("s"), F.lit(f"<{EX}is>").alias("p"), F.lit('"active"').alias("o"), F.lit("").alias("g")).distinct())


for _name, _op, _sql in (("graph_union", "__add__", "UNION"), ("graph_intersection", "__mul__", "INTERSECT"), ("graph_difference", "__sub__", "EXCEPT")):
    QUERIES[_name] = lambda spark, sf, op=_op: getattr(_users(spark, sf, "click"), op)(_users(spark, sf, "purchase")).triples().select(F.regexp_extract("s", "([0-9]+)>$", 1).cast("long").alias("u"))
    ORACLE_SQL[_name] = f"SELECT user_id AS u FROM events WHERE event_type = 'click' {_sql} SELECT user_id FROM events WHERE event_type = 'purchase'"


@query("SELECT user_id AS u FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase'))")
def graph_aggregate(spark, sf):
    """Two named graphs as a bag."""
    df = table(spark, sf, "events")
    quads = df.select(F.concat(F.lit(f"<{EX}user/"), "user_id", F.lit(">")).alias("s"), F.lit(f"<{EX}is>").alias("p"), F.lit('"active"').alias("o"), F.concat(F.lit(f"<{EX}graph/"), "event_type", F.lit(">")).alias("g")).distinct()
    return Graph(quads).aggregate(EX + "graph/click", EX + "graph/purchase").select(F.regexp_extract("s", "([0-9]+)>$", 1).cast("long").alias("u"))


@query("SELECT n_nationkey AS n FROM nation WHERE n_regionkey <> 1")
def remove_by_pattern(spark, sf):
    g = _graph(spark, sf, "nation").remove(None, Iri(EX + "n_regionkey"), Iri(EX + "region/1"))
    return g.subjects(Iri(EX + "n_regionkey")).select(F.regexp_extract("s", "([0-9]+)>$", 1).cast("int").alias("n"))


def _parts(spark, sf):
    """Each part's parent is the part with half its number."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b")).where("a > 1")


_PARTS = "SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1"


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
def transitive_closure(spark, sf):
    return closure.transitive_closure(_parts(spark, sf))


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT 37::BIGINT AS node, 0 AS depth UNION SELECT e.b, depth + 1 FROM t JOIN e ON node = a) SELECT * FROM t")
def transitive_objects(spark, sf):
    return closure.reachable(_parts(spark, sf), spark.createDataFrame([(37,)], "x long")).select("node", "depth")


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT 5::BIGINT AS node UNION SELECT e.a FROM t JOIN e ON node = b) SELECT * FROM t")
def transitive_subjects(spark, sf):
    return closure.reachable(_parts(spark, sf), spark.createDataFrame([(5,)], "x long"), reverse=True).select("node")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
def closure_cyclic(spark, sf):
    return closure.transitive_closure(table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.expr("(n_nationkey + 1) % 25").alias("b")))


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT 100::BIGINT AS node, '100' AS path UNION ALL SELECT e.b, path || '/' || e.b FROM t JOIN e ON node = a) SELECT * FROM t")
def path_enumeration(spark, sf):
    return closure.paths(_parts(spark, sf), spark.createDataFrame([(100,)], "x long")).select("node", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("SELECT n_nationkey::BIGINT AS node, n_regionkey::BIGINT AS component FROM nation UNION ALL SELECT DISTINCT 100 + n_regionkey, n_regionkey FROM nation")
def connected_components(spark, sf):
    """Nations and regions, where a region's node is 100 and its number; components are named by region."""
    e = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"))
    found = closure.components(e)
    region = found.where("node >= 100").select("component", (F.col("node") - 100).alias("region"))
    return found.join(region, "component").select("node", F.col("region").alias("component"))


@query(f"WITH RECURSIVE e AS ({_PARTS}), o(x) AS (VALUES (9::BIGINT), (10), (7), (4)), u AS (SELECT x, x AS y FROM o UNION SELECT u.x, e.b FROM u JOIN e ON u.y = e.a), s AS (SELECT * FROM u WHERE x <> y) SELECT a.y AS ancestor, a.x, b.x AS y FROM s a JOIN s b ON a.y = b.y AND a.x < b.x WHERE a.y NOT IN (SELECT x FROM o) AND NOT EXISTS (SELECT 1 FROM s WHERE (s.x, s.y) IN ((a.x, b.x), (b.x, a.x)))")
def common_ancestors(spark, sf):
    return closure.common_ancestors(_parts(spark, sf), spark.createDataFrame([(9,), (10,), (7,), (4,)], "x long"))


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT 20::BIGINT AS node, 0 AS k UNION SELECT e.b, k + 1 FROM t JOIN e ON node = a WHERE k < 2), d AS (SELECT 20::BIGINT AS node, 0 AS k UNION SELECT e.a, k + 1 FROM d JOIN e ON node = b WHERE k < 1), i AS (SELECT node FROM t UNION SELECT node FROM d) SELECT node, node // 2 NOT IN (SELECT node FROM i) AS boundary FROM i")
def segmentation(spark, sf):
    return closure.segment(_parts(spark, sf), spark.createDataFrame([(20,)], "x long"), up=2, down=1)


@query(f"WITH RECURSIVE e AS ({_PARTS}), u AS (SELECT p_partkey AS seed, p_partkey AS node FROM part WHERE p_partkey BETWEEN 40 AND 60 UNION SELECT seed, e.b FROM u JOIN e ON node = a) SELECT seed, max(node) AS node FROM u WHERE node % 3 = 0 AND node <> seed GROUP BY seed")
def proximal_primitives(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("x"))
    return closure.proximal_primitives(_parts(spark, sf), parts.where("x % 3 = 0"), parts.where("x between 40 and 60"))


@query("SELECT conv_id AS conversation, turn AS position, role AS item FROM conversations")
def list_items(spark, sf):
    """Conversations as lists of roles; the cells are walked from every head at once."""
    df = table(spark, sf, "conversations")
    cell = lambda t: F.concat(F.lit("_:c"), "conv_id", F.lit("_"), t.cast("string"))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    last = df.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = df.join(last, "conv_id")
    first = rows.select(cell(F.col("turn")).alias("s"), F.lit(f"<{rdf}first>").alias("p"), F.concat(F.lit('"'), "role", F.lit('"')).alias("o"), F.lit("").alias("g"))
    rest = rows.select(cell(F.col("turn")), F.lit(f"<{rdf}rest>"), F.when(F.col("turn") < F.col("last"), cell(F.col("turn") + 1)).otherwise(f"<{rdf}nil>"), F.lit(""))
    found = Graph(first.union(rest)).lists().select("head", F.posexplode("items").alias("k", "o"))
    key = lambda k: F.regexp_extract("head", "c([0-9]+)_([0-9]+)$", k).cast("long")
    return found.select(key(1).alias("conversation"), (key(2) + F.col("k")).alias("position"), lex(F.col("o")).alias("item"))


@query("SELECT true AS same")
def isomorphism(spark, sf):
    """Nations as blank nodes under two labellings."""
    n = table(spark, sf, "nation")

    def labelled(prefix: str, shift: int) -> Graph:
        node = F.concat(F.lit(f"_:{prefix}"), ((F.col("n_nationkey") + shift) % 25).cast("string"))
        name = n.select(node.alias("s"), F.lit(f"<{EX}name>").alias("p"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("o"), F.lit("").alias("g"))
        link = n.select(node, F.lit(f"<{EX}next>"), F.concat(F.lit(f"_:{prefix}"), ((F.col("n_nationkey") + shift + 1) % 25).cast("string")), F.lit(""))
        return Graph(name.union(link))

    return spark.createDataFrame([(labelled("a", 0).isomorphic(labelled("b", 7)),)], "same boolean")


# -- joins, statistics, text, formats --

_JOIN = "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey"


def _sides(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("n"))


@query(_JOIN)
def hash_join(spark, sf):
    return joins.hash_join(*_sides(spark, sf), ["c"]).select("k", "n")


@query(_JOIN)
def merge_join(spark, sf):
    return joins.merge_join(*_sides(spark, sf), ["c"]).select("k", "n")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def theta_join(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("y"))
    return joins.theta_join(a, b, lambda p, q: (p.x < q.y) & (p.a > q.b)).select("a", "b")


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def lookup_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c"))
    return joins.lookup_join(table(spark, sf, "customer").select(F.col("c_custkey").alias("c")), o, ["c"])


@query("SELECT 'o_custkey' AS p, count(*) AS triples, count(*) AS subjects, count(DISTINCT o_custkey) AS objects FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*), count(DISTINCT o_orderstatus) FROM orders")
def stats_predicates(spark, sf):
    g = _graph(spark, sf, "orders").triples().where(F.col("p").isin(f"<{EX}o_custkey>", f"<{EX}o_orderstatus>"))
    return joins.predicate_statistics(g).withColumn("p", F.regexp_extract("p", "([a-z_]+)>$", 1))


@query("SELECT 'c_nationkey' AS p, 'n_name' AS q, 'o-s' AS slots, count(*)::BIGINT AS matches FROM customer JOIN nation ON c_nationkey = n_nationkey")
def stats_joins(spark, sf):
    g = _graph(spark, sf, "customer", "nation").triples().where(F.col("p").isin(f"<{EX}c_nationkey>", f"<{EX}n_name>"))
    name = lambda c: F.regexp_extract(c, "([a-z_]+)>$", 1).alias(c)
    return joins.predicate_join_statistics(g).select(name("p"), name("q"), "slots", F.col("matches").cast("long").alias("matches")).where("p = 'c_nationkey' and q = 'n_name'")


@query("SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def quads_bgp(spark, sf):
    """A pattern over stored quads, its joins ordered by statistics."""
    g = _graph(spark, sf, "customer", "nation")
    store = QuadStore(g.quads_df, False, {EX + "c_mktsegment": (1500, 1500, 5), EX + "c_nationkey": (1500, 1500, 25), EX + "n_name": (25, 25, 25)})
    r = Engine(store, PREFIXES).query("SELECT ?c ?n { ?c :c_mktsegment 'BUILDING' ; :c_nationkey ?x . ?x :n_name ?n }").solutions.texts()
    return r.select(F.regexp_extract("c", "([0-9]+)$", 1).cast("long").alias("c"), "n")


@query(r"SELECT doc_id AS item FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['erin', 'thinly'])")
def text_search(spark, sf):
    g = _graph(spark, sf, "documents")
    found = text.search(text.index(g.triples()), "Erin thinly", EX + "text")
    return found.select(F.regexp_extract("s", "([0-9]+)>$", 1).cast("long").alias("item"))


@query(r"SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ") GROUP BY term")
def text_index(spark, sf):
    g = _graph(spark, sf, "documents").quads(None, Iri(EX + "text"), None)
    return text.index(g).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) * 5 AS triples, count(DISTINCT c_name) AS names FROM customer")
def ntriples_round_trip(spark, sf):
    """Customers written as lines and parsed again, without the class statement."""
    g = _spread(spark, sf, "customer").quads_df
    back = ntriples.parse_lines(ntriples.lines(g)).where(~F.col("p").contains("rdf-syntax"))
    return back.distinct().agg(F.count(F.lit(1)).alias("triples"), F.countDistinct(F.when(F.col("p") == f"<{EX}c_name>", F.col("o"))).alias("names"))


# -- rules --


def _rules(source: str) -> list[R.Rule]:
    return R.from_n3(n3.parse(f"@prefix : <{EX}>. @prefix math: <{R.MATH}>. @prefix log: <{R.LOG}>. @prefix string: <{R.STRING}>. {source}"))


def _key(c: str, name: str = "", kind: str = "long"):
    return F.regexp_extract(c, "([0-9]+)>$", 1).cast(kind).alias(name or c)


@query("SELECT DISTINCT a.c_custkey AS x, n_regionkey AS r FROM customer a JOIN nation ON c_nationkey = n_nationkey")
def rule_basic(spark, sf):
    facts = _graph(spark, sf, "customer", "nation").triples().where(F.col("p").isin(f"<{EX}c_nationkey>", f"<{EX}n_regionkey>"))
    out = Rules(_rules("{ ?x :c_nationkey ?n . ?n :n_regionkey ?r } => { ?x :livesIn ?r } .")).run(facts).derived
    return out.select(_key("s", "x"), _key("o", "r", "int"))


@query("SELECT s_suppkey AS x FROM supplier WHERE s_acctbal > 5000 AND s_acctbal < 6000")
def rule_builtin(spark, sf):
    facts = _graph(spark, sf, "supplier").triples(None, Iri(EX + "s_acctbal"), None)
    out = Rules(_rules("{ ?x :s_acctbal ?b . ?b math:greaterThan 5000 . ?b math:lessThan 6000 } => { ?x a :Rich } .")).run(facts).derived
    return out.select(_key("s", "x"))


def _part_facts(spark, sf):
    e = _parts(spark, sf)
    return e.select(F.concat(F.lit(f"<{EX}part/"), "a", F.lit(">")).alias("s"), F.lit(f"<{EX}parent>").alias("p"), F.concat(F.lit(f"<{EX}part/"), "b", F.lit(">")).alias("o"))


ANCESTOR = "{ ?x :parent ?y } => { ?x :ancestor ?y } . { ?x :parent ?y . ?y :ancestor ?z } => { ?x :ancestor ?z } ."


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
def rule_recursive(spark, sf):
    out = Rules(_rules(ANCESTOR)).run(_part_facts(spark, sf)).derived
    return out.select(_key("s", "a"), _key("o", "b"))


@query("SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rule_negation(spark, sf):
    store = graph(spark, sf, "documents", "labels")
    facts = Graph(store.quads()).triples().where(F.col("p").isin(f"<{EX}source>", f"<{EX}quality>"))
    x, y, a = Var("x"), Var("y"), lambda n: Iri(EX + n)
    kind = Iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
    rules = [R.Rule((R.Atom(x, kind, a("Labelled")),), (R.Atom(x, a("quality"), y),)), R.Rule((R.Atom(x, kind, a("Open")),), (R.Atom(x, a("source"), y), R.Atom(x, kind, a("Labelled"), True)))]
    return Rules(rules).run(facts).derived.where(F.col("o") == f"<{EX}Open>").select(_key("s", "d"))


@query("SELECT count(DISTINCT o_custkey) AS accounts, count(*) AS links FROM orders WHERE o_totalprice > 450000")
def rule_existential(spark, sf):
    """One account for each customer with a large order, however many such orders."""
    store = graph(spark, sf, "orders")
    facts = Graph(store.quads()).triples().where(F.col("p").isin(f"<{EX}o_custkey>", f"<{EX}o_totalprice>"))
    source = "{ ?o :o_custkey ?c . ?o :o_totalprice ?p . ?p math:greaterThan 450000 } => { ?o :large ?c } . { ?o :large ?c } => { ?c :account _:a . _:a a :Account } . { ?o :large ?c . ?c :account ?a } => { ?o :billed ?a } ."
    out = Rules(_rules(source)).run(facts).derived
    return out.agg(F.count(F.when(F.col("o") == f"<{EX}Account>", 1)).alias("accounts"), F.count(F.when(F.col("p") == f"<{EX}billed>", 1)).alias("links"))


@query("SELECT DISTINCT p_partkey AS x, unnest(['Thing_' || split_part(p_type, ' ', 1), 'Good']) AS c FROM part")
def rdfs_closure(spark, sf):
    """Parts by the first word of their type, below one class; the data gives the schema."""
    from .rules.owl import RDFS_RULES

    t = table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").getItem(0).alias("w"))
    iri = lambda *c: F.concat(F.lit(f"<{EX}"), *c, F.lit(">"))
    rdf, rdfs = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
    facts = t.select(iri(F.lit("part/"), "p_partkey").alias("s"), F.lit(f"<{rdf}type>").alias("p"), iri(F.lit("Thing_"), "w").alias("o"))
    facts = facts.union(t.select(iri(F.lit("Thing_"), "w"), F.lit(f"<{rdfs}subClassOf>"), F.lit(f"<{EX}Good>")).distinct())
    known = Rules(RDFS_RULES).run(facts).known.where((F.col("p") == f"<{rdf}type>") & F.col("s").contains("/part/"))
    return known.select(_key("s", "x"), F.regexp_extract("o", "([A-Za-z_]+)>$", 1).alias("c"))


@query("SELECT c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_mktsegment = 'BUILDING'")
def owl_rules(spark, sf):
    """A defined class: builders that live in a nation of one region."""
    onto = n3.parse(f"""@prefix : <{EX}>. @prefix owl: <http://www.w3.org/2002/07/owl#>. @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>.
      :Local owl:equivalentClass [ owl:intersectionOf ( [ owl:onProperty :c_mktsegment ; owl:hasValue "BUILDING" ]
        [ owl:onProperty :c_nationkey ; owl:someValuesFrom [ owl:onProperty :n_regionkey ; owl:hasValue <{EX}region/2> ] ] ) ].""").triples
    rules = [r for r in rules_from(onto) if r.head[0].p.endswith("type")]
    facts = _graph(spark, sf, "customer", "nation").triples().where(F.col("p").isin(f"<{EX}c_nationkey>", f"<{EX}n_regionkey>", f"<{EX}c_mktsegment>"))
    return Rules(rules).run(facts).derived.where(F.col("o") == f"<{EX}Local>").select(_key("s", "x"))


@query(f"WITH RECURSIVE e AS ({_PARTS}), t AS (SELECT b FROM e WHERE a = 377 UNION SELECT e.b FROM t JOIN e ON t.b = e.a) SELECT b FROM t")
def magic_goal(spark, sf):
    goal = R.Atom(Iri(EX + "part/377"), Iri(EX + "ancestor"), Var("z"))
    return magic.answers(_part_facts(spark, sf), _rules(ANCESTOR), goal).select(_key("o", "b"))


@query("SELECT 'ancestor' AS p, 'ancestor' AS q, 3 AS depth")
def proof_tree(spark, sf):
    from .rules.engine import proof

    inference = Rules(_rules(ANCESTOR), provenance=True).run(_part_facts(spark, sf))
    tree = proof(inference, Iri(EX + "part/9"), Iri(EX + "ancestor"), Iri(EX + "part/1"))
    depth, node = 0, tree
    while node and "premises" in node:
        depth += 1
        node = next((x for x in node["premises"] if "premises" in x), None)
    return spark.createDataFrame([("ancestor", tree["triple"][1].rsplit("/", 1)[1][:-1], depth)], "p string, q string, depth int")


@query("SELECT DISTINCT user_id AS u FROM events WHERE event_type IN ('click', 'purchase')")
def stream_increment(spark, sf):
    """Events arrive in two micro-batches; the rules' closure follows."""
    import uuid

    from .storage import shared_dir
    from .streaming.ingest import LiveClosure

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df = table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase"))
    rows = df.select(F.concat(F.lit(f"<{EX}user/"), "user_id", F.lit(">")).alias("s"), F.concat(F.lit(f"<{EX}"), "event_type", F.lit(">")).alias("p"), F.concat(F.lit(f"<{EX}events/"), "event_id", F.lit(">")).alias("o"), F.pmod("event_id", F.lit(2)).alias("half"))
    for k in (0, 1):
        rows.where(F.col("half") == k).drop("half").coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    live = LiveClosure(spark, Rules(_rules("{ ?u :click ?e } => { ?u a :Active } . { ?u :purchase ?e } => { ?u a :Active } .")), f"{root}/out")
    live.follow(source, f"{root}/checkpoint").awaitTermination()
    return live.triples().where(F.col("o") == f"<{EX}Active>").select(_key("s", "u")).distinct()


@query("SELECT n_nationkey AS n, (n_nationkey + 1) % 5 AS r FROM nation WHERE n_nationkey % 3 <> 0")
def journal_replay(spark, sf):
    """Nations are added, a third is removed again and the others are moved; then the log is replayed."""
    import uuid

    from .storage import shared_dir
    from .streaming.ingest import Journal

    j = Journal(spark, f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}")
    n = table(spark, sf, "nation")

    def rows(seq: int, op: str, df, region):
        return df.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.concat(F.lit(f"<{EX}nation/"), "n_nationkey", F.lit(">")).alias("s"), F.lit(f"<{EX}in>").alias("p"), F.concat(F.lit(f"<{EX}region/"), region.cast("string"), F.lit(">")).alias("o"), F.lit("").alias("g"))

    old, new = F.col("n_nationkey") % 5, (F.col("n_nationkey") + 1) % 5
    for k, (op, df, region) in enumerate((("add", n, old), ("remove", n, old), ("add", n.where("n_nationkey % 3 <> 0"), new), ("add", n, F.lit(99)))):
        j.append(rows(k, op, df, region))
    j.rollback(2)
    return j.graph().select(_key("s", "n", "int"), _key("o", "r", "int"))

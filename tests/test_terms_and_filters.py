import pytest
from pyspark.sql import functions as F

from quadrille import terms as T
from quadrille.functions import values as V
from quadrille.operators.graph import Graph
from quadrille.plans.algebra import features
from quadrille.plans.compile import Engine
from quadrille.plans.parser import SyntaxFault, parse
from quadrille.terms import XSD, Bnode, Iri, Literal

E = "http://e/"
TERMS = [Iri(E + "a"), Bnode("b1"), Literal("x"), Literal('q"uo"te'), Literal("", "", "en"), Literal("chat", "", "fr-be"), Literal("1", XSD + "integer"), Literal('a"^^b', XSD + "string"), Literal("@en")]


def test_terms_round_trip(spark):
    assert [T.decode(T.encode(t)) for t in TERMS] == TERMS
    assert Iri("x") != Bnode("x") and Iri("x") == "x" and len({Iri("x"), Bnode("x")}) == 2
    df = spark.createDataFrame([(T.encode(t),) for t in TERMS], "t string")
    got = df.select(T.lex(F.col("t")), T.datatype(F.col("t")), T.lang(F.col("t"))).collect()
    for t, (lex, dt, lang) in zip(TERMS, got):
        assert (lex, dt, lang) == ((t.lex, t.dt, t.lang) if isinstance(t, Literal) else (str(t), None, None))


def engine(spark, rows, **options):
    return Engine(Graph.of(spark, rows).store(), {"": E}, **options)


def answers(spark, expression, value, **options):
    e = engine(spark, [(Iri(E + "s"), Iri(E + "v"), value)], **options)
    return e.query(f"SELECT ?s {{ ?s :v ?x FILTER({expression}) }}").df.count() == 1


N, D = XSD + "integer", XSD + "double"


@pytest.mark.parametrize(
    "expression,value,want",
    [
        ("?x = 1", Literal("01", N), True), ("?x = 1.0", Literal("1", N), True), ("?x != 1", Literal("2", D), True), ("sameTerm(?x, 1)", Literal("01", N), False),
        ("?x < 'b'", Literal("a"), True), ("?x < 'b'", Literal("1", N), False), ("!(?x < 'b')", Literal("1", N), False), ("?x = 'a'", Literal("a", XSD + "string"), True),
        ("?x = 'a'", Literal("a", "", "en"), False), ("?x != 'a'", Literal("a", "", "en"), True), ("?x = 'a'@en", Literal("a", "", "en"), True), ("?x = 'z'^^:t", Literal("y", E + "t"), False), ("?x != 'z'^^:t", Literal("y", E + "t"), False),
        ("?x = :a", Iri(E + "a"), True), ("?x != :a", Iri(E + "b"), True), ("?x = :a", Literal("a"), False), ("?x", Literal("0", N), False), ("?x", Literal("x"), True), ("?x", Literal(""), False), ("!?x", Literal(""), True),
        ("?x", Literal("NaN", D), False), ("?x", Literal("true", XSD + "boolean"), True), ("?x", Iri(E + "a"), False), ("!?x", Iri(E + "a"), False), ("?x || true", Iri(E + "a"), True), ("!(?x && false)", Iri(E + "a"), True),
        ("bound(?x) && !bound(?y)", Literal("a"), True), ("isIRI(?x)", Iri(E + "a"), True), ("isBlank(?x)", Bnode("b"), True), ("isLiteral(?x)", Bnode("b"), False), ("str(?x) = 'http://e/a'", Iri(E + "a"), True),
        ("lang(?x) = ''", Literal("a"), True), ("lang(?x) = 'en'", Literal("a", "", "en"), True), ("langMatches(lang(?x), 'EN')", Literal("a", "", "en-gb"), True), ("langMatches(lang(?x), '*')", Literal("a"), False),
        ("datatype(?x) = xsd:string", Literal("a"), True), ("datatype(?x) = xsd:integer", Literal("5", N), True), ("bound(?x) && datatype(?x) != xsd:string", Literal("a", "", "en"), False),
        ("regex(?x, 'B.c', 'i')", Literal("aBbCd"), True), ("regex(?x, '^b')", Literal("ab"), False), ("xsd:integer(?x) = 3", Literal("3.9", D), True), ("xsd:double(?x) = 2.5", Literal("2.5"), True), ("xsd:integer(?x) = 3", Literal("x"), False),
        ("xsd:boolean(?x)", Literal("1"), True), ("xsd:dateTime(?x) > '2020-01-01T00:00:00'^^xsd:dateTime", Literal("2020-05-05T00:00:00"), True), ("?x < '2020-02-01'^^xsd:date", Literal("2020-01-31", XSD + "date"), True),
        ("?x + 1 = 3", Literal("2", N), True), ("-?x = -2", Literal("2", N), True), ("?x / 0 = 1", Literal("2", N), False), ("?x * 2 - 1 = 3", Literal("2", N), True), ("?x + 'b' = 'ab'", Literal("a"), True), ("xsd:string(?x) = '5'", Literal("5", N), True),
    ],
)
def test_filters(spark, expression, value, want):
    assert answers(spark, expression, value) == want


def test_extension_function(spark):
    V.register(E + "twice", lambda v: V.typed(v.families["num"] * 2, D))
    assert answers(spark, ":twice(?x) = 8", Literal("4", N))
    with pytest.raises(ValueError):
        answers(spark, ":unknown(?x)", Literal("4", N))


def test_order_of_terms(spark):
    values = [Literal("10", N), Literal("9.5", D), Bnode("z"), Iri(E + "i"), Literal("b"), Literal("true", XSD + "boolean"), Literal("2020-01-01T00:00:00", XSD + "dateTime")]
    e = engine(spark, [(Iri(f"{E}s{k}"), Iri(E + "v"), v) for k, v in enumerate(values)] + [(Iri(E + "n"), Iri(E + "w"), Literal("x"))])
    got = [r.x for r in e.query("SELECT ?s ?x { { ?s :v ?x } UNION { ?s :w ?y } } ORDER BY ?x").df.collect()]
    assert [None if x is None else T.decode(x) for x in got] == [None, values[2], values[3], values[1], values[0], values[6], values[5], values[4]]
    down = [r.x for r in e.query("SELECT ?x { { ?s :v ?x } UNION { ?s :w ?y } } ORDER BY DESC(?x)").df.collect()]
    assert down == got[::-1]


@pytest.mark.parametrize(
    "text",
    [
        "BASE <http://x/> PREFIX p: <y#> SELECT * WHERE { <a> p:b ?c }", "SELECT ?a ?b { ?a <p> ?b ; <q> 1, 2.0 , -3e1 . }", "SELECT $a { $a a ?t . OPTIONAL { ?t <p> ?u . FILTER (?u > 3) } }",
        "ASK { ( 1 ( 2 ) 'x' ) <p> [ <q> [ ] ] }", 'SELECT ?x { ?x <p> """a "q" b""" , \'\'\'c\'\'\' }', "SELECT ?optional { ?optional <filter> ?union }", "DESCRIBE ?x <y> { ?x <p> 1 }", "CONSTRUCT { ?a <p> [] } WHERE { ?a <q> ?b } ORDER BY ?b LIMIT 3",
        "SELECT ?x { { ?x <a> 1 } UNION { ?x <b> 2 } UNION { ?x <c> 3 } }", "SELECT ?x # comment\n { ?x <p> '\\u00e9' }",
    ],
)
def test_parses(text):
    assert features(parse(text))["form"] in text


@pytest.mark.parametrize("text", ["SELECT { ?a ?b ?c }", "SELECT ?x { ?x <p> }", "SELECT ?x { ?x <p> 1 ", "SELECT ?x { ?x q:p 1 }", "SELECT ?x { ?x <p> 1 } LIMIT -1", "ASK { FILTER bound(?x, ?y) }", "SELECT ?x { 'a' }", "SELECT ?x {} GROUP BY ?x"])
def test_faults(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def test_features():
    f = features(parse("SELECT DISTINCT ?x { ?x <p> ?y OPTIONAL { ?y <q> ?z FILTER(?z > 1) } { ?x <r> 1 } UNION { GRAPH ?g { ?x <s> 2 } } } LIMIT 4"))
    assert (f["distinct"], f["limit"], f["triples"], f["optional"], f["union"], f["graph"], f["filter"], f["variables"]) == (True, 4, 4, 1, 1, 1, 1, ["x", "y", "z", "g"])

import random

from quadrille.operators.graph import Graph
from quadrille.operators.stores import QuadStore
from quadrille.plans.algebra import Triple
from quadrille.plans.compile import Engine, match
from quadrille.solutions import Solutions, join, left_join
from quadrille.terms import DYNAMIC, Bnode, Iri, Literal, Var, decode

E = "http://e/"
i = lambda x: Iri(E + x)
ROWS = [
    (i("a"), i("p"), i("b")), (i("b"), i("p"), i("c")), (i("c"), i("p"), i("c")), (i("a"), i("q"), Literal("1")), (i("c"), i("q"), Literal("2")), (Bnode("x"), i("p"), i("a")),
    (i("a"), i("p"), i("b"), E + "g1"), (i("d"), i("p"), i("a"), E + "g1"), (i("d"), i("q"), Literal("3"), E + "g2"),
]


def rows(result):
    short = lambda x: None if x is None else x.lex if isinstance(x, Literal) else str(x).replace(E, "")
    return sorted((tuple(short(None if x is None else decode(x)) for x in r) for r in result.df.collect()), key=repr)


def run(spark, text, data=ROWS, **options):
    return Engine(Graph.of(spark, data).store(), {"": E}, **options).query(text)


SORTED = [("a", "1"), ("b", None), ("c", "2"), ("d", "3"), ("x", None)]


def test_forms(spark):
    assert rows(run(spark, "SELECT ?x ?y { ?x :p ?y . ?y :p ?z . ?z :q ?v }")) == [("a", "b"), ("b", "c"), ("c", "c")]
    assert rows(run(spark, "SELECT ?x { ?x :p ?x }")) == [("c",)]
    assert rows(run(spark, "SELECT ?x ?v { ?x :p ?y OPTIONAL { ?x :q ?v } }")) == SORTED
    assert {r[0] for r in rows(run(spark, "SELECT ?x { ?x :p ?y OPTIONAL { ?x :q ?v } FILTER(!bound(?v)) }"))} == {"b", "x"}
    assert rows(run(spark, "SELECT ?x { { ?x :q '1' } UNION { ?x :q '1' } }")) == [("a",), ("a",)]
    assert rows(run(spark, "SELECT DISTINCT ?x { { ?x :q '1' } UNION { ?x :q '1' } }")) == [("a",)]
    assert bool(run(spark, "ASK { :a :p :b }")) and not bool(run(spark, "ASK { :a :p :c }"))
    assert rows(run(spark, "SELECT ?v { OPTIONAL { :a :q ?v } }")) == [("1",)] and rows(run(spark, "SELECT ?v { OPTIONAL { :b :q ?v } }")) == [(None,)]
    assert rows(run(spark, "SELECT ?p { :a ?p ?o }")) == [("p",), ("q",)]
    assert rows(run(spark, "SELECT ?x ?missing { ?x :q '1' }")) == [("a", None)]


def test_graphs(spark):
    assert rows(run(spark, "SELECT ?g ?x { GRAPH ?g { ?x :p ?y } }")) == [("g1", "a"), ("g1", "d")]
    assert rows(run(spark, "SELECT ?x { GRAPH :g2 { ?x ?p ?y } }")) == [("d",)]
    assert rows(run(spark, "SELECT ?x FROM :g1 { ?x :p ?y }")) == [("a",), ("d",)]
    assert rows(run(spark, "SELECT ?x FROM :g1 FROM NAMED :g2 { ?x :p ?y GRAPH ?g { ?x :q ?v } }")) == [("d",)]
    assert rows(run(spark, "SELECT ?x { ?x :p :b }")) == [("a",)]  # in two graphs, one triple
    assert rows(run(spark, "SELECT ?x { ?x :p :a }", strict=True)) == [("x",)]


def test_lax_datatypes(spark):
    data = Graph.of(spark, [(i("a"), i("v"), Literal("1")), (i("b"), i("v"), Literal("1", "http://t")), (i("c"), i("v"), Literal("1", "", "en"))])
    for lax, want in ((False, [("a",)]), (True, [("a",), ("b",)])):
        assert rows(Engine(QuadStore(data.quads_df, lax=lax), {"": E}).query("SELECT ?x { ?x :v '1' }")) == want


def test_modifiers(spark):
    assert [decode(r[0]).lex for r in run(spark, "SELECT ?v { ?x :q ?v } ORDER BY DESC(?v)").df.collect()] == ["3", "2", "1"]
    assert [decode(r[0]).lex for r in run(spark, "SELECT ?v { ?x :q ?v } ORDER BY ?v OFFSET 1").df.collect()] == ["2", "3"]
    assert [str(decode(r[0])) for r in run(spark, "SELECT DISTINCT ?y { ?x :p ?y . ?x :q ?v } ORDER BY DESC(?v) LIMIT 2").df.collect()] == [E + "a", E + "c"]
    assert run(spark, "SELECT ?v { ?x :q ?v } LIMIT 0").df.count() == 0


def test_construct_and_describe(spark):
    got = rows(run(spark, "CONSTRUCT { ?y :r ?x . ?x :s ?v . ?v :t ?x . ?x ?v ?y } { ?x :p ?y OPTIONAL { ?x :q ?v } }"))
    assert {("b", "r", "a"), ("a", "s", "1"), ("a", "r", "x")} <= set(got) and not any(r[1] in ("t", "1") for r in got) and len(got) == len(set(got))
    made = run(spark, "CONSTRUCT { _:n :of ?x ; :val ?v } { ?x :q ?v }").df.collect()
    assert len({r.s for r in made}) == 3 and len(made) == 6
    assert set(rows(run(spark, "DESCRIBE ?x { ?x :q '2' }"))) == {("c", "p", "c"), ("c", "q", "2"), ("b", "p", "c")}
    assert run(spark, "CONSTRUCT { ?x :one ?v } { ?x :q ?v } ORDER BY ?v LIMIT 1").df.count() == 1


def test_lists_in_patterns(spark):
    from quadrille.sources import n3

    data = n3.parse(f"@prefix : <{E}>. :s :has (:a 'x' 3) .").triples
    assert rows(run(spark, "SELECT ?s ?m { ?s :has (:a ?m 3) }", data)) == [("s", "x")]


def test_bindings_and_programmatic(spark):
    e = Engine(Graph.of(spark, ROWS).store(), {"": E})
    assert rows(e.query("SELECT ?x ?v { ?x :q ?v }", {"x": i("a")})) == [("a", "1")]
    x, y, v = Var("x"), Var("y"), Var("v")
    s = match(e.store, ["x", "v"], [Triple(x, i("p"), y)], optionals=[[Triple(x, i("q"), v)]], constraints=[lambda s: s.col("y") == f"<{E}b>"])
    assert [tuple(r) for r in s.df.collect()] == [(f"<{E}a>", '"1"')]
    s = match(e.store, ["x"], [Triple(x, i("p"), y), Triple(x, i("q"), v)], per_pattern={1: lambda s: s.col("v") == '"2"'})
    assert [r[0] for r in s.df.collect()] == [f"<{E}c>"]


def mappings(rng, names, n):
    return [{v: rng.choice([None, "1", "2", "3"]) for v in names} for _ in range(n)]


def solutions(spark, names, data):
    df = spark.createDataFrame([tuple(m[v] for v in names) for m in data], ", ".join(f"{v} string" for v in names))
    bound = frozenset(v for v in names if all(m[v] is not None for m in data))
    return Solutions(df, dict.fromkeys(names, DYNAMIC), bound)


def merged(a, b):
    if any(a[v] is not None and b[v] is not None and a[v] != b[v] for v in a if v in b):
        return None
    return {v: a.get(v) if a.get(v) is not None else b.get(v) for v in [*a, *b]}


def test_joins_of_partial_solutions(spark):
    for seed in range(12):
        rng = random.Random(seed)
        shared = ["u", "v", "w"][: rng.randrange(0, 4)]
        left, right = mappings(rng, ["a", *shared], 7), mappings(rng, [*shared, "z"], 7)
        for v in shared:
            if rng.random() < 0.4:
                left = [m | {v: m[v] or "1"} for m in left]
            if rng.random() < 0.4:
                right = [m | {v: m[v] or "2"} for m in right]
        a, b = solutions(spark, ["a", *shared], left), solutions(spark, [*shared, "z"], right)
        names = ["a", *shared, "z"]
        key = lambda ms: sorted(repr([m[v] for v in names]) for m in ms)
        got = key([r.asDict() for r in join(a, b).df.collect()])
        assert got == key([m for x in left for y in right if (m := merged(x, y))])
        got = key([r.asDict() for r in left_join(a, b).df.collect()])
        want = []
        for x in left:
            own = [m for y in right if (m := merged(x, y))]
            want += own or [x | dict.fromkeys([v for v in names if v not in x])]
        assert got == key(want)


def test_join_order_does_not_matter(spark):
    rng = random.Random(9)
    data = [(i(f"n{rng.randrange(12)}"), i(rng.choice("pqr")), i(f"n{rng.randrange(12)}")) for _ in range(80)]
    patterns = ["?a :p ?b .", "?b :q ?c .", "?c :r ?a .", "?a :q ?d ."]
    g = Graph.of(spark, data)
    seen = set()
    for stats in (None, {E + "p": (1, 1, 1), E + "q": (50, 9, 9), E + "r": (9, 5, 5)}):
        for _ in range(2):
            rng.shuffle(patterns)
            e = Engine(QuadStore(g.quads_df, True, stats), {"": E})
            seen.add(tuple(rows(e.query("SELECT ?a ?b ?c ?d { " + " ".join(patterns) + " }"))))
    assert len(seen) == 1


def test_plan_reads_what_it_needs(spark, tmp_path):
    from quadrille.sources.tables import direct_map
    from quadrille.operators.stores import MappedStore

    spark.createDataFrame([(k, f"n{k}", k * 1.5, "x") for k in range(20)], "id long, name string, amount double, extra string").write.parquet(f"{tmp_path}/t.parquet")
    m = direct_map("t", spark.read.parquet(f"{tmp_path}/t.parquet"), ["id"], {})
    r = Engine(MappedStore([m]), {"": "http://ex/"}).query("SELECT ?n { ?x a :T ; :name ?n ; :amount ?a FILTER(?a > 20) }")
    plan = r.values._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "GreaterThan(amount,20.0)" in plan and "extra" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert r.values.count() == 6

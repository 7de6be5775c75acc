import json

from quadrille.__main__ import main
from quadrille.operators.graph import Graph
from quadrille.plans.compile import Engine
from quadrille.service import Service
from quadrille.terms import TYPE, Iri, Literal

E = "http://e/"


def test_service(spark):
    g = Graph.of(spark, [(Iri(E + "a"), Iri(E + "n"), Literal('A"b')), (Iri(E + "a"), Iri(TYPE), Iri(E + "C")), (Iri(E + "b"), Iri(E + "n"), Literal("B"))])
    s = Service(spark, Engine(g.store(), {"": E}))
    s.save("by", "SELECT ?x { ?x :n $name$ }")
    got = json.loads(s.run(s.expand("by", name=Literal('A"b'))))
    assert [b["x"]["value"] for b in got["results"]["bindings"]] == [E + "a"]
    assert "<boolean>true" in s.run("ASK { :a :n ?x }", "xml") and s.run("CONSTRUCT { ?x :m 1 } { ?x :n 'B' }", "nt").count("\n") == 1
    assert [(r["class"], r.instances) for r in s.classes().collect()] == [(f"<{E}C>", 1)] and s.about(E + "a").count() == 2
    s.cancel(s.ticket())


def test_command_line(spark, tmp_path):
    (tmp_path / "d.ttl").write_text(f"@prefix : <{E}>. :a :p :b . :b :p :c .")
    (tmp_path / "r.n3").write_text(f"@prefix : <{E}>. {{ ?x :p ?y. ?y :p ?z }} => {{ ?x :q ?z }} .")
    (tmp_path / "q.rq").write_text(f"SELECT ?x {{ ?x <{E}p> <{E}c> }}")
    assert main(["rules", f"{tmp_path}/d.ttl", f"{tmp_path}/r.n3", "derived"]) == f"<{E}a> <{E}q> <{E}c> .\n"
    assert main(["rules", f"{tmp_path}/d.ttl", f"{tmp_path}/r.n3", "firings"]).startswith("1\t")
    main(["load", f"{tmp_path}/d.ttl", f"{tmp_path}/store"])
    assert json.loads(main(["query", f"{tmp_path}/store", f"{tmp_path}/q.rq"]))["results"]["bindings"][0]["x"]["value"] == E + "b"
    main(["convert", f"{tmp_path}/d.ttl", f"{tmp_path}/d.nt"])
    assert (tmp_path / "d.nt").read_text().count("\n") == 2

"""Store, updates, documents and queries on small quads, with known answers."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tetraspark.operators.intersect import intersect_patterns
from tetraspark.operators.store import SnapshotStore, StoreError, pattern
from tetraspark.operators.terms import DEFAULT_GRAPH, decode, encode
from tetraspark.plans.parser import SparqlError, parse_query
from tetraspark.sources.trig import TrigError, parse_trig, read_files, read_string, write_lines

P = "PREFIX ex: <http://e/> "


def iri(x):
    return f"<http://e/{x}>"


@pytest.fixture
def store(spark):
    s = SnapshotStore(spark)
    s.append(read_string(spark, '''@prefix ex: <http://e/> .
        ex:g1 { ex:a ex:knows ex:b ; ex:name "Ann"@en ; ex:age 30 . ex:b ex:knows ex:c ; ex:age 25.5 }
        ex:c ex:knows ex:a . GRAPH ex:g2 { ex:a ex:knows ex:b }'''))
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_append_keeps_copies_and_delete_counts_them(spark):
    s = SnapshotStore(spark)
    q = (iri("a"), iri("p"), '"x"', iri("g"))
    s.append([q, q])
    assert s.quads.count() == 2
    assert s.delete(s=iri("a")) == 2
    assert s.delete(s=iri("nobody")) == 0
    assert s.quads.count() == 0
    with pytest.raises(ValueError):
        s.append([(iri("a"), None, '"x"', iri("g"))])


def test_save_and_load_keep_contents_and_deletions(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    s.append([(iri(i), iri("p"), f'"{i}"', iri("g")) for i in range(5)])
    s.delete(s=iri(3))
    s.save()
    again = SnapshotStore(spark, str(tmp_path / "store"))
    assert {r.s for r in again.quads.collect()} == {iri(i) for i in (0, 1, 2, 4)}
    again.append([(iri(9), iri("p"), '"9"', iri("g"))])
    assert SnapshotStore(spark, str(tmp_path / "store")).quads.count() == 4  # not saved yet
    again.save()
    assert SnapshotStore(spark, str(tmp_path / "store")).quads.count() == 5


@pytest.mark.parametrize("query, want", [
    ("SELECT ?x ?y { ?x ex:knows ?y }", [(iri("a"), iri("b")), (iri("b"), iri("c")), (iri("c"), iri("a"))]),
    ("SELECT ?y { ex:a ex:knows+ ?y }", [(iri("a"),), (iri("b"),), (iri("c"),)]),
    ("SELECT ?x { ?x ex:knows* ex:b }", [(iri("a"),), (iri("b"),), (iri("c"),)]),
    ("SELECT ?x { ?x ex:age ?a FILTER(?a < 26) }", [(iri("b"),)]),
    ("SELECT ?x { ?x ex:age ?a FILTER(?a > 100 || EXISTS { ?x ex:name ?n }) }", [(iri("a"),)]),
    ("SELECT ?x ?n { ?x ex:age ?a OPTIONAL { ?x ex:name ?n } }", [(iri("a"), '"Ann"@en'), (iri("b"), None)]),
    ("SELECT ?x { ?x ex:knows ?y MINUS { ?x ex:age 30 } }", [(iri("b"),), (iri("c"),)]),
    ("SELECT ?g { GRAPH ?g { ex:a ex:knows ex:b } }", [(iri("g1"),), (iri("g2"),)]),
    ("SELECT (1/0 AS ?x) {}", [(None,)]),
    ("SELECT (COUNT(*) AS ?n) { ?x ex:nothing ?y }", [('"0"^^<http://www.w3.org/2001/XMLSchema#integer>',)]),
    ("SELECT ?z { ?x ex:knows ?y OPTIONAL { ?x ex:name ?z } OPTIONAL { ?y ex:name ?z } }", [('"Ann"@en',), ('"Ann"@en',), (None,)]),
    ("ASK { ex:a ex:knows ex:c }", [(False,)]),
    ("SELECT ?x { ?x ex:knows ?x }", []),
])
def test_sparql(store, query, want):
    assert rows(store.sparql(P + query)) == sorted(want, key=repr)


def test_construct_gives_each_solution_its_own_blank_node(store):
    got = rows(store.sparql(P + "CONSTRUCT { _:z ex:of ?x } { ?x ex:knows ?y }"))
    assert len(got) == 3 and len({g[0] for g in got}) == 3


def test_updates(store):
    store.update(P + "DELETE { GRAPH ex:g1 { ?x ex:age ?a } } INSERT { ?x ex:old ?a } WHERE { ?x ex:age ?a FILTER(?a > 26) }")
    assert rows(store.query(p=iri("age")).select("s")) == [(iri("b"),)]
    assert rows(store.query(p=iri("old")).select("s", "g")) == [(iri("a"), DEFAULT_GRAPH)]
    store.update(P + 'INSERT DATA { GRAPH ex:g9 { ex:q ex:w "v" } } ; DELETE DATA { ex:c ex:knows ex:a }')
    assert store.query(g=iri("g9")).count() == 1 and store.query(s=iri("c")).count() == 0
    store.update(P + "DROP GRAPH ex:g2")
    assert iri("g2") not in {r.g for r in store.graph_names().collect()}
    with pytest.raises(StoreError, match="does not exist"):
        store.update(P + "DROP GRAPH ex:g2")
    store.update(P + "DROP SILENT GRAPH ex:g2 ; CLEAR NAMED")
    assert {r.g for r in store.graph_names().collect()} == {DEFAULT_GRAPH}
    with pytest.raises(StoreError, match="Unsupported"):
        store.update("LOAD <http://e/x>")
    with pytest.raises(StoreError, match="parse"):
        store.update("DELETE nonsense")
    store.update("DROP ALL")
    assert store.quads.count() == 0


def test_loaded_text_can_be_deleted_by_an_update(spark):
    s = SnapshotStore(spark)
    s.append(read_string(spark, '@prefix ex: <http://e/> . ex:a ex:name "Ann" , "Anne"@fr .'))
    s.update(P + 'DELETE DATA { ex:a ex:name "Ann" , "Anne"@fr }')
    assert s.quads.count() == 0


def test_intersection_is_no_join(store):
    q = store.quads
    assert intersect_patterns(q, [(None, iri("knows"), None), (None, None, iri("b"))]).count() == 2
    assert intersect_patterns(q, [(None, iri("knows"), None), (None, iri("age"), None)]).count() == 0
    assert intersect_patterns(q, []).count() == 0


@pytest.mark.parametrize("doc, n", [
    ("@prefix ex: <http://e/> . ex:a ex:b (ex:c ex:d ex:e) .", 7),
    ('PREFIX ex: <http://e/> ex:a ex:b [ ex:c "B" ; ex:d 25 ] .', 3),
    ("@base <http://e/x/> . <a> <b> <c> , <d> ; <e> true .", 3),
    ('<http://e/a> <http://e/b> """long "quoted" text""", "caf\\u00e9" .', 2),
    ("", 0),
    ("@prefix ex: <http://e/> . { ex:a ex:b _:x . _:x ex:b [] }", 2),
    ("@prefix ex: <http://e/> . _:g { [ ex:p 1 ] ex:q 2 . [ ex:r 3 ] }", 3),
])
def test_trig(doc, n):
    assert len(parse_trig(doc)) == n


@pytest.mark.parametrize("doc", ["<http://e/a> <http://e/b> .", "ex:a ex:b ex:c .", "<http://e/a> <http://e/b> <http://e/c>", "{ <http://e/a>", '"x" <http://e/b> 1 .'])
def test_faulty_trig(doc):
    with pytest.raises(TrigError, match="Syntax error at"):
        parse_trig(doc)


def test_files_keep_their_blank_nodes_apart(spark, tmp_path):
    for n in "xy":
        (tmp_path / f"{n}.trig").write_text("_:b <http://e/p> 1 .")
    quads = read_files(spark, str(tmp_path))
    assert quads.select("s").distinct().count() == 2
    write_lines(quads, str(tmp_path / "out"))
    back = read_files(spark, str(tmp_path / "out"))
    assert back.count() == 2


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x", "SELECT ?x WHERE { ?x", "FOO", "", "SELECT ?x WHERE { ?x ?y ?z } LIMIT x", "ASK { u:x ?y ?z }"])
def test_malformed_queries(text):
    with pytest.raises(SparqlError):
        parse_query(text)


@given(st.sampled_from("IBL"), st.text(st.characters(exclude_categories=["Cs"]), max_size=20))
def test_terms_round_trip(kind, lex):
    lex = lex if kind == "L" else "".join(c for c in lex if c.isalnum())
    assert decode(encode(kind, lex))[:2] == (kind, lex)


name = st.sampled_from("abc").map(iri)
quad = st.tuples(name, name, name, name)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(quad, min_size=1, max_size=12), st.tuples(*[st.none() | name] * 4))
def test_delete_then_scan(spark, quads, by):
    s = SnapshotStore(spark)
    s.append(quads)
    hit = [q for q in quads if all(b in (None, x) for b, x in zip(by, q))]
    assert s.query(*by).count() == len(hit)
    assert s.delete(*by) == len(hit)
    assert rows(s.quads) == sorted([q for q in quads if q not in hit], key=repr)
    assert s.quads.where(pattern(*by)).count() == 0


def ask(store, text):
    return [tuple(r) for r in store.sparql(P + "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + text).collect()]


def test_filters_that_name_exists(spark):
    """A literal that says "exists" is no EXISTS."""
    s = SnapshotStore(spark)
    s.append(read_string(spark, '@prefix ex: <http://e/> . ex:a ex:n 1 ; ex:k "exists" . ex:b ex:n 1 ; ex:k "x" . ex:c ex:n 1 .'))
    assert sorted(ask(s, 'SELECT ?x { ?x ex:n ?v FILTER NOT EXISTS { ?x ex:k ?y FILTER(?y = "exists") } }')) == [(iri("b"),), (iri("c"),)]
    assert sorted(ask(s, 'SELECT ?x { ?x ex:n ?v FILTER EXISTS { ?x ex:k ?y FILTER(?y != "exists") } }')) == [(iri("b"),)]


def test_distinct_sorts_by_what_it_does_not_return(spark):
    s = SnapshotStore(spark)
    s.append(read_string(spark, '@prefix ex: <http://e/> . ex:a ex:n "p" ; ex:age 30 . ex:b ex:n "q" ; ex:age 25 . ex:c ex:n "p" ; ex:age 20 . ex:d ex:n "r" ; ex:age 27 .'))
    assert ask(s, "SELECT DISTINCT ?n { ?x ex:n ?n ; ex:age ?a } ORDER BY ?a") == [('"p"',), ('"q"',), ('"r"',)]
    assert ask(s, "SELECT DISTINCT ?n { ?x ex:n ?n ; ex:age ?a } ORDER BY DESC(?a) LIMIT 2") == [('"p"',), ('"r"',)]


@pytest.mark.parametrize("expression, want", [
    ('"2020-01-01T12:00:00Z"^^xsd:dateTime = "2020-01-01T12:00:00+05:00"^^xsd:dateTime', '"false"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('"2020-01-01T12:00:00Z"^^xsd:dateTime = "2020-01-01T17:30:00+05:30"^^xsd:dateTime', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('"2020-01-01T12:00:00-01:00"^^xsd:dateTime > "2020-01-01T12:30:00Z"^^xsd:dateTime', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('HOURS("2020-01-01T12:00:00+05:00"^^xsd:dateTime)', '"12"^^<http://www.w3.org/2001/XMLSchema#integer>'),
    ('REGEX("abc", "a.c", "q")', '"false"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('REGEX("xA.cx", "a.c", "qi")', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('REGEX("a", "(")', None), ('REPLACE("a", "(", "b")', None), ('"a" = 5', None), ('"a" != 5', None), ('"a" = "b"', '"false"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('SUBSTR("motor", 99999999999)', '""'), ('SUBSTR("motor", 2, 99999999999)', '"otor"'), ('SUBSTR("motor", -99999999999, 99999999999)', '""'),
    ("9223372036854775807 + 1", None), ('DATATYPE(99999999999999999999)', "<http://www.w3.org/2001/XMLSchema#integer>"),
    ('99999999999999999999 > 5', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ('STR("a\\uE001b\\\\\\\\c")', '"ab\\\\\\\\c"'),
])
def test_expressions(spark, expression, want):
    s = SnapshotStore(spark)
    s.append([(iri("a"), iri("p"), '"x"', DEFAULT_GRAPH)])
    assert ask(s, f"SELECT ?v {{ ?s ex:p ?o BIND({expression} AS ?v) }}") == [(want,)]


def test_sums_beyond_the_type_are_unbound(spark):
    s = SnapshotStore(spark)
    s.append([(iri(i), iri("p"), f'"{2**63 - 1 - i}"^^<http://www.w3.org/2001/XMLSchema#integer>', DEFAULT_GRAPH) for i in range(3)])
    assert len(ask(s, "SELECT (SUM(?o) AS ?t) { VALUES ?o { 9223372036854775807 9223372036854775806 } }")) == 1
    assert ask(s, "SELECT (SUM(?o) AS ?t) (COUNT(?o) AS ?n) { ?s ex:q ?o }")[0][1].startswith('"0"')


def test_an_unfinished_save_blocks_nothing(spark, tmp_path):
    at = tmp_path / "store"
    (at / "v1").mkdir(parents=True)
    s = SnapshotStore(spark, str(at))
    s.append([(iri("a"), iri("p"), '"x"', iri("g"))])
    s.save()
    other = SnapshotStore(spark, str(at))
    assert other.quads.count() == 1
    other.append([(iri("b"), iri("p"), '"y"', iri("g"))])
    other.save()
    s.append([(iri("c"), iri("p"), '"z"', iri("g"))])  # a writer that has not seen the other's version
    s.save()
    assert rows(SnapshotStore(spark, str(at)).quads.select("s")) == [(iri("a"),), (iri("c"),)]


def test_nulls_in_a_data_frame_are_refused_at_once(spark):
    with pytest.raises(ValueError):
        SnapshotStore(spark).append(spark.createDataFrame([(iri("a"), None, '"x"', iri("g"))], "s string, p string, o string, g string"))


QUAD = st.tuples(*[st.sampled_from([iri(c) for c in x]) for x in ("abc", "pq", "xy", "gh")])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(QUAD, min_size=1, max_size=12), QUAD)
def test_properties_of_deletion_and_reload(spark, tmp_path_factory, quads, gone):
    """Deleting a graph or removing quads takes these and nothing else, also after a save and reload."""
    at = str(tmp_path_factory.mktemp("s"))
    s = SnapshotStore(spark, at)
    s.append(quads)
    assert s.delete_graph(gone[3]) == sum(q[3] == gone[3] for q in quads)
    left = [q for q in quads if q[3] != gone[3]]
    s.update(f"DELETE DATA {{ GRAPH {quads[0][3]} {{ {' '.join(quads[0][:3])} }} }} ; INSERT DATA {{ GRAPH {gone[3]} {{ {' '.join(gone[:3])} }} }}")
    left = [q for q in left if q != quads[0]] + [gone]
    s.save()
    assert rows(SnapshotStore(spark, at).quads) == sorted(left, key=repr)

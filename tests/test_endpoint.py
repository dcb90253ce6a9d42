"""The HTTP surface, the result formats and the pushed forms, on small quads."""

import http.client
import io
import json
import threading
from urllib.parse import quote, urlencode

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tetraspark import endpoint
from tetraspark.operators.intersect import intersect_patterns
from tetraspark.operators.store import SnapshotStore, StoreError
from tetraspark.operators.terms import DEFAULT_GRAPH
from tetraspark.sources.results import json_text, turtle_text, write_turtle
from tetraspark.sources.trig import TrigError, parse_trig, read_files, read_reader, read_stream, read_string

DOCUMENT = '''@prefix ex: <http://e/> .
    ex:a ex:knows ex:b ; ex:name "Ann \\"A\\"\\n"@en ; ex:age 30 .
    ex:g { ex:b a ex:Person ; ex:knows [ ex:name "Zoë" ] }'''
SELECT = "PREFIX ex: <http://e/> SELECT ?x ?n ?z { ?x ex:name ?n OPTIONAL { ?x ex:age ?z } FILTER(isIRI(?x)) } ORDER BY ?n"


@pytest.fixture(scope="module")
def store(spark):
    s = SnapshotStore(spark)
    s.append(read_string(spark, DOCUMENT))
    return s


def get(store, query):
    return endpoint.respond(store, "GET", "/sparql?" + urlencode({"query": query}))


def test_select_as_json(store):
    r = get(store, SELECT)
    assert (r.status, r.kind) == (200, "application/sparql-results+json")
    assert json.loads(r.text()) == {"head": {"vars": ["x", "n", "z"]}, "results": {"bindings": [{
        "x": {"type": "uri", "value": "http://e/a"},
        "n": {"type": "literal", "value": 'Ann "A"\n', "xml:lang": "en"},
        "z": {"type": "literal", "value": "30", "datatype": "http://www.w3.org/2001/XMLSchema#integer"},
    }]}}


def test_blank_nodes_and_unbound_variables_as_json(store):
    text = get(store, "PREFIX ex: <http://e/> SELECT ?x ?n ?z { GRAPH ex:g { ?x ex:name ?n OPTIONAL { ?x ex:age ?z } } }").text()
    (row,) = json.loads(text)["results"]["bindings"]
    assert row["x"]["type"] == "bnode" and not row["x"]["value"].startswith("_:")
    assert row["n"] == {"type": "literal", "value": "Zoë"} and "z" not in row


def test_empty_answers(store):
    assert json.loads(get(store, "SELECT ?x { ?x <http://e/none> ?y }").text()) == {"head": {"vars": ["x"]}, "results": {"bindings": []}}
    assert get(store, "CONSTRUCT { ?x <http://e/p> ?y } WHERE { ?x <http://e/none> ?y }").text() == ""


@pytest.mark.parametrize("query, want", [("ASK { ?x <http://e/knows> ?y }", True), ("ASK { ?x <http://e/none> ?y }", False)])
def test_ask(store, query, want):
    r = get(store, query)
    assert r.kind == "application/sparql-results+json" and json.loads(r.text()) == {"head": {}, "boolean": want}


def test_construct_is_turtle_that_reads_back(store):
    r = get(store, "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }")
    assert (r.status, r.kind) == (200, "text/turtle")
    plain = lambda quads: sorted((s if s[0] == "<" else "_", p, o if o[0] != "_" else "_") for s, p, o, _ in quads)
    text = r.text()
    assert "<http://e/b> a <http://e/Person> ." in text
    assert plain(parse_trig(text)) == plain(parse_trig(DOCUMENT))  # a query without a graph sees all of them


def test_turtle_with_prefixes(spark, store, tmp_path):
    triples = store.load_graph("<http://e/g>")
    text = "".join(turtle_text(triples, {"ex": "http://e/", "": "http://e/Per"}))
    assert "ex:b a :son ." in text
    plain = lambda quads: sorted((s if s[0] == "<" else "_", p, o if o[0] != "_" else "_") for s, p, o, _ in quads)
    want = [t for t in parse_trig(DOCUMENT) if t[3] != DEFAULT_GRAPH]
    assert plain(parse_trig(text)) == plain(want)
    write_turtle(triples, str(tmp_path / "t"))
    assert plain(read_files(spark, str(tmp_path / "t/*.txt")).collect()) == plain(want)
    with pytest.raises(ValueError):
        list(turtle_text(triples, {"e x": "http://e/"}))


QUERY, UPDATE, FORM = "application/sparql-query", "application/sparql-update", "application/x-www-form-urlencoded"


@pytest.mark.parametrize("method, target, kind, body, status", [
    ("GET", "/sparql", "", "", 400),
    ("GET", "/sparql?query=", "", "", 400),
    ("GET", "/sparql?query=" + quote("SELECT WHERE"), "", "", 400),
    ("GET", "/sparql?query=" + quote("SELECT * { SERVICE <http://e/x> { ?s ?p ?o } }"), "", "", 501),
    ("POST", "/sparql", QUERY, " ", 400),
    ("POST", "/sparql", QUERY, "SELECT {", 400),
    ("POST", "/sparql", FORM, "other=1", 400),
    ("POST", "/sparql", UPDATE, "", 400),
    ("POST", "/sparql", UPDATE, "CLEAR ALL", 501),
    ("POST", "/sparql", "text/plain", "ASK { ?s ?p ?o }", 400),
    ("POST", "/sparql", "", "ASK { ?s ?p ?o }", 400),
    ("PUT", "/sparql/graph", "text/turtle", "", 501),
    ("POST", "/sparql/graph", "text/turtle", "", 501),
    ("DELETE", "/sparql/graph?graph=http://e/g", "", "", 501),
    ("GET", "/elsewhere", "", "", 404),
])
def test_refusals_say_why(store, method, target, kind, body, status):
    r = endpoint.respond(store, method, target, kind, body.encode())
    assert r.status == status and r.text().strip()


def test_invalid_bytes_and_failures(spark, store):
    assert endpoint.respond(store, "POST", "/sparql", QUERY, b"\xff").status == 400
    with SnapshotStore(spark) as closed:
        pass
    r = get(closed, "ASK { ?s ?p ?o }")
    assert r.status == 500 and "closed" not in r.text()


def test_graphs(store):
    all_, one, default = (endpoint.respond(store, "GET", "/sparql/graph" + x) for x in ("", "?graph=" + quote("http://e/g"), "?default="))
    assert all_.kind == "text/turtle"
    sizes = [len(r.text().splitlines()) for r in (all_, one, default)]
    assert sizes == [6, 3, 3]


@given(st.sampled_from(["a", "b", "none"]), st.sampled_from(["knows", "name", "age"]), st.integers(1, 3))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_three_ways_to_ask_give_one_answer(store, s, p, n):
    query = f"SELECT ?o {{ <http://e/{s}> <http://e/{p}> ?o }} ORDER BY ?o LIMIT {n}"
    ways = [get(store, query), endpoint.respond(store, "POST", "/sparql", QUERY + "; charset=utf-8", query.encode()),
            endpoint.respond(store, "POST", "/sparql", FORM, urlencode({"query": query}).encode())]
    assert len({(r.status, r.kind, r.text()) for r in ways}) == 1


def test_over_a_socket(store):
    server = endpoint.make_server(store, largest_body=1000)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        c = http.client.HTTPConnection(*server.server_address, timeout=120)
        for body, status in ((SELECT, 200), ("SELECT {", 400), ("#" * 2000, 413)):
            c.request("POST", "/sparql", body, {"Content-Type": QUERY})
            r = c.getresponse()
            text = r.read().decode()
            assert r.status == status
            if status == 200:
                assert len(json.loads(text)["results"]["bindings"]) == 1
    finally:
        server.shutdown()
        server.server_close()
        thread.join(30)


class Heard:
    def __init__(self, stop=None):
        self.calls, self.stop = [], stop

    def start(self):
        self.calls.append("start")

    def triple(self, s, p, o):
        self.calls.append((s, p, o))
        return len(self.calls) <= self.stop if self.stop else None

    def row(self, bindings):
        self.calls.append(bindings)

    def answer(self, value):
        self.calls.append(value)

    def end(self, ok):
        self.calls.append(("end", ok))


def test_pushed_forms(store):
    h = Heard()
    store.send_graph(h, "<http://e/g>")
    assert h.calls[0] == "start" and h.calls[-1] == ("end", True) and len(h.calls) == 5
    h = Heard(stop=1)
    store.send_graph(h)
    assert len(h.calls) == 3
    triples, rows = Heard(), Heard()
    store.send_query(SELECT, triples, rows)
    store.send_query("ASK { ?s ?p ?o }", triples, rows)
    store.send_query("CONSTRUCT { ?s <http://e/p> ?o } WHERE { ?s <http://e/age> ?o }", triples, rows)
    assert triples.calls == ["start", ("<http://e/a>", "<http://e/p>", '"30"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("end", True)]
    assert rows.calls[1]["x"] == "<http://e/a>" and True in rows.calls


def test_a_failing_handler_is_told_so(store):
    h = Heard()
    h.triple = lambda *t: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.send_graph(h)
    assert h.calls == ["start", ("end", False)]


def test_closing_saves_nothing(spark, tmp_path):
    with SnapshotStore(spark, str(tmp_path / "s")) as s:
        s.append([("<http://e/a>", "<http://e/p>", '"x"', DEFAULT_GRAPH)])
        assert s.ready and s.count() == 1
    assert not s.ready
    with pytest.raises(StoreError):
        s.query()
    assert SnapshotStore(spark, str(tmp_path / "s")).count() == 0
    assert s.can_update and s.can_delete and s.can_list_graphs and not s.read_only


def test_open_sources(spark):
    want = sorted(map(tuple, read_string(spark, DOCUMENT).collect()))
    assert sorted(map(tuple, read_reader(spark, io.StringIO(DOCUMENT)).collect())) == want
    for bom in (b"", b"\xef\xbb\xbf"):
        assert sorted(map(tuple, read_stream(spark, io.BytesIO(bom + DOCUMENT.encode())).collect())) == want
    for read in (read_reader, read_stream):
        with pytest.raises(ValueError):
            read(spark, None)
    with pytest.raises(TrigError):
        read_stream(spark, io.BytesIO(b"<http://e/a> <http://e/b> ."))


def test_both_forms_of_an_iri_are_found(spark):
    quads = spark.createDataFrame([("a", "<p>", "<b>", "g"), ("<a>", "p", "c", "g"), ("x", "p", "b", "g")], "s string, p string, o string, g string")
    for s in ("a", "<a>"):
        assert {r.o for r in intersect_patterns(quads, [(s, "p", None)]).collect()} == {"<b>", "c"}
    assert {tuple(r) for r in intersect_patterns(quads, [("a", None, None), (None, None, "<b>")]).collect()} == {("<p>", "<b>")}

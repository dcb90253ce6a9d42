"""Registered queries over the given tables, viewed as RDF, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terms as T
from ..operators.intersect import intersect_patterns, simple_query
from ..operators.store import SnapshotStore
from ..sources.mapping import EX, example_views
from ..sources.trig import parse_trig
from .compiler import run_query
from .solution import as_term

PREFIXES = f"PREFIX ex: <{EX}> PREFIX cls: <{EX}class/> PREFIX g: <{EX}g/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "

#: name: (tables, SPARQL, SQL)
SPARQL: dict[str, tuple[str, str, str]] = {
    "bgp_star": ("customer", "SELECT ?c ?n ?s WHERE { ?c ex:name ?n ; ex:segment ?s ; ex:balance ?b FILTER(?b > 5000) }", "SELECT 'http://example.org/customer/' || c_custkey AS c, c_name AS n, c_mktsegment AS s FROM customer WHERE c_acctbal > 5000"),
    "bgp_join": ("customer nation region", "SELECT ?c ?rn WHERE { ?c ex:nation ?n . ?c ex:segment ?s . ?n ex:region ?r . ?n ex:name ?nn . ?r ex:name ?rn }", "SELECT 'http://example.org/customer/' || c_custkey AS c, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "group_by_revenue": ("orders customer nation", "SELECT ?name (xsd:double(SUM(xsd:decimal(?p))) AS ?total) (COUNT(*) AS ?n) WHERE { ?o ex:customer ?c ; ex:price ?p . ?c ex:nation ?k ; ex:segment ?seg . ?k ex:name ?name ; ex:region ?r } GROUP BY ?name", "SELECT n_name AS name, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "optional": ("customer orders", "SELECT ?c ?o WHERE { ?c ex:segment ?s OPTIONAL { ?o ex:customer ?c ; ex:price ?p FILTER(?p > 100000) } }", "SELECT 'http://example.org/customer/' || c_custkey AS c, 'http://example.org/orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000"),
    "union": ("customer supplier", "SELECT ?x ?n WHERE { { ?x a cls:customer ; ex:name ?n } UNION { ?x a cls:supplier ; ex:name ?n } }", "SELECT 'http://example.org/customer/' || c_custkey AS x, c_name AS n FROM customer UNION ALL SELECT 'http://example.org/supplier/' || s_suppkey, s_name FROM supplier"),
    "minus": ("customer orders", "SELECT ?c WHERE { ?c a cls:customer MINUS { ?o ex:customer ?c ; ex:status \"F\" } }", "SELECT 'http://example.org/customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "filter_exists": ("customer orders", "SELECT ?c WHERE { ?c a cls:customer FILTER EXISTS { ?o ex:customer ?c ; ex:status \"O\" } }", "SELECT 'http://example.org/customer/' || c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"),
    "filter_not_exists": ("customer orders", "SELECT ?c WHERE { ?c ex:balance ?b FILTER NOT EXISTS { ?o ex:customer ?c ; ex:price ?p FILTER(?p > ?b) } }", "SELECT 'http://example.org/customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal)"),
    "not_exists_some": ("customer orders", "SELECT ?c WHERE { ?c a cls:customer FILTER NOT EXISTS { ?o ex:customer ?c ; ex:status \"F\" ; ex:priority ?p FILTER(?p != \"exists\") } }", "SELECT 'http://example.org/customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "distinct_order_limit": ("orders", "SELECT DISTINCT ?c WHERE { ?o ex:customer ?c ; ex:price ?p } ORDER BY DESC(?p) ?o LIMIT 15", "SELECT c FROM (SELECT 'http://example.org/customer/' || o_custkey AS c, max(o_totalprice) AS p FROM orders GROUP BY o_custkey ORDER BY p DESC, c LIMIT 15)"),
    "aggregates_of_none": ("orders", "SELECT (COUNT(?o) AS ?n) (SUM(?p) AS ?t) WHERE { ?o ex:status \"none\" ; ex:price ?p }", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS t"),
    "ask_false": ("orders", "ASK { ?o ex:status \"none\" }", "SELECT false AS answer"),
    "bind": ("part", "SELECT ?p ?big ?len WHERE { ?p ex:name ?n ; ex:size ?z BIND(IF(?z > 25, \"big\", \"small\") AS ?big) BIND(STRLEN(?n) AS ?len) }", "SELECT 'http://example.org/part/' || p_partkey AS p, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS big, length(p_name) AS len FROM part"),
    "values": ("nation region", "SELECT ?n ?rn WHERE { VALUES ?rn { \"ASIA\" \"EUROPE\" } ?k ex:name ?n ; ex:region ?r . ?r ex:name ?rn }", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')"),
    "having": ("orders", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 12)", "SELECT 'http://example.org/customer/' || o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "aggregates": ("orders", "SELECT ?s (MIN(?p) AS ?low) (MAX(?p) AS ?high) (COUNT(DISTINCT ?c) AS ?customers) (MIN(?d) AS ?first) WHERE { ?o ex:status ?s ; ex:price ?p ; ex:customer ?c ; ex:date ?d } GROUP BY ?s", "SELECT o_orderstatus AS s, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, COUNT(DISTINCT o_custkey) AS customers, MIN(o_orderdate) AS \"first\" FROM orders GROUP BY o_orderstatus"),
    "group_concat": ("nation region", "SELECT ?rn (GROUP_CONCAT(?n; SEPARATOR=\",\") AS ?names) WHERE { ?k ex:name ?n ; ex:region ?r . ?r ex:name ?rn } GROUP BY ?rn", "SELECT r_name AS rn, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "distinct": ("orders", "SELECT DISTINCT ?s ?p WHERE { ?o ex:status ?s ; ex:priority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "order_limit": ("orders", "SELECT ?o ?p WHERE { ?o ex:price ?p } ORDER BY DESC(?p) ?o LIMIT 20 OFFSET 5", "SELECT o, p FROM (SELECT 'http://example.org/orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 20 OFFSET 5)"),
    "subselect": ("orders customer", "SELECT ?c ?name ?n WHERE { { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o ex:customer ?c } GROUP BY ?c } ?c ex:name ?name ; ex:segment \"BUILDING\" }", "SELECT 'http://example.org/customer/' || c_custkey AS c, c_name AS name, n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "graph_variable": ("customer supplier nation", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x ex:name ?name } } GROUP BY ?g", "SELECT 'http://example.org/g/' || t AS g, COUNT(*) AS n FROM (SELECT 'customer' AS t FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'nation' FROM nation) GROUP BY t"),
    "graph_constant": ("supplier nation", "SELECT ?x ?n WHERE { GRAPH g:supplier { ?x ex:name ?n } }", "SELECT 'http://example.org/supplier/' || s_suppkey AS x, s_name AS n FROM supplier"),
    "from_named": ("customer supplier", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED g:supplier WHERE { GRAPH ?g { ?x ex:name ?name } } GROUP BY ?g", "SELECT 'http://example.org/g/supplier' AS g, COUNT(*) AS n FROM supplier"),
    "path_sequence": ("orders customer nation region", "SELECT ?o ?rn WHERE { ?o ex:customer/ex:nation/ex:region/ex:name ?rn }", "SELECT 'http://example.org/orders/' || o_orderkey AS o, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse_alternative": ("customer supplier nation", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?n ^(ex:nation|ex:region) ?x } GROUP BY ?n", "SELECT n, COUNT(*) AS k FROM (SELECT 'http://example.org/nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'http://example.org/nation/' || s_nationkey FROM supplier UNION ALL SELECT 'http://example.org/region/' || n_regionkey FROM nation) GROUP BY n"),
    "path_negated": ("nation region", "SELECT ?x (COUNT(*) AS ?k) WHERE { ?x !(ex:name|a) ?y } GROUP BY ?x", "SELECT 'http://example.org/nation/' || n_nationkey AS x, 1 AS k FROM nation"),
    "path_plus": ("nation region", "SELECT ?x ?y WHERE { ?x ex:region+ ?y }", "SELECT '<http://example.org/nation/' || n_nationkey || '>' AS x, '<http://example.org/region/' || n_regionkey || '>' AS y FROM nation"),
    "point_lookup": ("orders", "SELECT ?p ?v WHERE { <http://example.org/orders/7> ?p ?v FILTER(isIRI(?v)) }", "SELECT 'http://example.org/customer' AS p, '<http://example.org/customer/' || o_custkey || '>' AS v FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '<http://example.org/class/orders>' FROM orders WHERE o_orderkey = 7"),
    "ask": ("orders", "ASK { ?o ex:status \"F\" ; ex:price ?p FILTER(?p > 1000) }", "SELECT COUNT(*) > 0 AS answer FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000"),
    "construct": ("customer nation", "CONSTRUCT { ?k ex:home ?c } WHERE { ?c ex:nation ?k ; ex:segment \"MACHINERY\" }", "SELECT DISTINCT '<http://example.org/nation/' || c_nationkey || '>' AS s, '<http://example.org/home>' AS p, '<http://example.org/customer/' || c_custkey || '>' AS o FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "describe": ("nation region", "DESCRIBE <http://example.org/nation/3>", "SELECT '<http://example.org/nation/3>' AS s, '<http://example.org/name>' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '<http://example.org/nation/3>', '<http://example.org/region>', '<http://example.org/region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '<http://example.org/nation/3>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://example.org/class/nation>' FROM nation WHERE n_nationkey = 3"),
    "string_functions": ("part", "SELECT ?p (UCASE(?n) AS ?u) (SUBSTR(?n, 2, 4) AS ?m) (STRBEFORE(?n, \" \") AS ?b) (STRAFTER(?n, \" \") AS ?a) (CONTAINS(?n, \"a\") AS ?h) (REPLACE(?n, \"a\", \"_\") AS ?r) (CONCAT(?n, \"!\") AS ?e) (SHA256(?n) AS ?d) WHERE { ?p ex:name ?n ; ex:brand ?x }", "SELECT 'http://example.org/part/' || p_partkey AS p, upper(p_name) AS u, substring(p_name, 2, 4) AS m, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS b, CASE WHEN contains(p_name, ' ') THEN substring(p_name, position(' ' IN p_name) + 1) ELSE '' END AS a, contains(p_name, 'a') AS h, replace(p_name, 'a', '_') AS r, p_name || '!' AS e, sha256(p_name) AS d FROM part"),
    "date_functions": ("orders", "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o ex:date ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY ALL"),
    "numeric_functions": ("supplier", "SELECT ?s (FLOOR(?b) AS ?f) (CEIL(?b) AS ?c) (ABS(?b) AS ?a) (?b * 2 AS ?t) WHERE { ?s ex:balance ?b ; ex:name ?n }", "SELECT 'http://example.org/supplier/' || s_suppkey AS s, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, abs(s_acctbal) AS a, s_acctbal * 2 AS t FROM supplier"),
    "regex_filter": ("part", "SELECT ?p WHERE { ?p ex:name ?n ; ex:brand ?b FILTER(REGEX(?n, \"^[a-m]\", \"i\") && STRENDS(?b, \"3\")) }", "SELECT 'http://example.org/part/' || p_partkey AS p FROM part WHERE regexp_matches(p_name, '^[a-mA-M]') AND p_brand LIKE '%3'"),
    "events_by_user": ("events", "SELECT ?u (COUNT(*) AS ?n) (COUNT(DISTINCT ?t) AS ?kinds) WHERE { ?e ex:user ?u ; ex:eventType ?t } GROUP BY ?u", "SELECT user_id AS u, COUNT(*) AS n, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY user_id"),
}


def _sparql(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(spark, example_views(spark, sf_dir, tables.split()), PREFIXES + text, native=True)


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region as stored quads."""
    out = None
    for df, reps in example_views(spark, sf_dir, ["nation", "region"]).match(None, None, None, None):
        part = df.select(*[as_term(F.col(c), reps[c]).alias(c) for c in "spog"])
        out = part if out is None else out.unionByName(part)
    return out


def _store(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    store = SnapshotStore(spark)
    store.append(nation_quads(spark, sf_dir))
    return store


def store_scan(spark, sf_dir):
    return _store(spark, sf_dir).query().groupBy("g", "p").agg(F.count("*").alias("n"))


def store_filter(spark, sf_dir):
    return _store(spark, sf_dir).query(p=f"<{EX}region>", o=f"<{EX}region/1>").select("s", "o")


def store_delete(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete(o=f"<{EX}region/1>")
    return store.query(p=f"<{EX}region>").select("s", "o")


def store_graphs(spark, sf_dir):
    return _store(spark, sf_dir).list_graphs()


def update_modify(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update(PREFIXES + "DELETE { GRAPH ?g { ?n ex:region ?r } } INSERT { GRAPH ex:moved { ?r ex:holds ?n } } WHERE { GRAPH ?g { ?n ex:region ?r } }")
    return store.query(g=f"<{EX}moved>").select("s", "p", "o").unionByName(store.query(p=f"<{EX}region>").select("s", "p", "o"))


def update_drop(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update(f"INSERT DATA {{ <{EX}a> <{EX}b> 5 }} ; DROP GRAPH <{EX}g/nation>")
    return store.quads.groupBy("g").agg(F.count("*").alias("n"))


def path_ring(spark, sf_dir):
    """The closure of a ring of all nations: every pair, itself included."""
    store = SnapshotStore(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = nations.count()
    iri = lambda c: F.concat(F.lit(f"<{EX}nation/"), c.cast("string"), F.lit(">"))
    store.append(nations.select(iri(F.col("n_nationkey")).alias("s"), F.lit(f"<{EX}next>").alias("p"), iri((F.col("n_nationkey") + 1) % n).alias("o"), F.lit(T.DEFAULT_GRAPH).alias("g")))
    return store.sparql(PREFIXES + "SELECT ?x ?y WHERE { ?x ex:next+ ?y }")


def delete_duplicates(spark, sf_dir):
    """A deletion takes all copies of a quad."""
    store = _store(spark, sf_dir)
    store.append(nation_quads(spark, sf_dir))
    store.delete(p=f"<{EX}name>")
    return store.quads.groupBy("p").agg(F.count("*").alias("n"))


def update_delete_data(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update(f"DELETE DATA {{ GRAPH <{EX}g/nation> {{ <{EX}nation/1> <{EX}region> <{EX}region/1> . <{EX}nation/0> <{EX}region> <{EX}region/9> }} }}")
    return store.query(p=f"<{EX}region>").select("s", "o")


def update_clear_default(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update(f"INSERT DATA {{ <{EX}a> <{EX}b> 5 , 6 }} ; CLEAR DEFAULT")
    return store.quads.groupBy("g").agg(F.count("*").alias("n"))


def simple_intersection(spark, sf_dir):
    return intersect_patterns(nation_quads(spark, sf_dir), [(None, f"<{EX}region>", None), (None, None, f"<{EX}region/2>")])


def simple_sparql(spark, sf_dir):
    return simple_query(nation_quads(spark, sf_dir), PREFIXES + "SELECT * WHERE { GRAPH ?g { ?s ex:region ?o } }")


def trig_round_trip(spark, sf_dir):
    """Nations written as TriG by Spark and parsed again, a document for each graph."""
    docs = nation_quads(spark, sf_dir).where(F.col("p") == f"<{EX}name>").groupBy("g").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "s", "p", "o"))), " .\n").alias("body"))
    docs = docs.select(F.concat(F.col("g"), F.lit(" {\n"), F.col("body"), F.lit(" .\n}")).alias("text"))

    def parse(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([q for t in b["text"] for q in parse_trig(t)], columns=["s", "p", "o", "g"])

    return docs.mapInPandas(parse, "s string, p string, o string, g string")


def term_codec(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = T.make_literal(F.col("props"), "http://www.w3.org/2001/XMLSchema#string")
    return df.select("event_id", t.alias("term"), T.lexical(t).alias("lex"), T.kind(t).alias("kind"))


N, R = "'<http://example.org/nation/' || n_nationkey || '>'", "'<http://example.org/region/' || n_regionkey || '>'"
OTHERS: dict[str, tuple[Callable, str]] = {
    "store_scan": (store_scan, "SELECT '<http://example.org/g/' || t || '>' AS g, p, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{p}' AS p, COUNT(*) AS n FROM {t}" for t, ps in {"nation": ("name", "region", "type"), "region": ("name", "type")}.items() for p in (f"<{EX}{x}>" if x != "type" else "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>" for x in ps)) + ")"),
    "store_filter": (store_filter, f"SELECT {N} AS s, {R} AS o FROM nation WHERE n_regionkey = 1"),
    "store_delete": (store_delete, f"SELECT {N} AS s, {R} AS o FROM nation WHERE n_regionkey <> 1"),
    "store_graphs": (store_graphs, "SELECT '<http://example.org/g/nation>' AS g UNION ALL SELECT '<http://example.org/g/region>'"),
    "update_modify": (update_modify, f"SELECT {R} AS s, '<http://example.org/holds>' AS p, {N} AS o FROM nation"),
    "update_drop": (update_drop, "SELECT '<http://example.org/g/region>' AS g, 2 * COUNT(*) AS n FROM region UNION ALL SELECT '<urn:x-default:default-graph>', 1"),
    "path_ring": (path_ring, "SELECT '<http://example.org/nation/' || a.n_nationkey || '>' AS x, '<http://example.org/nation/' || b.n_nationkey || '>' AS y FROM nation a CROSS JOIN nation b"),
    "delete_duplicates": (delete_duplicates, f"SELECT '<{EX}region>' AS p, 2 * COUNT(*) AS n FROM nation UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', 2 * ((SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM region))"),
    "update_delete_data": (update_delete_data, f"SELECT {N} AS s, {R} AS o FROM nation WHERE NOT (n_nationkey = 1 AND n_regionkey = 1)"),
    "update_clear_default": (update_clear_default, f"SELECT '<{EX}g/' || t || '>' AS g, n FROM (SELECT 'nation' AS t, 3 * COUNT(*) AS n FROM nation UNION ALL SELECT 'region', 2 * COUNT(*) FROM region)"),
    "simple_intersection": (simple_intersection, f"SELECT {N} AS s, {R} AS o FROM nation WHERE n_regionkey = 2"),
    "simple_sparql": (simple_sparql, f"SELECT {N} AS s, {R} AS o, '<http://example.org/g/nation>' AS g FROM nation"),
    "trig_round_trip": (trig_round_trip, f"SELECT {N} AS s, '<http://example.org/name>' AS p, '\"' || n_name || '\"' AS o, '<http://example.org/g/nation>' AS g FROM nation UNION ALL SELECT '<http://example.org/region/' || r_regionkey || '>', '<http://example.org/name>', '\"' || r_name || '\"', '<http://example.org/g/region>' FROM region"),
    "term_codec": (term_codec, "SELECT event_id, '\"' || replace(replace(props, '\\', '\\\\'), '\"', '\\\"') || '\"' AS term, props AS lex, 'L' AS kind FROM events"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sparql(t, q) for n, (t, q, _) in SPARQL.items()} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, _, s) in SPARQL.items()} | {n: s for n, (_, s) in OTHERS.items()}

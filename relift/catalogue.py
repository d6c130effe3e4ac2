"""Registered queries: round trips through a graph and single operators, with the SQL of their results.

A round trip maps tables to quads and reconstructs them; the plan goes from the tables to the rows
without writing the graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import reconstruct_tables
from .functions.text import encode_for_uri, strafter, strbefore
from .operators.compare import same_rows
from .operators.forward import graph_of, statements_of
from .plans.analysis import analyse
from .plans.mapping import parse_mapping
from .plans.rules import Mapping
from .sources.rdf import Graph, lines_of, parse_lines
from .sources.tables import Catalog, base_tables

HEAD = "@prefix rr: <http://www.w3.org/ns/r2rml#> .\n@prefix rml: <http://w3id.org/rml/> .\n@prefix ex: <http://example.com/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


def triples_map(name: str, table: str, subject: str, *statements: str, query: bool = False, graph: str = "") -> str:
    """R2RML for one triples map; statements are 'predicate object-map' pairs in Turtle."""
    source = f'rr:sqlQuery """{table}"""' if query else f'rr:tableName "{table}"'
    poms = "".join(f" ;\n  rr:predicateObjectMap [ {s} ]" for s in statements)
    return f"<#{name}> rr:logicalTable [ {source} ] ;\n  rr:subjectMap [ {subject}{' ; ' + graph if graph else ''} ]{poms} .\n"


def column(predicate: str, name: str, more: str = "") -> str:
    return f'rr:predicate ex:{predicate} ; rr:objectMap [ rr:column "{name}"{more} ]'


def template(predicate: str, text: str, more: str = "") -> str:
    return f'rr:predicate ex:{predicate} ; rr:objectMap [ rr:template "{text}"{more} ]'


def subject(text: str, more: str = "") -> str:
    return f'rr:template "{text}"{more}'


def read(spark: SparkSession, sf_dir: str, mapping: Mapping, *more: str) -> Catalog:
    names = {s for s in mapping.sources if s not in mapping.queries} | {t for q in mapping.queries.values() for t in base_tables(spark, q.sql)} | set(more)
    return Catalog.folder(spark, sf_dir, *sorted(names))


def round_trip(text: str, source: str, typed: bool = True, observe: bool = False, via_text: bool = False, **options) -> Callable[[SparkSession, str], DataFrame]:
    """The query that maps and reconstructs one logical table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mapping = parse_mapping(HEAD + text)
        catalog = read(spark, sf_dir, mapping)
        tables = catalog.with_queries(mapping.queries)
        quads = graph_of(mapping, tables)
        if via_text:
            quads = parse_lines(lines_of(quads))
        return reconstruct_tables(spark, mapping, Graph(quads), catalog if typed else None, observe=observe, **options)[source]

    return run


#: Name -> (query, SQL).
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    FOUND[name] = (run, sql)


SUPPLIER = triples_map("S", "supplier", subject("http://example.com/supplier/{s_suppkey}"), column("name", "s_name"), column("nation", "s_nationkey"), column("balance", "s_acctbal"))
SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
register("invert_subject_template", round_trip(SUPPLIER, "supplier"), SUPPLIER_SQL)
register("invert_through_text", round_trip(SUPPLIER, "supplier", via_text=True), SUPPLIER_SQL)
register("invert_optional_objects", round_trip(SUPPLIER, "supplier", optional_objects=True), SUPPLIER_SQL)
register(
    "invert_composite_template",
    round_trip(triples_map("C", "conversations", subject("http://example.com/{conv_id}/turn/{turn}"), column("role", "role")), "conversations", observe=True),
    "SELECT conv_id, turn, role FROM conversations",
)
register(
    "invert_template_only_decode",
    round_trip(triples_map("P", "part", subject("http://example.com/part/{p_partkey}/{p_name}"), "rr:predicate ex:is ; rr:object ex:Part"), "part"),
    "SELECT p_partkey, p_name FROM part",
)
register(
    "invert_template_object_iri",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), template("by", "http://example.com/customer/{o_custkey}")), "orders"),
    "SELECT o_orderkey, o_custkey FROM orders",
)
register(
    "invert_template_object_literal",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), template("by", "customer {o_custkey}: {o_orderpriority}", " ; rr:termType rr:Literal")), "orders"),
    "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
)
register(
    "invert_constant_object_filter",
    round_trip(triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}", " ; rr:class ex:Customer"), "rr:predicate ex:kind ; rr:object \"buyer\"", column("name", "c_name")), "customer"),
    "SELECT c_custkey, c_name FROM customer",
)
register(
    "invert_typed_constant",
    round_trip(triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}"), "rr:predicate ex:year ; rr:object 1998", 'rr:predicate ex:note ; rr:object "client"@fr', column("name", "c_name")), "customer"),
    "SELECT c_custkey, c_name FROM customer",
)
register(
    "invert_predicate_template",
    round_trip(triples_map("E", "events", subject("http://example.com/event/{event_id}"), 'rr:predicateMap [ rr:template "http://example.com/was/{event_type}" ] ; rr:objectMap [ rr:column "value" ]'), "events"),
    "SELECT event_id, event_type, value FROM events",
)
ORDERS_SQL = "SELECT o_orderkey, o_orderstatus FROM orders"
for _name, _graph in (("constant", "rr:graph ex:orders"), ("template", 'rr:graphMap [ rr:template "http://example.com/graph/{o_orderstatus}" ]'), ("default", "rr:graph rr:defaultGraph")):
    register(f"invert_{_name}_graph", round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), column("status", "o_orderstatus"), graph=_graph), "orders"), ORDERS_SQL)
register(
    "invert_hidden_graph",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), 'rr:predicate ex:is ; rr:object ex:Order ; rr:graphMap [ rr:template "http://example.com/status/{o_orderstatus}" ]'), "orders"),
    ORDERS_SQL,
)
register(
    "invert_reference_graph",
    round_trip(triples_map("P", "SELECT page_id, url FROM pages", subject("http://example.com/page/{page_id}"), 'rr:predicate ex:is ; rr:object ex:Page ; rr:graphMap [ rr:column "url" ]', query=True), "query_1"),
    "SELECT page_id, url FROM pages",
)
register(
    "invert_two_graph_maps",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), 'rr:predicate ex:a ; rr:object ex:A ; rr:graphMap [ rr:template "http://example.com/status/{o_orderstatus}" ]', 'rr:predicate ex:b ; rr:object ex:B ; rr:graphMap [ rr:template "http://example.com/priority/{o_orderpriority}" ]'), "orders"),
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
NATION = triples_map("N", "nation", subject("http://example.com/nation/{n_nationkey}"), column("name", "n_name"))
JOIN = 'rr:predicate ex:{p} ; rr:objectMap [ rr:parentTriplesMap <#{m}> ; rr:joinCondition [ rr:child "{c}" ; rr:parent "{k}" ] ]'
register(
    "invert_fk_join",
    round_trip(triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}"), column("name", "c_name"), JOIN.format(p="nation", m="N", c="c_nationkey", k="n_nationkey")) + NATION, "customer"),
    "SELECT c_custkey, c_name, c_nationkey FROM customer",
)
NULLED = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey AS STRING) END AS o_custkey FROM orders"
register(
    "invert_fk_join_null",
    round_trip(triples_map("O", NULLED, subject("http://example.com/order/{o_orderkey}"), column("status", "o_orderstatus"), JOIN.format(p="by", m="C", c="o_custkey", k="c_custkey"), query=True) + triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}"), column("name", "c_name")), "query_1"),
    NULLED.replace("STRING", "VARCHAR"),
)
register(
    "invert_fk_self_join",
    round_trip(triples_map("A", "nation", subject("http://example.com/nation/{n_nationkey}"), column("name", "n_name"), JOIN.format(p="same", m="A", c="n_nationkey", k="n_nationkey")), "nation"),
    "SELECT n_nationkey, n_name FROM nation",
)
register(
    "invert_parent_without_condition",
    round_trip(triples_map("A", "nation", subject("http://example.com/nation/{n_nationkey}"), column("name", "n_name"), "rr:predicate ex:in ; rr:objectMap [ rr:parentTriplesMap <#B> ]") + triples_map("B", "nation", subject("http://example.com/region/{n_regionkey}"), "rr:predicate ex:is ; rr:object ex:Region"), "nation"),
    "SELECT n_nationkey, n_name, n_regionkey FROM nation",
)
register(
    "invert_referenced_subject",
    round_trip(triples_map("N", "nation", subject("http://example.com/nation/{n_nationkey}"), column("name", "n_name"), JOIN.format(p="in", m="R", c="n_regionkey", k="r_regionkey")) + triples_map("R", "region", subject("http://example.com/region/{r_regionkey}")), "region"),
    "SELECT n_regionkey AS r_regionkey FROM nation",
)
register(
    "invert_bnode_template",
    round_trip(triples_map("N", "nation", subject("nation{n_nationkey}", " ; rr:termType rr:BlankNode"), column("name", "n_name")), "nation"),
    "SELECT n_nationkey, n_name FROM nation",
)
register(
    "invert_bnode_reference",
    round_trip(triples_map("N", "nation", 'rr:column "n_nationkey" ; rr:termType rr:BlankNode', column("name", "n_name")), "nation"),
    "SELECT n_nationkey, n_name FROM nation",
)
register(
    "invert_language",
    round_trip(triples_map("D", "SELECT doc_id, source FROM documents WHERE lang = 'en'", subject("http://example.com/doc/{doc_id}"), column("from", "source", ' ; rr:language "en"'), 'rr:predicate ex:from ; rr:object "nowhere"@fr', query=True), "query_1"),
    "SELECT doc_id, source FROM documents WHERE lang = 'en'",
)
COUNTED = "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey"
register("invert_logical_query", round_trip(triples_map("O", COUNTED, subject("http://example.com/customer/{o_custkey}"), column("orders", "n"), query=True), "query_1"), COUNTED)
register(
    "invert_delimited_query",
    round_trip(triples_map("O", 'SELECT \\"c_custkey\\" AS \\"Key\\", \\"c_name\\" AS \\"Name\\" FROM customer', subject('http://example.com/customer/{\\"Key\\"}'), column("name", '\\"Name\\"'), query=True), "query_1"),
    'SELECT c_custkey AS "Key", c_name AS "Name" FROM customer',
)
register(
    "invert_multivalue_cross",
    round_trip(triples_map("P", "part", subject("http://example.com/brand/{p_brand}"), column("type", "p_type"), column("size", "p_size")), "part"),
    "SELECT a.p_brand, a.p_type, b.p_size FROM (SELECT DISTINCT p_brand, p_type FROM part) a JOIN (SELECT DISTINCT p_brand, p_size FROM part) b USING (p_brand)",
)
register(
    "invert_multiplicity_lost",
    round_trip(triples_map("O", "orders", subject("http://example.com/customer/{o_custkey}"), column("status", "o_orderstatus")), "orders"),
    "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
)
SOME_NULL = "SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END AS o_orderkey, o_orderpriority FROM orders"
register(
    "invert_rows_lost",
    round_trip(triples_map("O", SOME_NULL, subject("http://example.com/order/{o_orderkey}"), column("priority", "o_orderpriority"), query=True), "query_1"),
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'",
)
register(
    "invert_columns_lost_object",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), column("is", "o_orderstatus"), column("is", "o_orderpriority"), column("total", "o_totalprice")), "orders"),
    "SELECT DISTINCT o_orderkey, o_totalprice FROM orders",
)
register(
    "invert_columns_lost_subject",
    round_trip(triples_map("A", "nation", subject("http://example.com/{n_nationkey}"), column("name", "n_name")) + triples_map("B", "nation", subject("http://example.com/{n_regionkey}"), column("name", "n_name")), "nation"),
    "SELECT DISTINCT n_name FROM nation",
)
register(
    "invert_columns_lost_predicate",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), *(f'rr:predicateMap [ rr:template "http://example.com/is/{{{c}}}" ] ; rr:objectMap [ rr:column "o_totalprice" ]' for c in ("o_orderstatus", "o_orderpriority"))), "orders"),
    "SELECT DISTINCT o_orderkey, o_totalprice FROM orders",
)
register(
    "invert_columns_lost_graph",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), *(f'rr:predicate ex:total ; rr:objectMap [ rr:column "o_totalprice" ] ; rr:graphMap [ rr:template "http://example.com/g/{{{c}}}" ]' for c in ("o_orderstatus", "o_orderpriority"))), "orders"),
    "SELECT DISTINCT o_orderkey, o_totalprice FROM orders",
)
register(
    "invert_adjacent_template",
    round_trip(triples_map("C", "customer", subject("http://example.com/{c_custkey}{c_nationkey}"), column("key", "c_custkey")), "customer"),
    "SELECT DISTINCT c_custkey FROM customer",
)
SPLIT = "SELECT p_partkey, p_name, CASE WHEN p_partkey = 1 THEN 'a b' ELSE 'c' END AS tail FROM part"
register(
    "invert_observed_ambiguity",
    round_trip(triples_map("P", SPLIT, subject("http://example.com/part/{p_partkey}"), template("label", "{p_name} {tail}", " ; rr:termType rr:Literal"), column("tail", "tail"), query=True), "query_1", observe=True),
    "SELECT DISTINCT p_partkey, CASE WHEN p_partkey = 1 THEN 'a b' ELSE 'c' END AS tail FROM part",
)
register(
    "invert_cross_table_evidence",
    round_trip(
        triples_map("A", "SELECT n_nationkey, n_name FROM nation", subject("http://example.com/{n_nationkey}{n_name}"), template("unsafe", "{n_nationkey}{n_name}", " ; rr:termType rr:Literal"), query=True)
        + triples_map("B", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 1", subject("http://example.com/{n_nationkey}{n_name}"), template("safe", "{n_nationkey} {n_name}", " ; rr:termType rr:Literal"), query=True),
        "query_1",
    ),
    "SELECT n_nationkey, n_name FROM nation",
)
register(
    "invert_untyped",
    round_trip(triples_map("L", "customer", subject("http://example.com/customer/{c_custkey}"), column("name", "c_name"), column("nation", "c_nationkey"), column("balance", "c_acctbal")), "customer", typed=False),
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer",
)
register(
    "invert_timestamps",
    round_trip(triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), column("date", "o_orderdate")), "orders"),
    "SELECT o_orderkey, o_orderdate FROM orders",
)
NUMBERED = "SELECT l_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS line, l_quantity FROM lineitem"
register(
    "invert_window_query",
    round_trip(triples_map("L", NUMBERED, subject("http://example.com/line/{l_orderkey}/{line}"), column("quantity", "l_quantity"), query=True), "query_1"),
    NUMBERED,
)
RML_ORDERS = 'rml:logicalSource [ rml:iterator "orders" ; rml:referenceFormulation rml:SQL2008Table ]'
register(
    "invert_rml_vocabulary",
    round_trip(f'<#O> {RML_ORDERS} ; rml:subjectMap [ rml:template "http://example.com/order/{{o_orderkey}}" ] ; rml:predicateObjectMap [ rml:predicate ex:status ; rml:objectMap [ rml:reference "o_orderstatus" ] ] .', "orders"),
    ORDERS_SQL,
)


def _quads(spark: SparkSession, sf_dir: str, once: bool) -> DataFrame:
    """All statements; a double is compared as a number, as its text may be written in several ways."""
    mapping = parse_mapping(HEAD + SUPPLIER + NATION)
    tables = read(spark, sf_dir, mapping)
    quads = (statements_of if once else graph_of)(mapping, tables)
    double = F.col("o.dt") == _XSD + "double"
    return quads.select("s", "p", F.when(~double, F.col("o.value")).alias("o"), F.when(double, F.col("o.value").cast("double")).alias("number"), F.col("o.dt").alias("dt"), "g")


_XSD = "http://www.w3.org/2001/XMLSchema#"
QUADS_SQL = " UNION ALL ".join(
    f"SELECT 'http://example.com/{s}/' || {k} AS s, 'http://example.com/{p}' AS p, CAST({v} AS VARCHAR) AS o, CAST({n} AS DOUBLE) AS number, '{_XSD}{dt}' AS dt, '' AS g FROM {t}"
    for s, k, p, v, n, dt, t in (
        ("supplier", "s_suppkey", "name", "s_name", "NULL", "string", "supplier"),
        ("supplier", "s_suppkey", "nation", "s_nationkey", "NULL", "integer", "supplier"),
        ("supplier", "s_suppkey", "balance", "NULL", "s_acctbal", "double", "supplier"),
        ("nation", "n_nationkey", "name", "n_name", "NULL", "string", "nation"),
    )
)
register("forward_union", lambda spark, sf_dir: _quads(spark, sf_dir, once=False), QUADS_SQL)
register("forward_single_scan", lambda spark, sf_dir: _quads(spark, sf_dir, once=True), QUADS_SQL)


def _default_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = triples_map("O", "orders", subject("http://example.com/customer/{o_custkey}"), column("status", "o_orderstatus"), graph='rr:graphMap [ rr:template "http://example.com/graph/{o_orderpriority}" ]')
    mapping = parse_mapping(HEAD + text)
    return Graph(graph_of(mapping, read(spark, sf_dir, mapping))).union().select("s", "p", F.col("o.value").alias("o"), "g")


register(
    "default_graph_union",
    _default_union,
    "SELECT DISTINCT 'http://example.com/customer/' || o_custkey AS s, 'http://example.com/status' AS p, o_orderstatus AS o, '' AS g FROM orders"
    " UNION ALL SELECT DISTINCT 'http://example.com/customer/' || o_custkey, 'http://example.com/status', o_orderstatus, 'http://example.com/graph/' || replace(url_encode(o_orderpriority), '+', '%20') FROM orders",
)


def _report(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = triples_map("O", "orders", subject("http://example.com/order/{o_orderkey}"), column("is", "o_orderstatus"), column("is", "o_orderpriority")) + triples_map("C", "customer", subject("http://example.com/{c_custkey}{c_nationkey}"), column("key", "c_custkey"))
    found = analyse(parse_mapping(HEAD + text))
    return _report(spark, [(t, c, c in a.recoverable) for t, a in found.items() for c in sorted(a.references)], "source string, reference string, recoverable boolean")


register(
    "analysis_report",
    _analysis,
    "SELECT * FROM (VALUES ('orders', 'o_orderkey', true), ('orders', 'o_orderstatus', false), ('orders', 'o_orderpriority', false), ('customer', 'c_custkey', true), ('customer', 'c_nationkey', false)) t(source, reference, recoverable)",
)


def _multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus")
    rows = [("itself", same_rows(orders, orders.select("o_orderstatus", "o_custkey"))), ("distinct", same_rows(orders, orders.distinct()))]
    return _report(spark, rows, "other string, identical boolean")


register("compare_multisets", _multisets, "SELECT * FROM (VALUES ('itself', true), ('distinct', false)) t(other, identical)")


def _functions(expression: Callable, name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", expression(F.col("p_name")).alias(name))


_CUT = "CASE WHEN contains(p_name, ' ') THEN {} ELSE '' END"
register("fn_strafter", _functions(lambda c: strafter(c, " "), "tail"), f"SELECT p_partkey, {_CUT.format('substr(p_name, strpos(p_name, chr(32)) + 1)')} AS tail FROM part")
register("fn_strbefore", _functions(lambda c: strbefore(c, " "), "head"), f"SELECT p_partkey, {_CUT.format('substr(p_name, 1, strpos(p_name, chr(32)) - 1)')} AS head FROM part")
register("fn_encode_for_uri", _functions(encode_for_uri, "encoded"), "SELECT p_partkey, url_encode(p_name) AS encoded FROM part")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql is not None}


from . import reports as _reports  # noqa: E402, F401  (registers more)

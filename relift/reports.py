"""Registered queries for what is not a plain round trip: files, sinks, refusals, analysis, comparison, outcomes.

Reports return one row a case; each case runs the operator on the tables, or on a mapping that has to be
refused, and SQL states the answer.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import analyze_mapping, reconstruct, reconstruct_tables
from .catalogue import HEAD, JOIN, NATION, ORDERS_SQL, SUPPLIER, SUPPLIER_SQL, column, read, register, round_trip, subject, template, triples_map
from .errors import MappingError, NoDataError, NonInvertibleError, ReliftError, UnsupportedMappingError
from .functions.terms import QUAD, cast_to
from .functions.text import encode_for_uri, percent_decode, same_value
from .operators.compare import Outcome, classify, compare_databases, logical_content, same_graph
from .operators.forward import graph_of
from .operators.inversion import Inversion, Pattern
from .operators.typing import by_schema
from .plans.analysis import analyse, distinct_groups, require_recoverable
from .plans.mapping import parse_mapping
from .plans.rules import BNODE, CONSTANT, IRI, PARENT, Mapping, Rule, TermMap
from .sources.rdf import Graph, format_of, parse_lines, write_quads
from .sources.sink import ParquetSink, TableSink, sink_for
from .sources.store import new_path
from .sources.tables import Catalog, check_references, content, drop_tables, jdbc_options, run_script

ORDER = "http://example.com/order/{o_orderkey}"


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, or in a local one where the session has none."""
    return new_path(spark, what) or f"{tempfile.mkdtemp(prefix='relift-')}/{what}"


def values(*rows: tuple, names: str) -> str:
    """SQL of literal rows."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


# -- round trips ----------------------------------------------------------------------------

register(
    "invert_two_subject_maps",
    round_trip(triples_map("A", "orders", subject("http://example.com/a/{o_orderkey}"), column("status", "o_orderstatus")) + triples_map("B", "orders", subject("http://example.com/b/{o_orderkey}"), column("priority", "o_orderpriority")), "orders"),
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
register(
    "invert_three_subject_maps",
    round_trip("".join(triples_map(n, "part", subject(f"http://example.com/{n}/{{p_partkey}}/{{p_name}}"), column(n, c)) for n, c in (("A", "p_brand"), ("B", "p_type"), ("C", "p_size"))), "part"),
    "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part",
)
register(
    "invert_reused_column",
    round_trip(triples_map("O", "orders", subject(ORDER), column("status", "o_orderstatus"), column("state", "o_orderstatus")), "orders"),
    ORDERS_SQL,
)
register(
    "invert_iri_reference_subject",
    round_trip(triples_map("P", "SELECT page_id, url FROM pages", 'rr:column "url"', column("id", "page_id"), query=True), "query_1"),
    "SELECT DISTINCT page_id FROM pages WHERE url IS NOT NULL",
)
register(
    "invert_reference_parent",
    round_trip(triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}"), column("name", "c_name"), JOIN.format(p="nation", m="N", c="c_nationkey", k="n_nationkey")) + triples_map("N", "nation", 'rr:column "n_name"', column("key", "n_nationkey")), "customer"),
    "SELECT DISTINCT c_custkey, c_name FROM customer",
)
register(
    "invert_join_in_graph",
    round_trip(triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}"), column("name", "c_name"), JOIN.format(p="nation", m="N", c="c_nationkey", k="n_nationkey"), graph="rr:graph ex:g") + NATION, "customer"),
    "SELECT c_custkey, c_name, c_nationkey FROM customer",
)
register(
    "invert_opaque_join",
    round_trip(triples_map("C", "customer", subject("http://example.com/customer/{c_custkey}"), column("name", "c_name"), JOIN.format(p="nation", m="N", c="c_nationkey", k="n_nationkey")) + triples_map("N", "nation", subject("http://example.com/nation/{n_name}"), column("key", "n_nationkey")), "customer"),
    "SELECT DISTINCT c_custkey, c_name FROM customer",
)
register(
    "invert_redundant_groups",
    round_trip("".join(triples_map(n, "orders", subject(f"http://example.com/{n}/{{o_orderkey}}"), column("key", "o_orderkey"), column("status", "o_orderstatus")) for n in "AB"), "orders"),
    ORDERS_SQL,
)
LOOSE = triples_map("S", "supplier", subject("http://example.com/supplier.{s_suppkey}"), column("name", "s_name")) + triples_map("N", "nation", subject("http://example.com/supplier-{n_nationkey}"), column("name", "n_name"))
register("invert_loose_templates", round_trip(LOOSE, "supplier", typed=False, strict=False), "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier UNION ALL SELECT '', n_name FROM nation")
register("invert_strict_templates", round_trip(LOOSE, "supplier", typed=False), "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")


# -- files and sinks ------------------------------------------------------------------------


def _through_file(ending: str, text: str, source: str) -> Callable[[SparkSession, str], DataFrame]:
    """The graph written to a file of that ending, opened again, and inverted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mapping = parse_mapping(HEAD + text)
        catalog = read(spark, sf_dir, mapping)
        at = place(spark, "graph") + ending
        write_quads(graph_of(mapping, catalog.with_queries(mapping.queries)), at)
        return reconstruct_tables(spark, mapping, at, catalog)[source]

    return run


register("read_nquads_file", _through_file(".nq", SUPPLIER, "supplier"), SUPPLIER_SQL)
register("read_parquet_graph", _through_file(".parquet", SUPPLIER, "supplier"), SUPPLIER_SQL)
register(
    "read_named_graphs_file",
    _through_file(".nq", triples_map("O", "orders", subject(ORDER), 'rr:predicate ex:is ; rr:object ex:Order ; rr:graphMap [ rr:template "http://example.com/status/{o_orderstatus}" ]'), "orders"),
    ORDERS_SQL,
)
register(
    "read_bnode_file",
    _through_file(".nt", triples_map("N", "nation", subject("nation{n_nationkey}", " ; rr:termType rr:BlankNode"), column("name", "n_name")), "nation"),
    "SELECT n_nationkey, n_name FROM nation",
)


def _kept_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that stays in memory while it is open gives the same answers twice."""
    mapping = parse_mapping(HEAD + SUPPLIER)
    catalog = read(spark, sf_dir, mapping)
    with Graph(graph_of(mapping, catalog), keep=True) as graph:
        rows = [("first", graph.default.count()), ("second", graph.default.count())]
    return spark.createDataFrame(rows, "read string, n long")


register("graph_lifecycle", _kept_graph, "SELECT read, (SELECT 3 * COUNT(*) FROM supplier) AS n FROM (VALUES ('first'), ('second')) t(read)")


def _sink(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Two reconstructions appended to one destination, then a table with a changed schema, then one without rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mapping = parse_mapping(HEAD + SUPPLIER)
        catalog = read(spark, sf_dir, mapping)
        graph = Graph(graph_of(mapping, catalog))
        at = place(spark, "sink")
        spark.sql("CREATE DATABASE IF NOT EXISTS relift_sinks")
        sink = ParquetSink(at) if kind == "parquet" else TableSink(spark, "relift_sinks")
        name = "supplier" if kind == "parquet" else "s" + at.rpartition("-")[2]
        if kind == "parquet":
            reconstruct(spark, mapping, graph, sink, catalog)
        else:
            sink.write(reconstruct_tables(spark, mapping, graph, catalog)["supplier"], name)
        more = reconstruct_tables(spark, mapping, graph, catalog)["supplier"].withColumn("s_rank", F.lit(1).cast("long"))
        sink.write(more, name)
        sink.write(more.drop("s_name").where("false"), name)
        return spark.read.parquet(f"{at}/{name}") if kind == "parquet" else spark.table(f"relift_sinks.{name}")

    return run


SINK_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, r AS s_rank FROM supplier CROSS JOIN (VALUES (CAST(NULL AS BIGINT)), (1)) t(r)"
register("sink_parquet_evolution", _sink("parquet"), SINK_SQL)
register("sink_catalog_evolution", _sink("catalog"), SINK_SQL)


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for at in ("catalog", "catalog:db", "/data/out", "postgresql://u:p%40@h:5/d", "jdbc:mysql://h/d"):
        sink = sink_for(spark, at)
        rows.append((at, type(sink).__name__, (getattr(sink, "options", None) or {}).get("url")))
    rows += [("options of " + url, jdbc_options(url).get("user"), jdbc_options(url).get("password")) for url in ("postgresql+psycopg2://u:p%40@h:5/d", "mysql://h/d")]
    return spark.createDataFrame(rows, "destination string, kind string, url string")


register(
    "sink_destinations",
    _sinks,
    values(("catalog", "TableSink", None), ("catalog:db", "TableSink", None), ("/data/out", "ParquetSink", None), ("postgresql://u:p%40@h:5/d", "JdbcSink", "jdbc:postgresql://h:5/d"), ("jdbc:mysql://h/d", "JdbcSink", "jdbc:mysql://h/d"), ("options of postgresql+psycopg2://u:p%40@h:5/d", "u", "p@"), ("options of mysql://h/d", None, None), names="destination, kind, url"),
)


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a script, read as their lexical values: CHAR padded, binary in hexadecimal; then dropped."""
    name = "relift_" + place(spark, "script").rpartition("-")[2]
    nation = f"{sf_dir}/nation.parquet"
    run_script(spark, f"CREATE TABLE {name} (n_nationkey BIGINT, code CHAR(30), raw BINARY) USING parquet; INSERT INTO {name} SELECT n_nationkey, n_name, CAST(n_name || ';' AS BINARY) FROM parquet.`{nation}`")
    rows = content(spark.table(name)).collect()
    drop_tables(spark, name)
    return spark.createDataFrame([(*r, spark.catalog.tableExists(name)) for r in rows], "n_nationkey long, code string, raw string, still_there boolean")


register("script_char_binary", _scripts, "SELECT n_nationkey, rpad(n_name, 30, ' ') AS code, upper(hex(encode(n_name || ';'))) AS raw, false AS still_there FROM nation")


def _conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of terms cast to a source's types: NaN and empty cells become what the type has for them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    texts = part.select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("p_size"), F.when(F.col("p_size") % 2 == 0, "T").otherwise("no").alias("even"))
    return by_schema(texts, spark.createDataFrame([], "p_partkey long, p_size int, even boolean").schema)


register("insert_conversion", _conversion, "SELECT p_partkey, CAST(p_size AS INTEGER) AS p_size, p_size % 2 = 0 AS even FROM part")


# -- refusals -------------------------------------------------------------------------------


def _class(error: Exception) -> str:
    return "malformed" if "malformed RDF" in str(error) else type(error).__name__


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case with the class of the error that it raises."""
    region = Catalog.folder(spark, sf_dir, "region")
    graph = Graph(spark.createDataFrame([], QUAD))
    plain = triples_map("A", "region", subject("http://example.com/{r_regionkey}"), column("name", "r_name"))

    def parsing(text: str) -> Callable[[], object]:
        return lambda: parse_mapping(HEAD + text)

    def solving(*rules: Rule) -> Callable[[], object]:
        return lambda: Inversion(Mapping(list(rules)), "region", graph).solve()

    def lines(text: str) -> Callable[[], object]:
        return lambda: parse_lines(spark.createDataFrame([(text,)], "value string")).collect()

    name, key = TermMap("reference", "r_name", "literal"), TermMap("template", "http://example.com/{r_regionkey}")
    p = TermMap(CONSTANT, "http://example.com/p")
    raw = '<#A> rml:logicalSource [ rml:{} "x" ; rml:referenceFormulation rml:{} ] ; rml:subjectMap [ rml:template "http://example.com/{{a}}" ; rml:class ex:A ] .'
    cases: dict[str, Callable[[], object]] = {
        "literal subject": parsing(triples_map("A", "region", 'rr:column "r_name" ; rr:termType rr:Literal', column("name", "r_name"))),
        "formulation": parsing(raw.format("iterator", "JSONPath")),
        "leftover source": parsing(raw.format("source", "SQL2008Table")),
        "two subject maps": parsing(plain.replace(" .\n", " ; rr:subjectMap [ rr:template \"http://example.com/b/{r_name}\" ] .\n")),
        "no statements": parsing(triples_map("A", "region", subject("http://example.com/{r_regionkey}"))),
        "constants only": parsing(triples_map("A", "region", "rr:constant ex:a", "rr:predicate ex:p ; rr:object ex:o")),
        "no table": lambda: reconstruct_tables(spark, Mapping([]), graph),
        "missing column": lambda: check_references(parse_mapping(HEAD + plain.replace("r_name", "nothing")), region),
        "missing table": lambda: check_references(parse_mapping(HEAD + plain.replace('"region"', '"nothing"')), region),
        "unknown parent": parsing(triples_map("A", "region", subject("http://example.com/{r_regionkey}"), JOIN.format(p="p", m="None", c="r_name", k="r_name"))),
        "connection without driver": lambda: reconstruct_tables(spark, Mapping(parse_mapping(HEAD + plain).rules, connection={"url": "jdbc:postgresql://h/d"}), graph),
        "blank node as object": solving(Rule("region", "#A", key, p, TermMap(CONSTANT, "x", BNODE))),
        "constant subject": solving(Rule("region", "#A", TermMap(CONSTANT, "http://example.com/a", IRI), p, name)),
        "join as predicate": lambda: Rule("region", "#A", key, TermMap(PARENT, "#B"), name),
        "nothing recoverable": lambda: require_recoverable(analyse(Mapping([Rule("region", "#A", key, None, None)]))),
        "malformed line": lines("<a:s> <a:p> ."),
        "unknown escape": lines('<a:s> <a:p> "\\q" .'),
        "unknown format": lambda: format_of("graph.rdfdata"),
        "extra columns": lambda: ParquetSink(_some_table(spark)).write(spark.createDataFrame([(1,)], "a int"), "t"),
        "none": parsing(plain),
    }
    rows = []
    for case, run in cases.items():
        try:
            run()
            rows.append((case, "none", False))
        except Exception as error:
            rows.append((case, _class(error), isinstance(error, ReliftError)))
    return spark.createDataFrame(rows, "refused string, error string, own boolean")


def _some_table(spark: SparkSession) -> str:
    at = place(spark, "table")
    ParquetSink(at).write(spark.createDataFrame([(1, "x")], "a int, b string"), "t")
    return at


_REFUSED = {MappingError: ("literal subject", "two subject maps", "missing column", "missing table", "unknown parent", "connection without driver", "extra columns"), UnsupportedMappingError: ("formulation", "leftover source", "blank node as object", "constant subject", "join as predicate"), NonInvertibleError: ("no statements", "constants only", "nothing recoverable"), NoDataError: ("no table",)}
register(
    "refusals",
    _refusals,
    values(*((case, kind.__name__, True) for kind, cases in _REFUSED.items() for case in cases), ("malformed line", "malformed", False), ("unknown escape", "malformed", False), ("unknown format", "ValueError", False), ("none", "none", False), names="refused, error, own"),
)


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, format_of(p)) for p in ("a.nt", "b/c.NQ.gz", "d.nquads", "e.parquet/", "f.ntriples.bz2")], "path string, kind string")


register("rdf_formats", _formats, values(("a.nt", "text"), ("b/c.NQ.gz", "text"), ("d.nquads", "text"), ("e.parquet/", "parquet"), ("f.ntriples.bz2", "text"), names="path, kind"))


# -- analysis, comparison, outcomes ---------------------------------------------------------


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of three tables their graph preserves, by the mapping and by the terms observed."""
    text = (
        triples_map("C", "customer", subject("http://example.com/{c_custkey}"), template("label", "{c_name} {c_mktsegment}", " ; rr:termType rr:Literal"))
        + triples_map("P", "part", subject("http://example.com/part/{p_partkey}"), template("label", "{p_name} {p_size}", " ; rr:termType rr:Literal"))
        + triples_map("O", "orders", subject(ORDER), column("is", "o_orderstatus"), column("is", "o_orderpriority"))
    )
    mapping = parse_mapping(HEAD + text)
    catalog = read(spark, sf_dir, mapping)
    found = analyze_mapping(spark, mapping, graph_of(mapping, catalog), catalog)
    return spark.createDataFrame([(t, c, c in a.recoverable) for t, a in found.items() for c in sorted(a.references)], "source string, reference string, recoverable boolean")


#: The template of both labels is the same, so either table's labels put both in doubt.
_DOUBT = "(SELECT COUNT(*) = 0 FROM (SELECT c_name || ' ' || c_mktsegment AS x FROM customer UNION ALL SELECT p_name || ' ' || p_size FROM part) WHERE NOT contains(x, '/') AND length(regexp_replace(x, '[^ ]', '', 'g')) > 1)"
register(
    "analysis_observed",
    _observed,
    f"SELECT source, reference, coalesce(recoverable, {_DOUBT}) AS recoverable FROM ({values(('customer', 'c_custkey', True), ('customer', 'c_name', None), ('customer', 'c_mktsegment', None), ('part', 'p_partkey', True), ('part', 'p_name', None), ('part', 'p_size', None), ('orders', 'o_orderkey', True), ('orders', 'o_orderstatus', False), ('orders', 'o_orderpriority', False), names='source, reference, recoverable')})",
)


def _mapping_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the mapping alone decides: subjects without statements, blind joins, groups that repeat others."""
    cases = {
        "no statements": triples_map("A", "nation", subject("http://example.com/{n_nationkey}")) + triples_map("B", "region", subject("http://example.com/r/{r_regionkey}"), JOIN.format(p="in", m="A", c="r_name", k="n_name")),
        "blind join": triples_map("A", "customer", subject("http://example.com/{c_custkey}"), JOIN.format(p="in", m="N", c="c_nationkey", k="n_nationkey")) + triples_map("N", "nation", subject("http://example.com/n/{n_name}"), column("key", "n_nationkey")),
        "rivals": triples_map("A", "nation", subject("http://example.com/{n_nationkey}"), column("p", "n_name")) + triples_map("B", "nation", subject("http://example.com/{n_regionkey}"), column("p", "n_name")),
    }
    rows = [(case, t, c, c in a.recoverable) for case, text in cases.items() for t, a in analyse(parse_mapping(HEAD + text)).items() for c in sorted(a.references)]
    twins = parse_mapping(HEAD + "".join(triples_map(n, "orders", subject(f"http://example.com/{n}/{{o_orderkey}}"), column("key", "o_orderkey")) for n in "AB"))
    rows.append(("redundant group", "orders", f"{len(twins.rules)} rules, {len(distinct_groups(twins.rules, frozenset()))} kept", True))
    read_ = parse_mapping(HEAD + triples_map("A", "nation", subject('http://example.com/{\\"N_Key\\"}/{N_NAME}'), column("p", "N_Region"))).reads["nation"]
    rows += [("reads", "nation", c, True) for c in sorted(read_)]
    return spark.createDataFrame(rows, "kind string, source string, reference string, recoverable boolean")


register(
    "analysis_rules",
    _mapping_analysis,
    values(
        ("no statements", "nation", "n_nationkey", True), ("no statements", "region", "r_name", False), ("no statements", "region", "r_regionkey", True),
        ("blind join", "customer", "c_custkey", True), ("blind join", "customer", "c_nationkey", False), ("blind join", "nation", "n_name", True), ("blind join", "nation", "n_nationkey", True),
        ("rivals", "nation", "n_nationkey", False), ("rivals", "nation", "n_name", True), ("rivals", "nation", "n_regionkey", False),
        ("redundant group", "orders", "2 rules, 1 kept", True), ("reads", "nation", "N_Key", True), ("reads", "nation", "n_name", True), ("reads", "nation", "n_region", True),
        names="kind, source, reference, recoverable",
    ),
)


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips of whole tables compared with their sources, with the losses and the outcome of each."""
    some = "SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END AS o_orderkey, o_orderpriority FROM orders"
    status = triples_map("O", "orders", subject("http://example.com/customer/{o_custkey}"), column("status", "o_orderstatus"))
    cases = {
        "whole": (triples_map("R", "customer", subject("http://example.com/{c_custkey}"), *(column(c, c) for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))), "customer", ()),
        "columns": (NATION, "nation", ()),
        "rows": (triples_map("O", some, subject(ORDER), column("priority", "o_orderpriority"), query=True), "query_1", ()),
        "multiplicity": (status, "orders", ()),
        "tables": (NATION, "nation", ("region",)),
        "rows gone": (SUPPLIER, "supplier", ()),
        "empty column": (NATION, "nation", ()),
        "full column": (NATION, "nation", ()),
    }
    rows = []
    for case, (text, source, more) in cases.items():
        mapping = parse_mapping(HEAD + text)
        catalog = read(spark, sf_dir, mapping, *more)
        tables = catalog.with_queries(mapping.queries)

        def compare(case=case, mapping=mapping, catalog=catalog, tables=tables, source=source, more=more):
            back = reconstruct_tables(spark, mapping, Graph(graph_of(mapping, tables)), catalog, observe=False)[source]
            if case == "rows gone":
                back = back.where("s_suppkey > 1")
            if case in ("empty column", "full column"):
                back = back.withColumn("n_regionkey", F.lit(None if case == "empty column" else 1).cast("long"))
            return compare_databases({n: tables[n] for n in (source, *more)}, {source: back}, analyse(mapping))

        found = classify(compare)
        rows.append((case, found.outcome == Outcome.FULLY_INVERTED, ",".join(sorted(found.losses)), str(found.outcome)))
    return spark.createDataFrame(rows, "case string, identical boolean, losses string, outcome string")


_PART, _OFF = str(Outcome.PARTIALLY_INVERTED), str(Outcome.MISMATCH)
register(
    "compare_report",
    _comparison,
    values(
        ("whole", True, "", "fully_inverted"), ("columns", False, "columns_lost", _PART), ("rows", False, "rows_lost", _PART), ("multiplicity", False, "columns_lost,multiplicity_lost", _PART),
        ("tables", False, "columns_lost,tables_lost", _PART), ("rows gone", False, "", _OFF), ("empty column", False, "columns_lost", _PART), ("full column", False, "", _OFF),
        names='"case", identical, losses, outcome',
    ),
)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of runs that end otherwise than by a comparison."""

    def fails(error: Exception) -> Callable:
        def run():
            raise error

        return run

    equal, lossless = (lambda: (True, "", frozenset())), (lambda: (False, "", frozenset()))
    cases = {
        "error expected": classify(equal, error_expected=True),
        "no graph": classify(equal, has_graph=False),
        "forward failed": classify(equal, has_graph=False, forward_failed=True),
        "unsupported": classify(fails(UnsupportedMappingError("x"))),
        "not invertible": classify(fails(NonInvertibleError("x"))),
        "nothing to do": classify(fails(NoDataError("x")), empty=equal),
        "nothing after a failure": classify(fails(NoDataError("x")), forward_failed=True, empty=equal),
        "invalid": classify(fails(MappingError("x"))),
        "crash": classify(fails(RuntimeError("x"))),
        "unexplained": classify(lossless),
    }
    return spark.createDataFrame([(k, str(v.outcome)) for k, v in cases.items()], "ended string, outcome string")


register(
    "outcome_report",
    _outcomes,
    values(("error expected", "error_test_case"), ("no graph", "fully_inverted"), ("forward failed", "error"), ("unsupported", "not_supported"), ("not invertible", "non_invertible"), ("nothing to do", "fully_inverted"), ("nothing after a failure", "error"), ("invalid", "error"), ("crash", "error"), ("unexplained", "mismatch"), names="ended, outcome"),
)


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of whole tables compared as sets, blank nodes taken for one; and what a mapped query stands for."""
    named = parse_mapping(HEAD + triples_map("N", "nation", subject("a{n_nationkey}", " ; rr:termType rr:BlankNode"), column("name", "n_name")))
    other = parse_mapping(HEAD + triples_map("N", "nation", subject("b{n_nationkey}x", " ; rr:termType rr:BlankNode"), column("name", "n_name")))
    tables = read(spark, sf_dir, named, "region", "customer")
    a, b = graph_of(named, tables), graph_of(other, tables)
    content_ = logical_content({n: tables[n] for n in ("nation", "region", "customer")}, {"query_1": (tables["region"], ["nation", "region"])}, {"region"})
    rows = [("labels differ", str(same_graph(a, b)).lower()), ("repeated", str(same_graph(a, a.union(a))).lower()), ("a statement less", str(same_graph(a, b.where("o.value <> 'FRANCE' AND p IS NOT NULL").limit(1))).lower()), ("logical content", ",".join(sorted(content_)))]
    return spark.createDataFrame(rows, "what string, answer string")


register("graph_equality", _graphs, values(("labels differ", "true"), ("repeated", "true"), ("a statement less", "false"), ("logical content", "customer,query_1,region"), names="what, answer"))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pattern with a language, matched against literals of several languages and none."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    o = lambda lang: F.struct(F.lit("lit").alias("kind"), F.col("p_name").alias("value"), F.lit("").alias("dt"), F.lit(lang).alias("lang"))
    quads = [part.select(F.concat(F.lit("http://example.com/"), F.col("p_partkey").cast("string")).alias("s"), F.lit("http://example.com/p").alias("p"), o(lang).alias("o"), F.lit("").alias("g")) for lang in ("EN", "fr", "")]
    graph = Graph(quads[0].union(quads[1]).union(quads[2]))
    found = Pattern(subject="s", predicate="http://example.com/p", predicate_key=None, object_key="o", language="en").match(graph, {"s": "s", "o": "o"})
    return found.select("s", F.col("o.value").alias("o"), F.col("o.lang").alias("lang"))


register("pattern_language", _patterns, "SELECT 'http://example.com/' || p_partkey AS s, p_name AS o, 'EN' AS lang FROM part")


# -- functions on values that tell right from wrong ------------------------------------------


def _of_parts(**columns: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *(f(F.col("p_name"), F.col("p_partkey")).alias(n) for n, f in columns.items()))


register(
    "fn_percent_decode",
    _of_parts(decoded=lambda name, key: percent_decode(F.concat(F.lit("%41+%zz%C3%A9%2~"), encode_for_uri(name), F.lit("%")))),
    "SELECT p_partkey, 'A+%zzé%2~' || p_name || '%' AS decoded FROM part",
)
register(
    "fn_same_value",
    _of_parts(same=lambda name, key: same_value(F.when(key % 5 == 0, None).when(key % 5 == 1, name).when(key % 5 == 2, encode_for_uri(name)).when(key % 5 == 3, F.concat(name, F.lit("!"))).otherwise(name), F.when(key % 5 == 4, None).otherwise(name))),
    "SELECT p_partkey, p_partkey % 5 IN (0, 1, 2) AS same FROM part",
)
register(
    "fn_casts",
    _of_parts(number=lambda name, key: cast_to(F.concat(key.cast("string"), F.lit(".0")), T.LongType()), flag=lambda name, key: cast_to(F.when(key % 2 == 0, "yes").otherwise("F"), T.BooleanType())),
    "SELECT p_partkey, p_partkey AS number, p_partkey % 2 = 0 AS flag FROM part",
)

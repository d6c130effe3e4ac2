"""Forward mapping, typing, sinks, comparison, sources, streaming."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relift.api import reconstruct, reconstruct_tables
from relift.errors import MappingError, NoDataError
from relift.functions.terms import cast_to, natural, type_of
from relift.functions.text import encode_for_uri, percent_decode, same_value, strafter, strbefore
from relift.functions.vocabulary import XSD
from relift.operators.compare import CaseResult, Outcome, PartialLoss, classify, compare_databases, logical_content, same_graph, same_rows
from relift.operators.forward import graph_of, statements_of
from relift.plans.analysis import TableAnalysis
from relift.plans.mapping import parse_mapping
from relift.plans.rules import Mapping
from relift.sources.rdf import Graph
from relift.sources.sink import ParquetSink, TableSink, sink_for
from relift.sources.tables import Catalog, base_tables, check_references, content, delimited, jdbc_options, run_script
from relift.streaming.incremental import reconstruct_stream

from .helpers import EX, lit, mapping, quads, ref, rows, rule, term_map

HEAD = "@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://example.com/> .\n"


def values(spark, expression, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(expression(F.col("x"))).collect()]


def test_string_functions(spark):
    assert values(spark, lambda x: strafter(x, "-"), "a-b-c", "abc", "", None) == ["b-c", "", "", None]
    assert values(spark, lambda x: strafter(x, ""), "abc") == ["abc"]
    assert values(spark, lambda x: strbefore(x, "-"), "a-b-c", "abc", None) == ["a", "", None]
    assert values(spark, lambda x: strbefore(x, ""), "abc") == [""]
    assert values(spark, encode_for_uri, "a b*~/é+") == ["a%20b%2A~%2F%C3%A9%2B"]
    assert values(spark, percent_decode, "a%20b+%zz%C3%A9%", None) == ["a b+%zzé%", None]
    assert values(spark, lambda x: same_value(x, F.lit("a b")), "a b", "a%20b", "c", None) == [True, True, False, True]


def test_casts(spark):
    assert values(spark, lambda x: cast_to(x, T.IntegerType()), "1.0", "-7", None) == [1, -7, None]
    assert values(spark, lambda x: cast_to(x, T.BooleanType()), "T", "yes", "0", "False", None) == [True, True, False, False, None]
    assert values(spark, lambda x: cast_to(x, T.DecimalType(5, 2)), "1.25") == [decimal.Decimal("1.25")]
    assert values(spark, lambda x: cast_to(x, T.BinaryType()), "89504E47") == [bytearray(b"\x89PNG")]
    assert values(spark, lambda x: cast_to(x, T.TimestampNTZType()), "2020-01-02T03:04:05.5") == [datetime.datetime(2020, 1, 2, 3, 4, 5, 500000)]
    for kind, bad in ((T.IntegerType(), "x"), (T.BooleanType(), "maybe"), (T.DateType(), "no")):
        with pytest.raises(Exception):
            values(spark, lambda x: cast_to(x, kind), bad)
    with pytest.raises(TypeError):
        cast_to(F.lit("x"), T.ArrayType(T.FloatType()))
    with pytest.raises(TypeError):
        natural(F.lit(1), T.ArrayType(T.FloatType()))
    assert type_of({XSD + "integer"}) == T.LongType() and type_of({XSD + "integer", XSD + "double"}) == T.StringType() and type_of(set()) == T.StringType()
    assert type_of({XSD + "dateTime"}, zoned=True) == T.TimestampType()


TYPES = "id int, b boolean, d date, t timestamp_ntz, n decimal(10,3), f double, x binary, s string"
ROW = (1, True, datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5, 6), decimal.Decimal("1.500"), 0.1, bytearray(b"\x00\xff"), 'q"\\\n é')


def typed_mapping():
    return mapping(*(rule("id", c, EX + c, source="t") for c in "bdtnfxs"))


def test_round_trip_of_all_types(spark, tmp_path):
    table = spark.createDataFrame([ROW, (2, False, ROW[2], ROW[3], ROW[4], float("1e300"), ROW[6], "")], TYPES)
    catalog, whole = Catalog(spark, {"t": table}), typed_mapping()
    graph = graph_of(whole, catalog)
    (back,) = reconstruct_tables(spark, whole, graph, catalog).values()
    assert back.schema.simpleString() == table.schema.simpleString() and rows(back) == rows(table)
    from relift.sources.rdf import write_quads

    write_quads(graph, str(tmp_path / "g.nq"))
    (back,) = reconstruct_tables(spark, whole, str(tmp_path / "g.nq"), catalog).values()
    assert rows(back) == rows(table)
    (free,) = reconstruct_tables(spark, whole, graph).values()
    assert dict(free.dtypes) == {"id": "string", "b": "boolean", "d": "date", "t": "timestamp_ntz", "n": "decimal(38,18)", "f": "double", "x": "string", "s": "string"}


def test_both_forward_forms_agree(spark):
    catalog = Catalog(spark, {"t": spark.createDataFrame([ROW, (2, None, *[None] * 5, "x")], TYPES)})
    a, b = graph_of(typed_mapping(), catalog), statements_of(typed_mapping(), catalog)
    assert same_graph(a, b) and b.count() == 8


def test_constant_predicates_leave_one_projection(spark, tmp_path):
    spark.createDataFrame([ROW], TYPES).write.parquet(str(tmp_path / "t"))
    graph = graph_of(typed_mapping(), Catalog(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}))
    plan = graph.where(F.col("p") == EX + "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan


def test_sinks(spark, tmp_path):
    first = spark.createDataFrame([(1, "a")], "id int, name string")
    spark.sql("DROP TABLE IF EXISTS people")
    for sink, back in ((TableSink(spark), lambda: spark.table("people")), (ParquetSink(str(tmp_path)), lambda: spark.read.parquet(str(tmp_path / "people")))):
        sink.write(first.where("id < 0"), "people")
        assert back().count() == 0 and back().columns == ["id", "name"]
        sink.write(first, "people")
        sink.write(first, "people")
        assert back().count() == 2
        wider = spark.createDataFrame([(2, "b", 1.5)], "id long, name string, more double")
        sink.write(wider.where("id < 0"), "people")  # nothing changes for no rows
        assert back().columns == ["id", "name"]
        sink.write(wider, "people")
        assert rows(back()) == [(1, "a", None), (1, "a", None), (2, "b", 1.5)] and back().schema["id"].dataType == T.LongType()
        with pytest.raises(MappingError):
            sink.write(wider.drop("more"), "people")
        sink.allow_drop = True
        sink.write(wider.drop("more"), "people")
        assert back().columns == ["id", "name"] and back().count() == 4
    assert isinstance(sink_for(spark, "catalog:db"), TableSink) and isinstance(sink_for(spark, "/x"), ParquetSink)
    assert sink_for(spark, "postgresql+psycopg2://u:p%40@h/d").options == {"url": "jdbc:postgresql://h/d", "user": "u", "password": "p@"}


def test_reconstruct_appends(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    whole, catalog = mapping(rule("id", "name", EX + "name", source="t")), Catalog(spark, {"t": table})
    for n in (2, 4):
        reconstruct(spark, whole, graph_of(whole, catalog), str(tmp_path), catalog)
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    with pytest.raises(NoDataError):
        reconstruct(spark, Mapping([]), graph_of(whole, catalog), str(tmp_path))


def table(spark, *data):
    return spark.createDataFrame(list(data), "fname string, lname string, amount int")


BOB, SUE = ("Bob", "Smith", 30), ("Sue", "Jones", 20)
ALL = TableAnalysis(frozenset({"fname", "lname", "amount"}), frozenset(), (frozenset({"fname"}),))


def test_comparison(spark):
    source = {"people": table(spark, BOB, BOB, SUE)}
    assert compare_databases(source, {"people": table(spark, SUE, BOB, BOB).select("amount", "fname", "lname")}, {"people": ALL}) == (True, "All tables in source and destination databases are identical", frozenset())
    same, message, losses = compare_databases(source, {"people": table(spark, BOB, SUE)}, {"people": ALL})
    assert (same, losses) == (False, {PartialLoss.MULTIPLICITY_LOST}) and message == "Characterised loss - people: 1 duplicate row(s) collapsed"
    some = TableAnalysis(ALL.references, frozenset({"lname"}), (frozenset({"fname"}),))
    source = {"people": table(spark, BOB, SUE, (None, "x", 1))}
    assert compare_databases(source, {"people": table(spark, BOB, SUE).drop("lname")}, {"people": some})[2] == {PartialLoss.COLUMNS_LOST, PartialLoss.ROWS_LOST}
    blank = table(spark, BOB, SUE).withColumn("lname", F.lit(""))
    assert compare_databases(source, {"people": blank}, {"people": some})[2] == {PartialLoss.COLUMNS_LOST, PartialLoss.ROWS_LOST}
    for found, what in (
        ({}, "missing from the destination database"),
        ({"people": table(spark, BOB)}, "columns differ from the recoverable ones"),
        ({"people": table(spark, BOB).drop("lname")}, "data differs from the expected projection"),
        ({"people": table(spark, BOB, SUE).drop("lname"), "more": table(spark)}, "more (absent from the source database)"),
    ):
        same, message, losses = compare_databases(source, found, {"people": some})
        assert not same and not losses and message.startswith("Unexplained differences") and what in message
    cities = {"cities": spark.createDataFrame([("Rome",)], "name string")}
    assert compare_databases(cities, {}, {}) == (False, "Characterised loss - cities: unmapped table", frozenset({PartialLoss.TABLES_LOST}))
    assert "unmapped table present" in compare_databases(cities, cities, {})[1]


def test_multisets(spark):
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert same_rows(nan, spark.createDataFrame([(None,), (None,)], "x double"))
    assert not same_rows(nan, spark.createDataFrame([(None,)], "x double")) and not same_rows(nan, nan.withColumnRenamed("x", "y"))


def test_outcomes():
    def fails(error):
        def run():
            raise error

        return run

    from relift.errors import NonInvertibleError, UnsupportedMappingError

    assert classify(None, error_expected=True, has_graph=False).outcome == Outcome.ERROR_TEST_CASE
    assert classify(fails(UnsupportedMappingError("x"))) == CaseResult(Outcome.NOT_SUPPORTED, message="x")
    assert classify(fails(NonInvertibleError("x"))).outcome == Outcome.NON_INVERTIBLE
    assert classify(lambda: (True, "", frozenset())).outcome == Outcome.FULLY_INVERTED
    assert classify(lambda: (False, "", frozenset({PartialLoss.ROWS_LOST}))).outcome == Outcome.PARTIALLY_INVERTED
    assert classify(lambda: (False, "", frozenset())).outcome == Outcome.MISMATCH
    assert set(logical_content({"a": 1, "b": 2, "c": 3}, {"query_1": (4, ["a", "b"])}, {"b"})) == {"b", "c", "query_1"}


def test_sources(spark):
    catalog = Catalog(spark, {"Student": spark.createDataFrame([(1, "Ann")], "id int, Name string"), "sport": spark.createDataFrame([(1, "golf")], "id int, title string")})
    sql = 'SELECT "Student"."id", title || \' "x"\' AS t FROM "Student" JOIN sport ON "Student"."id" = sport.id'
    assert rows(catalog.query(sql)) == [(1, 'golf "x"')] and sorted(base_tables(spark, sql)) == ["Student", "sport"]
    assert base_tables(spark, "WITH a AS (SELECT * FROM b) SELECT * FROM a") == ["b"]
    assert delimited("'a\"b'\"c\"") == "'a\"b'`c`"
    text = HEAD + '<#A> rr:logicalTable [ rr:tableName "sport" ] ; rr:subjectMap [ rr:template "http://e/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:column "%s" ] ] .'
    check_references(parse_mapping(text % "title"), catalog)
    with pytest.raises(MappingError, match="no column named nothing"):
        check_references(parse_mapping(text % "nothing"), catalog)
    query = HEAD + '<#A> rr:logicalTable [ rr:sqlQuery "SELECT id FROM sport" ] ; rr:subjectMap [ rr:template "http://e/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:column "title" ] ] .'
    found = parse_mapping(query)
    with pytest.raises(MappingError, match="The query"):
        check_references(found, catalog.with_queries(found.queries))
    assert jdbc_options("mysql+pymysql://h:1/d") == {"url": "jdbc:mysql://h:1/d"}
    with pytest.raises(ValueError):
        jdbc_options("oracle://h/d")
    run_script(spark, "CREATE OR REPLACE TEMP VIEW v AS SELECT ';' AS x; CREATE OR REPLACE TEMP VIEW w AS SELECT X'FF' AS y;")
    assert spark.table("v").first().x == ";" and content(spark.table("w")).first().y == "FF"


def test_streaming(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store.parquet")
    folder.mkdir()
    whole = mapping(rule("id", "a", EX + "a", source="t"), rule("id", "b", EX + "b", source="t"))
    seen = {}

    def sink(tables, number):
        for r in tables["t"].collect():
            seen[r.id] = (r.a, r.b)

    def run(name, *lines):
        (folder / name).write_text("".join(f'<{EX}table/{s}> <{EX}{p}> "{o}" .\n' for s, p, o in lines))
        query = reconstruct_stream(spark, whole, str(folder), store, sink, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    run("1.nt", ("1", "a", "x"), ("1", "b", "y"), ("2", "a", "z"))
    assert seen == {"1": ("x", "y")}
    seen.clear()
    run("2.nt", ("2", "b", "w"))
    assert seen == {"2": ("z", "w")}


def test_graph_equality(spark):
    a = quads(spark, [("urn:bnode:x", "p", lit("1"))])
    assert same_graph(a, quads(spark, [("urn:bnode:y", "p", lit("1"))])) and not same_graph(a, quads(spark, [("urn:bnode:y", "p", lit("2"))]))


def test_observed_terms_come_from_the_graph(spark):
    t = spark.createDataFrame([(1, "a b", "c"), (2, "d", "e")], "id int, x string, y string")
    whole, catalog = mapping(rule("id", term_map("{x} {y}", "literal"), source="t"), rule("id", ref("x"), EX + "x", source="t")), Catalog(spark, {"t": t})
    (back,) = reconstruct_tables(spark, whole, Graph(graph_of(whole, catalog)), catalog).values()
    assert rows(back) == [(1, "a b"), (2, "d")]


def test_interrupted_evolution_is_given_back(spark, tmp_path):
    sink, old = ParquetSink(str(tmp_path)), spark.createDataFrame([(1,)], "a int")
    sink.write(old, "t")
    (tmp_path / "t").rename(tmp_path / "t.before")  # a crash between the two renames
    sink.write(old.selectExpr("a", "2 AS b"), "t")
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, 2), (1, None)] or rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, None), (1, 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_nothing_is_published_before_all_is_prepared(spark, tmp_path):
    whole = mapping(rule("id", "a", EX + "a", source="t"), rule("id", "b", EX + "b", source="u"))
    data = {"t": spark.createDataFrame([(1, "x")], "id int, a string"), "u": spark.createDataFrame([(1, "x")], "id int, b string")}
    ParquetSink(str(tmp_path)).write(spark.createDataFrame([(1, "x", 2)], "id int, b string, more int"), "u")
    with pytest.raises(MappingError, match="lack"):
        reconstruct(spark, whole, graph_of(whole, data), str(tmp_path), Catalog(spark, data))
    assert not (tmp_path / "t").exists()


def test_outcomes_of_errors():
    def fails(error):
        def run():
            raise error

        return run

    equal = lambda: (True, "", frozenset())
    assert classify(fails(NoDataError("x")), empty=equal).outcome == Outcome.FULLY_INVERTED
    assert classify(fails(NoDataError("x")), forward_failed=True, empty=equal).outcome == Outcome.ERROR
    assert classify(fails(MappingError("x"))) == CaseResult(Outcome.ERROR, message="x")
    assert classify(fails(ZeroDivisionError("x"))).outcome == Outcome.ERROR
    assert classify(equal, has_graph=False).outcome == Outcome.FULLY_INVERTED
    assert classify(equal, has_graph=False, forward_failed=True).outcome == Outcome.ERROR


def test_char_columns_are_padded(spark):
    spark.sql("CREATE TABLE chars (c CHAR(4)) USING parquet")
    spark.sql("INSERT INTO chars VALUES ('ab')")
    assert spark.table("chars").schema["c"].metadata and content(spark.table("chars").selectExpr("c")).first().c == "ab  "
    spark.sql("DROP TABLE chars")

"""Tiny graphs, rules and rows."""

import datetime

import pytest

from relift.api import invert, reconstruct_tables
from relift.errors import UnsupportedMappingError
from relift.functions.vocabulary import XSD
from relift.operators.forward import graph_of
from relift.operators.typing import by_schema, by_values
from relift.plans.analysis import analyse
from relift.plans.rules import BNODE, LITERAL
from relift.sources.rdf import Graph

from .helpers import EX, iri, join, lit, mapping, quads, ref, rows, rule, term_map


def solve(spark, found, rules, source="data", observe=True, **options):
    graph = Graph(quads(spark, found))
    whole = mapping(*rules)
    analysis = analyse(whole, graph.observed if observe else None)
    df = by_values(invert(whole, source, graph, analysis, **options))
    return rows(df.select(*sorted(df.columns)))


def at(text):
    return term_map(EX + text)


def words(text):
    return term_map(text, LITERAL)


def test_typed_without_a_source(spark):
    found = [("patient/10", "birth", lit("1981-10-10", XSD + "date")), ("patient/10", "weight", lit("8.025E1", XSD + "double"))]
    rules = [rule(at("patient/{id}"), "birthdate", EX + "birth"), rule(at("patient/{id}"), "weight", EX + "weight")]
    (table,) = reconstruct_tables(spark, mapping(*rules), quads(spark, found)).values()
    assert dict(table.dtypes) == {"id": "string", "birthdate": "date", "weight": "double"}
    assert table.first().asDict() == {"id": "10", "birthdate": datetime.date(1981, 10, 10), "weight": 80.25}


def test_columns_left_out(spark):
    found = [(f"table/{x}", "p1", lit(y)) for x, y in zip("abcxyz", "aaaxxx", strict=True)]
    assert solve(spark, found, [rule("p1"), rule("p2"), rule("p3")]) == [("a",), ("x",)]


def test_observed_ambiguity(spark):
    found = [("table/1", "p1", lit("Maria De Luca")), ("table/1", "given", lit("Maria"))]
    split = rule("id", words("{p2} {p3}"))
    assert solve(spark, found, [split]) == [("1",)]
    assert solve(spark, found, [split, rule("id", "p2", EX + "given")]) == [("1", "Maria")]


def test_adjacent_template(spark):
    assert solve(spark, [("BobSmith", "p1", lit("Bob"))], [rule(at("{p1}{p2}"), "p1")]) == [("Bob",)]


def test_cross_table_evidence(spark):
    found = [("BobSmith", "unsafe", lit("BobSmith")), ("BobSmith", "safe", lit("Bob Smith"))]
    rules = [rule(at("{p1}{p2}"), words("{p1}{p2}"), EX + "unsafe"), rule(at("{p1}{p2}"), words("{p1} {p2}"), EX + "safe", source="evidence")]
    assert solve(spark, found, rules, observe=False) == [("Bob", "Smith")]


def test_two_named_graphs(spark):
    found = [("table/a", "p1", iri(EX + "o"), EX + "a/b"), ("table/a", "p1", iri(EX + "o"), EX + "b/c"), ("table/x", "p1", iri(EX + "o"), EX + "a/y"), ("table/x", "p1", iri(EX + "o"), EX + "b/z")]
    rules = [rule("p1", at("o"), graph=EX + "a/{p2}"), rule("p1", at("o"), graph=EX + "b/{p3}")]
    assert solve(spark, found, rules) == [("a", "b", "c"), ("x", "y", "z")]


def test_sibling_graph_maps_are_dropped(spark):
    found = [("table/a", "p1", lit("1"), EX + "g/b"), ("table/a", "p1", lit("1"), EX + "g/c")]
    assert solve(spark, found, [rule("id", "v", graph=EX + "g/{p2}"), rule("id", "v", graph=EX + "g/{p3}")]) == [("a", "1")]


JOIN = [("table/1", "p1", iri(EX + "table2/10")), ("table/2", "p1", iri(EX + "table2/20"))]


def test_referenced_subject(spark):
    rules = [rule("id", join("#parent", "fk", "id"), source="data1"), rule(at("table2/{id}"), None, source="data2", triples_map="#parent")]
    assert solve(spark, JOIN, rules, "data2") == [("10",), ("20",)]
    assert solve(spark, JOIN, rules, "data1") == [("10", "1"), ("20", "2")]
    twice = [*rules, rule("id", join("#parent", "fk", "id"), EX + "other", source="data3")]
    with pytest.raises(UnsupportedMappingError):
        solve(spark, JOIN, twice, "data2")


def test_join_key_that_a_literal_shows(spark):
    found = [*JOIN[:1], ("table/1", "key", lit("10"))]
    rules = [rule("id", "fk", EX + "key", source="data1"), rule("id", join("#p", "fk", "k"), source="data1"), rule(at("table2/{k}"), "x", source="data2", triples_map="#p")]
    assert solve(spark, found, rules, "data1") == [("10", "1")]


def test_foreign_key_may_be_missing(spark):
    found = [*JOIN[:1], ("table/1", "name", lit("a")), ("table/2", "name", lit("b"))]
    rules = [rule("id", "name", EX + "name", source="d"), rule("id", join("#p", "fk", "k"), source="d"), rule(at("table2/{k}"), "x", source="e", triples_map="#p")]
    assert solve(spark, found, rules, "d") == [("10", "1", "a"), (None, "2", "b")]


def test_blank_nodes(spark):
    found = [("urn:bnode:row%201", "p1", lit("a"))]
    assert solve(spark, found, [rule(term_map("row{id}", BNODE), "v")]) == [(" 1", "a")]
    assert solve(spark, [("urn:bnode:s", "p1", lit("a"))], [rule(ref("id", BNODE), "v")]) == [("s", "a")]


def test_values_agree_after_encoding(spark):
    found = [("table/a%20b", "p1", lit("a b")), ("table/c", "p1", lit("d"))]
    assert solve(spark, found, [rule("p1", "p1")]) == [("a b",)]


def test_plus_and_malformed_escapes_stay(spark):
    found = [("table/a+b%2F%zz", "p1", iri(EX + "o"))]
    assert solve(spark, found, [rule("id", at("o"))]) == [("a+b/%zz",)]


def test_languages(spark):
    found = [("table/1", "p1", lit("chat", XSD[:-1], "fr")), ("table/1", "p1", lit("cat", XSD[:-1], "EN"))]
    assert solve(spark, found, [rule("id", ref("v", language="en"))]) == [("1", "cat")]


def test_text_meets_only_plain_literals(spark):
    found = [("table/1", "a", lit("n7")), ("table/1", "b", lit("7")), ("table/2", "a", lit("n8")), ("table/2", "b", lit("8", XSD + "integer"))]
    rules = [rule("id", words("n{v}"), EX + "a"), rule("id", "v", EX + "b")]
    assert solve(spark, found, rules, strict=False) == [("1", "7")]
    assert solve(spark, found, rules) == [("1", "7"), ("2", "8")]


def test_predicate_template_and_multiple_values(spark):
    found = [("table/1", "was/new", lit("x")), ("table/1", "was/old", lit("y")), ("table/1", "other", lit("z"))]
    assert solve(spark, found, [rule("id", "v", at("was/{kind}"))]) == [("1", "new", "x"), ("1", "old", "y")]


def test_cross_product_of_values(spark):
    found = [("table/1", "a", lit("x")), ("table/1", "a", lit("y")), ("table/1", "b", lit("1")), ("table/1", "b", lit("2"))]
    assert len(solve(spark, found, [rule("id", "a", EX + "a"), rule("id", "b", EX + "b")])) == 4


def test_templates_are_quoted_unless_loose(spark):
    found = [("tableX1", "p1", lit("a")), ("table.2", "p1", lit("b"))]
    assert solve(spark, found, [rule(at("table.{id}"), "v")]) == [("2", "b")]
    assert solve(spark, found, [rule(at("table.{id}"), "v")], strict=False) == [("", "a"), ("2", "b")]


def test_required_or_optional_values(spark):
    found = [("table/1", "a", lit("x")), ("table/1", "b", lit("y")), ("table/2", "a", lit("z"))]
    rules = [rule("id", "a", EX + "a"), rule("id", "b", EX + "b")]
    assert solve(spark, found, rules) == [("x", "y", "1")]
    assert solve(spark, found, rules, optional_objects=True) == [("x", "y", "1"), ("z", None, "2")]


def test_constants(spark):
    found = [("table/1", "a", lit("x")), ("table/1", "is", iri(EX + "T")), ("table/2", "a", lit("y")), ("table/1", "n", lit("5", XSD + "integer"))]
    whole = [rule("id", "a", EX + "a"), rule("id", at("T"), EX + "is"), rule("id", term_map("5", LITERAL, datatype=XSD + "integer"), EX + "n")]
    assert solve(spark, found, whole) == [("x", "1")]
    with pytest.raises(UnsupportedMappingError):
        solve(spark, found, [rule("id", "a", EX + "a"), rule("id", term_map("b", BNODE), EX + "is")])


def test_empty_graph(spark):
    assert solve(spark, [], [rule("id", "v")]) == []


def test_plan_has_two_shuffles_for_two_patterns(spark, tmp_path):
    quads(spark, [("table/1", "a", lit("x")), ("table/1", "b", lit("y"))]).write.parquet(str(tmp_path / "q"))
    from relift.functions.terms import QUAD

    df = invert(mapping(rule("id", "a", EX + "a"), rule("id", "b", EX + "b")), "data", Graph(spark.read.schema(QUAD).parquet(str(tmp_path / "q"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 2, plan
    assert "EqualTo(p,http://example.com/a)" in plan and "PythonUDF" not in plan


def test_two_subject_maps_meet_in_an_equi_join(spark):
    """Subject maps of one table are joined on the columns that both show, not by all pairs."""
    data = spark.createDataFrame([(i, f"n {i}%", f"p{i}") for i in range(20)], "id int, name string, phone string")
    whole = mapping(rule(term_map(EX + "a/{id}/{name}"), "name", EX + "x", source="t"), rule(term_map(EX + "b/{id}/{name}"), "phone", EX + "y", source="t"))
    found = invert(whole, "t", Graph(graph_of(whole, {"t": data})))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert rows(by_schema(found, data.schema)) == rows(data)

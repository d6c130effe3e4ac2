"""Reading and writing graphs."""

import gzip
import os

import pytest

from relift.functions.vocabulary import LANG_STRING, XSD, XSD_STRING
from relift.plans.rules import Template
from relift.sources.rdf import Graph, format_of, lines_of, parse_lines, read_quads, write_quads

from .helpers import EX, iri, lit, quads, rows


def parsed(spark, *lines):
    found = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    return [(r.s, r.p, tuple(r.o), r.g) for r in found.collect()]


def test_statements(spark):
    assert parsed(
        spark,
        '<http://a/s> <http://a/p> "x\\"y\\u00e9\\U0001F600\\n"^^<http://a/t> <http://a/g> .',
        '_:b1 <http://a/p> "chat"@fr-BE . # note',
        "<http://a/s><http://a/p>_:o.",
        "<http://a/s> <http://a/p> <http://a/\\u00e9> _:g.1 .",
        "",
        "  # only a comment",
    ) == [
        ("http://a/s", "http://a/p", ("lit", 'x"yé😀\n', "http://a/t", ""), "http://a/g"),
        ("urn:bnode:b1", "http://a/p", ("lit", "chat", LANG_STRING, "fr-BE"), ""),
        ("http://a/s", "http://a/p", ("iri", "urn:bnode:o", "", ""), ""),
        ("http://a/s", "http://a/p", ("iri", "http://a/é", "", ""), "urn:bnode:g.1"),
    ]


def test_escaped_backslash_before_u(spark):
    assert parsed(spark, '<a:s> <a:p> "\\\\u0041" .')[0][2] == ("lit", "\\u0041", XSD_STRING, "")


@pytest.mark.parametrize("line", ["not rdf", "<a:s> <a:p> .", '"x" <a:p> <a:o> .', "<a:s> _:p <a:o> .", '<a:s> <a:p> "x\\q" .', "<a:s> <a:p> <a:o>"])
def test_malformed(spark, line):
    with pytest.raises(Exception, match="malformed RDF"):
        parsed(spark, line)


def test_formats(spark, tmp_path):
    assert format_of("a/b.nq.gz") == "text" and format_of("q.parquet/") == "parquet"
    for bad in ("graph.rdfdata", "graph", "a.b/graph"):
        with pytest.raises(ValueError):
            format_of(bad)
    with gzip.open(tmp_path / "g.nt.gz", "wt") as out:
        out.write("<a:s> <a:p> <a:o> .\n")
    assert read_quads(spark, str(tmp_path / "g.nt.gz")).count() == 1


def test_round_trip_of_files(spark, tmp_path):
    found = quads(spark, [("urn:bnode:s", "p", lit('a"\\\n\té'), "http://g"), ("s", "p", lit("5", XSD + "integer")), ("s", "q", lit("x", LANG_STRING, "en")), ("s", "q", iri("urn:bnode:o"))])
    for name in ("a.nq", "a.parquet"):
        write_quads(found, str(tmp_path / name))
        assert rows(read_quads(spark, str(tmp_path / name))) == rows(found)
    write_quads(found, str(tmp_path / "b.parquet"), partition_by_predicate=True)
    assert rows(read_quads(spark, str(tmp_path / "b.parquet"))) == rows(found)
    assert "_:s" in lines_of(found).first().value


def test_default_graph_is_the_union(spark):
    with Graph(quads(spark, [("s", "p", lit("a")), ("s", "p", lit("b"), "g:1"), ("s", "p", lit("c"), "g:2")]), keep=True) as graph:
        assert graph.union().count() == 5
    graph = Graph(quads(spark, [("s", "p", lit("a"), "g:1"), ("s", "p", lit("a"), "g:2")]))
    assert graph.default.count() == 1 and graph.named.count() == 2 and graph.in_graph("g:1").count() == 1


@pytest.mark.parametrize(("text", "terms", "twice"), [("{a} {b}", ["Maria De Luca"], True), ("{a} {b}", ["Alice Rossi", "plain"], False), ("{a}{b}", ["x"], True), ("x{a}-{b}-{c}y", ["x1-2-3y"], False), ("{a}.{b}", ["1.2.3"], True)])
def test_decompositions(spark, text, terms, twice):
    graph = Graph(quads(spark, [("s", "p", lit(t)) for t in terms]))
    assert graph.observed_twice("object", Template.parse(text)) is twice


def test_text_is_parsed_once(spark, tmp_path):
    """Five predicates read the quads that were written when the graph was opened, and no text."""
    found = quads(spark, [(f"s{i}", f"p{k}", lit(str(i))) for i in range(20) for k in range(5)])
    write_quads(found, str(tmp_path / "a.nt"))
    with Graph.open(spark, str(tmp_path / "a.nt")) as graph:
        plan = graph.default._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "FileScan text" not in plan and graph.default.count() == 100
        at = graph._path.removeprefix("file:")
        assert os.path.isdir(at)
    assert not os.path.exists(at)


def test_one_pass_answers_all(spark):
    graph = Graph(quads(spark, [("s", "p", lit("a b c")), ("s", "p", lit("d"), "http://g/1-2-3")]))
    asked = [("object", Template.parse("{a} {b}")), ("graph", Template.parse("http://g/{a}-{b}")), ("subject", Template.parse(EX + "{a}{b}")), ("predicate", Template.parse("{a}-{b}"))]
    assert graph.observed(asked) == [True, True, True, False] and graph.observed([]) == []

"""Small mapping cases after the public R2RML test suite's themes, with the outcome each should have."""

import pytest

from relift.api import analyze_mapping, reconstruct_tables
from relift.operators.compare import Outcome, PartialLoss, classify, compare_databases
from relift.operators.forward import graph_of
from relift.plans.mapping import parse_mapping
from relift.sources.rdf import Graph
from relift.sources.tables import Catalog

HEAD = "@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://example.com/> . @prefix foaf: <http://xmlns.com/foaf/0.1/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
STUDENT = ("student", "id int, name string", [(10, "Venus")])
FULL, PART, NONE = Outcome.FULLY_INVERTED, Outcome.PARTIALLY_INVERTED, Outcome.NON_INVERTIBLE
COLUMNS, ROWS, MULTIPLICITY, TABLES = PartialLoss


def triples_map(table, subject, *statements, name="A", query=False):
    source = f'rr:sqlQuery """{table}"""' if query else f'rr:tableName "{table}"'
    return f"<#{name}> rr:logicalTable [ {source} ] ; rr:subjectMap [ {subject} ]" + "".join(f" ; rr:predicateObjectMap [ {s} ]" for s in statements) + " .\n"


def column(predicate, name, more=""):
    return f'rr:predicate {predicate} ; rr:objectMap [ rr:column "{name}"{more} ]'


IOUS = ("ious", "fname string, lname string, amount double", [("Bob", "Smith", 30.0), ("Sue", "Jones", 20.0), ("Bob", "Smith", 30.0)])
PEOPLE = ("person", "id int, name string, born string", [(1, "Alice", None), (2, "Bob", "September, 2010")])
SPORTS = [("student", "id int, name string, sport int", [(10, "Venus Williams", 100), (20, "Demi Moore", None)]), ("sport", "id int, name string", [(100, "Tennis")])]
JOIN = 'rr:predicate ex:practises ; rr:objectMap [ rr:parentTriplesMap <#B> ; rr:joinCondition [ rr:child "sport" ; rr:parent "id" ] ]'
MANY = [("student", "id int, first string", [(10, "Venus"), (11, "Fernando")]), ("sport", "id int, title string", [(110, "Tennis"), (111, "Football")]), ("student_sport", "id_student int, id_sport int", [(10, 110), (11, 110), (11, 111)])]
COUNTRY = ("country", "code string, lan string, name string", [("BO", "EN", "Bolivia, Plurinational State of"), ("BO", "ES", "Estado Plurinacional de Bolivia"), ("IE", "EN", "Ireland"), ("IE", "ES", "Irlanda")])

CASES = {
    "empty table": ([("student", "name string", [])], triples_map("student", 'rr:template "http://example.com/{name}"', column("foaf:name", "name")), FULL, set()),
    "one column": ([("student", "name string", [("Venus",)])], triples_map("student", 'rr:template "http://example.com/{name}"', column("foaf:name", "name")), FULL, set()),
    "blank node of a template": ([("student", "name string", [("Venus",)])], triples_map("student", 'rr:template "{name}" ; rr:termType rr:BlankNode', column("foaf:name", "name")), FULL, set()),
    "two columns in the subject": ([STUDENT], triples_map("student", 'rr:template "http://example.com/{id}/{name}" ; rr:class foaf:Person', column("ex:id", "id"), column("foaf:name", "name")), FULL, set()),
    "subject of a computed column": (
        [STUDENT],
        triples_map("SELECT concat('Student', id) AS sid, id, name FROM student", 'rr:column "sid"', column("ex:id", "id"), column("foaf:name", "name"), query=True),
        PART,
        {COLUMNS},
    ),
    "literal of a template": (
        [("student", "id int, first string, last string", [(10, "Venus", "Williams")])],
        triples_map("student", 'rr:template "http://example.com/Student{id}"', 'rr:predicate foaf:name ; rr:objectMap [ rr:template "{first} {last}" ; rr:termType rr:Literal ]'),
        FULL,
        set(),
    ),
    "two subjects of a row": (
        [("student_sport", "student string, sport string", [("Venus", "Tennis")])],
        triples_map("student_sport", 'rr:template "http://example.com/{student}" ; rr:class ex:Student', column("foaf:name", "student")) + triples_map("student_sport", 'rr:template "http://example.com/{sport}" ; rr:class ex:Sport', column("foaf:title", "sport"), name="B"),
        FULL,
        set(),
    ),
    "duplicate rows": ([IOUS], triples_map("ious", 'rr:template "http://example.com/{fname};{lname}" ; rr:class foaf:Person', column("ex:owes", "amount")), PART, {MULTIPLICITY}),
    "graphs": ([STUDENT], triples_map("student", 'rr:template "http://example.com/Student/{id}/{name}" ; rr:graph ex:PersonGraph ; rr:class foaf:Person', column("ex:id", "id"), column("foaf:name", "name")), FULL, set()),
    "graph of a template": ([STUDENT], triples_map("student", 'rr:template "http://example.com/Student/{id}/{name}" ; rr:graphMap [ rr:template "http://example.com/graph/Student/{id}/{name}" ]', column("ex:id", "id"), column("foaf:name", "name")), FULL, set()),
    "subject as an object": ([STUDENT], triples_map("student", 'rr:template "http://example.com/Student/{id}/{name}"', column("foaf:name", "name"), "rr:predicate ex:same ; rr:objectMap [ rr:parentTriplesMap <#A> ]"), FULL, set()),
    "unmapped column": ([("student", "id int, name string, last string", [(10, "Venus", "Williams")])], triples_map("student", 'rr:template "http://example.com/{id}"', column("foaf:name", "name")), PART, {COLUMNS}),
    "foreign key that may be missing": (SPORTS, triples_map("student", 'rr:template "http://example.com/student_{id}"', column("foaf:name", "name"), JOIN) + triples_map("sport", 'rr:template "http://example.com/sport_{id}"', column("foaf:name", "name"), name="B"), FULL, set()),
    "unmapped table": (SPORTS, triples_map("sport", 'rr:template "http://example.com/sport_{id}"', column("foaf:name", "name")), PART, {TABLES}),
    "many to many": (
        MANY,
        triples_map("student", 'rr:template "http://example.com/student/{id}"', column("ex:first", "first"))
        + triples_map("sport", 'rr:template "http://example.com/sport/{id}"', column("ex:title", "title"), name="B")
        + triples_map("student_sport", 'rr:template "http://example.com/student/{id_student}"', 'rr:predicate ex:plays ; rr:objectMap [ rr:template "http://example.com/sport/{id_sport}" ]', name="C"),
        FULL,
        set(),
    ),
    "delimited names with spaces": ([("country", "`Country Code` int, Name string, `ISO 3166` string", [(1, "Bolivia", "BO")])], triples_map("country", 'rr:template "http://example.com/{\\"Country Code\\"}"', column("ex:name", '\\"Name\\"')), PART, {COLUMNS}),
    "blank node of adjacent columns": ([IOUS], triples_map("ious", 'rr:template "{fname}{lname}{amount}" ; rr:termType rr:BlankNode', column("foaf:first", "fname"), column("foaf:last", "lname"), column("ex:amount", "amount")), PART, {MULTIPLICITY}),
    "null in the subject": ([PEOPLE], triples_map("person", 'rr:template "http://example.com/Person/{id}/{name}/{born}"', column("ex:BirthDay", "born")), PART, {ROWS}),
    "languages by query": (
        [COUNTRY],
        "".join(triples_map(f"SELECT code, name, lan FROM country WHERE lan = '{lan.upper()}'", 'rr:template "http://example.com/{code}"', column("ex:label", "name", f' ; rr:language "{lan}"'), name=lan, query=True) for lan in ("en", "es")),
        PART,
        {COLUMNS},
    ),
    "subject of a column": ([("employee", "id int, first string, last string", [(10, "http://example.com/ns#Jhon", "Smith")])], triples_map("employee", 'rr:column "first"', column("foaf:name", "first")), PART, {COLUMNS}),
    "constants only": ([STUDENT], triples_map("student", "rr:constant ex:BadStudent", "rr:predicate ex:description ; rr:object \"Bad Student\""), NONE, set()),
    "opaque subject only": ([("student", "name string", [("http://example.com/Danny",)])], triples_map("student", 'rr:column "name" ; rr:class foaf:Person'), NONE, set()),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    data, text, outcome, losses = CASES[name]
    tables = {t: spark.createDataFrame(rows, schema) for t, schema, rows in data}

    def run():
        mapping = parse_mapping(HEAD + text)
        catalog = Catalog(spark, tables)
        whole = catalog.with_queries(mapping.queries)
        graph = Graph(graph_of(mapping, whole))
        found = reconstruct_tables(spark, mapping, graph, catalog)
        source = {q: whole[q] for q in mapping.queries} or tables
        return compare_databases(source, found, analyze_mapping(spark, mapping, graph, catalog))

    found = classify(run)
    assert (found.outcome, set(found.losses)) == (outcome, losses), found.message

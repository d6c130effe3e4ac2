"""Mapping documents: Turtle, validation, normalised rules."""

import pytest

from relift.errors import MappingError, NonInvertibleError, UnsupportedMappingError
from relift.plans.mapping import folded, parse_mapping, undelimited
from relift.plans.rules import BNODE, CONSTANT, IRI, LITERAL, PARENT, REFERENCE, TEMPLATE, TermMap
from relift.sources.turtle import parse

HEAD = "@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://e/> . @prefix d2rq: <http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#> .\n"
TABLE = 'rr:logicalTable [ rr:tableName "t" ]'
SUBJECT = 'rr:subjectMap [ rr:template "http://e/{id}" ]'


def test_turtle():
    found = parse("""PREFIX : <http://e/>
@base <http://b/x/> .
:a a :T , <rel> ; :p "x\\n\\u00e9"@en-GB, '''long "q" text''', 5, -1.5, 2e3, true ; .
_:b :q [ :r ( 1 :c ) ; ] . # comment
[ :s "y"^^:dt ] .
:e.f-1 :p\\,q %41 .
""".replace("%41", ":x%41"))
    assert ("iri", "http://e/a") == found[0][0] and found[1][2] == ("iri", "http://b/x/rel")
    literals = [o[1:3] for _, _, o in found if o[0] == "lit"]
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert literals[0][0] == "x\né" and ('long "q" text', xsd + "string") in literals and ("5", xsd + "integer") in literals
    assert ("-1.5", xsd + "decimal") in literals and ("2e3", xsd + "double") in literals and ("y", "http://e/dt") in literals
    assert found[-1] == (("iri", "http://e/e.f-1"), ("iri", "http://e/p,q"), ("iri", "http://e/x%41"))


@pytest.mark.parametrize("text", ["<a> <b>", '"x" <b> <c> .', "p:a <b> <c> .", "<a> _:b <c> .", "<a> <b> <c> <d> .", "<a> <b> [ <c> <d> .", "<a> <b> %"])
def test_malformed_turtle(text):
    with pytest.raises(SyntaxError):
        parse(text)


def test_expansion():
    found = parse_mapping(HEAD + f"""<#A> {TABLE} ; rr:subjectMap [ rr:template "http://e/{{id}}" ; rr:class ex:C ; rr:graph ex:g ] ;
 rr:predicateObjectMap [ rr:predicate ex:p, ex:q ; rr:object "x"@en ; rr:objectMap [ rr:column "a" ; rr:datatype ex:dt ] ; rr:graphMap [ rr:template "http://g/{{b}}" ] ] .""")
    assert len(found.rules) == 1 + 2 * 2 * 2
    assert found.rules[0].predicate.value.endswith("#type") and found.rules[0].graph == TermMap(CONSTANT, "http://e/g")
    assert {r.object for r in found.rules[1:]} == {TermMap(CONSTANT, "x", LITERAL, None, "en"), TermMap(REFERENCE, "a", LITERAL, "http://e/dt")}
    assert found.reads == {"t": frozenset({"id", "a", "b"})}


def test_term_types():
    found = parse_mapping(HEAD + f"""<#A> {TABLE} ; rr:subjectMap [ rr:column "id" ; rr:termType rr:BlankNode ] ;
 rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:template "a{{x}}" ], [ rr:template "a{{y}}" ; rr:termType rr:Literal ], [ rr:template "a{{z}}" ; rr:language "en" ], [ rr:column "w" ; rr:termType rr:IRI ], [ rr:constant ex:c ] ] .""")
    assert found.rules[0].subject == TermMap(REFERENCE, "id", BNODE)
    assert [r.object.term for r in found.rules] == [IRI, LITERAL, LITERAL, IRI, IRI] or {(r.object.kind, r.object.term) for r in found.rules} == {(TEMPLATE, IRI), (TEMPLATE, LITERAL), (REFERENCE, IRI), (CONSTANT, IRI)}


def test_joins_and_queries():
    found = parse_mapping(HEAD + """<#A> rr:logicalTable [ rr:sqlQuery "SELECT 2 ; " ] ; rr:subjectMap [ rr:template "http://e/{id}" ] ;
 rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:parentTriplesMap <#B> ; rr:joinCondition [ rr:child "x" ; rr:parent "y" ], [ rr:child "v" ; rr:parent "w" ] ] ] ;
 rr:predicateObjectMap [ rr:predicate ex:q ; rr:objectMap [ rr:parentTriplesMap <#B> ] ] .
<#B> rr:logicalTable [ rr:sqlQuery "SELECT 1" ] ; rr:subjectMap [ rr:template "http://e/{y}/{w}" ] .""")
    assert {q.name: q.sql for q in found.queries.values()} == {"query_1": "SELECT 1", "query_2": "SELECT 2"}
    parent = next(r.object for r in found.rules if r.object and r.object.kind == PARENT)
    assert set(parent.joins) == {("x", "y"), ("v", "w")} and parent.value == "#B"
    assert any(r.object and r.object.value == "http://e/{y}/{w}" for r in found.rules)
    assert [r.source for r in found.rules if r.object is None] == ["query_1"]
    assert found.reads["query_2"] == {"id", "x", "v"}


def test_identifiers():
    assert folded("ID") == "id" and folded('"ID"') == "ID" and undelimited("`a b`") == "a b" and undelimited("[x]") == "x"
    rr = parse_mapping(HEAD + f'<#A> {TABLE} ; rr:subjectMap [ rr:template "http://e/{{ID}}/{{\\"Key\\"}}" ] ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:column "NAME" ] ] .')
    assert rr.rules[0].subject.references == ("id", "Key") and rr.rules[0].object.value == "name"
    rml = parse_mapping(HEAD + '<#A> rml:logicalSource [ rml:iterator "T" ; rml:referenceFormulation rml:SQL2008Table ] ; rml:subjectMap [ rml:template "http://e/{ID}" ] ; rml:predicateObjectMap [ rml:predicate ex:p ; rml:objectMap [ rml:reference "NAME" ] ] .')
    assert rml.rules[0].subject.references == ("ID",) and rml.rules[0].object.value == "NAME" and rml.sources == ["t"]
    query = parse_mapping(HEAD + '<#A> rml:logicalSource [ rml:iterator "SELECT 1;" ; rml:referenceFormulation rml:SQL2008Query ] ; rml:subjectMap [ rml:template "http://e/{ID}" ] ; rml:predicateObjectMap [ rml:predicate ex:p ; rml:objectMap [ rml:constant ex:c ] ] .')
    assert query.queries["query_1"].sql == "SELECT 1"


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (f'<#A> {TABLE} ; rr:subjectMap [ rr:template "x{{id}}" ; rr:termType rr:Literal ; rr:class ex:C ] .', MappingError),
        (f"<#A> {TABLE} ; {SUBJECT} ; rr:subjectMap [ rr:column \"x\" ; rr:class ex:C ] .", MappingError),
        (f"<#A> {TABLE} ; {SUBJECT} .", NonInvertibleError),
        (f"<#A> {TABLE} ; rr:subject ex:s ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:object ex:o ] .", NonInvertibleError),
        (f"<#A> {TABLE} ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:object ex:o ] .", MappingError),
        ('<#A> rml:logicalSource [ rml:source "f.csv" ; rml:referenceFormulation <http://semweb.mmlab.be/ns/ql#CSV> ] ; rml:subjectMap [ rml:template "http://e/{id}" ; rml:class ex:C ] .', UnsupportedMappingError),
        ('<#A> rml:logicalSource [ rml:source "f" ] ; rml:subjectMap [ rml:template "http://e/{id}" ; rml:class ex:C ] .', UnsupportedMappingError),
        (f"<#A> {TABLE} ; {SUBJECT} ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ ] ] .", UnsupportedMappingError),
        (f"<#A> {TABLE} ; {SUBJECT} ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:parentTriplesMap <#Z> ] ] .", MappingError),
    ],
)
def test_refused(text, error):
    with pytest.raises(error):
        parse_mapping(HEAD + text)


def test_connection():
    text = HEAD + f'<#D> a d2rq:Database ; d2rq:jdbcDSN "jdbc:postgresql://h:5432/db" ; d2rq:username "u" ; d2rq:password "p" .\n<#A> {TABLE} ; rr:subjectMap [ rr:template "http://e/{{id}}" ; rr:class ex:C ] .'
    assert parse_mapping(text).connection == {"url": "jdbc:postgresql://h:5432/db", "user": "u", "password": "p"}
    with pytest.raises(ValueError):
        parse_mapping(text.replace("jdbc:postgresql:", "postgresql:"))

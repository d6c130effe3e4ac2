"""Rules and graphs by hand, as small as a case allows."""

from relift.functions.terms import QUAD
from relift.functions.vocabulary import XSD_STRING
from relift.plans.rules import CONSTANT, IRI, LITERAL, PARENT, REFERENCE, TEMPLATE, Mapping, Rule, TermMap

EX = "http://example.com/"


def term_map(value, term=IRI, kind=None, **more):
    kind = kind or (TEMPLATE if "{" in value else CONSTANT)
    return TermMap(kind, value, term, **more)


def ref(name, term=LITERAL, **more):
    return TermMap(REFERENCE, name, term, **more)


def rule(subject="{S}", obj="p1", predicate=EX + "p1", source="data", graph=None, triples_map=None):
    """Subject a column of the usual template (or a term map), object a column's literal (or a term map)."""
    s = subject if isinstance(subject, TermMap) else TermMap(TEMPLATE, EX + "table/{" + subject + "}")
    o = obj if isinstance(obj, TermMap) or obj is None else ref(obj)
    p = None if obj is None else predicate if isinstance(predicate, TermMap) else term_map(predicate)
    g = None if graph is None else graph if isinstance(graph, TermMap) else term_map(graph)
    return Rule(source, triples_map or f"#{source}-{s.value}", s, p, o, g)


def join(parent, child, parent_column):
    return TermMap(PARENT, parent, joins=((child, parent_column),))


def mapping(*rules):
    return Mapping(list(rules))


def lit(value, dt=XSD_STRING, lang=""):
    return ("lit", value, dt, lang)


def iri(value):
    return ("iri", value, "", "")


def quads(spark, rows):
    """Rows of (s, p, o) or (s, p, o, g); s and p get the usual prefix unless they are whole."""
    whole = lambda x: x if ":" in x else EX + x
    return spark.createDataFrame([(whole(r[0]), whole(r[1]), r[2], r[3] if len(r) > 3 else "") for r in rows], QUAD)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

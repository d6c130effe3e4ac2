"""The forward mapping: tables to quads, as the mapping language defines it.

A NULL in any column that a term needs makes no statement.  Values in IRIs and blank node labels are
percent-encoded; literals get the natural datatype of their column.  ``graph_of`` is a union of one
projection a rule, so that a filter on a constant predicate leaves only the rules that can match;
``statements_of`` reads each source once and explodes all its statements, for writing graphs out.
"""

from __future__ import annotations

from collections.abc import Mapping as Tables
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MappingError
from ..functions.terms import iri, literal, natural
from ..functions.text import encode_for_uri
from ..functions.vocabulary import BNODE
from ..plans.rules import BNODE as BNODE_TERM
from ..plans.rules import CONSTANT, LITERAL, PARENT, REFERENCE, Mapping, Rule, TermMap

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _column(df: DataFrame, name: str) -> tuple[Column, object]:
    found = next((f for f in df.schema.fields if f.name == name), None) or next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)
    if found is None:
        raise MappingError(f"no column named {name}")
    return df[f"`{found.name}`"], found.dataType


def lexical(df: DataFrame, name: str) -> Column:
    return natural(*_column(df, name))[0]


def resource(df: DataFrame, found: TermMap, base: str = "") -> Column:
    """The IRI (or blank node as an IRI) that a term map builds for a row."""
    if found.kind == CONSTANT:
        return F.lit(found.value)
    if found.kind == REFERENCE:
        value = lexical(df, found.value)
        if found.term == BNODE_TERM:
            return F.concat(F.lit(BNODE), value)
        return F.when(value.rlike(_ABSOLUTE), value).otherwise(F.concat(F.lit(base), value))
    parts = found.template
    pieces = [F.lit(parts.literals[0])]
    for reference, after in zip(parts.references, parts.literals[1:], strict=True):
        pieces += [encode_for_uri(lexical(df, reference)), F.lit(after)]
    return F.concat(*([F.lit(BNODE)] if found.term == BNODE_TERM else []), *pieces)


def object_term(df: DataFrame, found: TermMap, base: str = "") -> Column:
    if found.term != LITERAL:
        return iri(resource(df, found, base))
    if found.kind == CONSTANT:
        return literal(F.lit(found.value), found.datatype, found.language)
    if found.kind == REFERENCE:
        value, datatype = natural(*_column(df, found.value))
        return literal(value, found.datatype or datatype, found.language)
    parts = found.template
    pieces = [F.lit(parts.literals[0])]
    for reference, after in zip(parts.references, parts.literals[1:], strict=True):
        pieces += [lexical(df, reference), F.lit(after)]
    return literal(F.concat(*pieces), found.datatype, found.language)


def _quad(df: DataFrame, rule: Rule, base: str) -> Column:
    graph = resource(df, rule.graph, base) if rule.graph else F.lit("")
    return F.struct(resource(df, rule.subject, base).alias("s"), resource(df, rule.predicate, base).alias("p"), object_term(df, rule.object, base).alias("o"), graph.alias("g"))


def _joined(mapping: Mapping, tables: Tables[str, DataFrame], rule: Rule, base: str) -> DataFrame:
    parent = mapping.subject_of(rule.object.value)
    child, other = tables[rule.source], tables[parent.source]
    left = child.select(resource(child, rule.subject, base).alias("s"), resource(child, rule.predicate, base).alias("p"), (resource(child, rule.graph, base) if rule.graph else F.lit("")).alias("g"), *(lexical(child, c).alias(f"j{i}") for i, (c, _) in enumerate(rule.object.joins)))
    right = other.select(iri(resource(other, parent.subject, base)).alias("o"), *(lexical(other, p).alias(f"j{i}") for i, (_, p) in enumerate(rule.object.joins)))
    return left.join(right, [f"j{i}" for i in range(len(rule.object.joins))]).select("s", "p", "o", "g")


def _complete(quads: DataFrame) -> DataFrame:
    return quads.where("s IS NOT NULL AND p IS NOT NULL AND o.value IS NOT NULL AND g IS NOT NULL")


def graph_of(mapping: Mapping, tables: Tables[str, DataFrame], base: str = "") -> DataFrame:
    """All quads, repeated ones included (a graph reads them as a set)."""
    parts = []
    for rule in mapping.rules:
        if rule.predicate is None or rule.object is None:
            continue
        if rule.object.kind == PARENT:
            parts.append(_complete(_joined(mapping, tables, rule, base)))
        else:
            df = tables[rule.source]
            parts.append(_complete(df.select(_quad(df, rule, base).alias("q")).select("q.*")))
    if not parts:
        raise MappingError("the mapping makes no statements")
    return reduce(DataFrame.unionByName, parts)


def statements_of(mapping: Mapping, tables: Tables[str, DataFrame], base: str = "") -> DataFrame:
    """The same quads as a set, each source read once and joins apart."""
    parts = []
    for source in mapping.sources:
        df = tables[source]
        own = [_quad(df, r, base) for r in mapping.rules_of(source) if r.object is not None and r.object.kind != PARENT]
        if own:
            parts.append(_complete(df.select(F.explode(F.array(*own)).alias("q")).select("q.*")))
    parts += [_complete(_joined(mapping, tables, r, base)) for r in mapping.rules if r.object is not None and r.object.kind == PARENT]
    return reduce(DataFrame.unionByName, parts).distinct()



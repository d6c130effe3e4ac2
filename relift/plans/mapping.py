"""Mapping documents: R2RML and RML in Turtle, checked and normalised into rules."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

from ..errors import MappingError, NonInvertibleError, UnsupportedMappingError
from ..functions.vocabulary import D2RQ, NAMESPACES, RDF_TYPE, RR
from ..sources.turtle import Node, parse
from .rules import BNODE, CONSTANT, IRI, LITERAL, PARENT, REFERENCE, TEMPLATE, LogicalQuery, Mapping, Rule, Template, TermMap, query_text

_TERM_TYPES = {"IRI": IRI, "BlankNode": BNODE, "Literal": LITERAL, "URI": IRI}
#: Reference formulations that name relational sources; an old-style SQL2008 counts as a table.
_RELATIONAL = {"SQL2008Table", "SQL2008Query", "SQL2008"}


def undelimited(identifier: str) -> str:
    """A SQL identifier without its delimiters."""
    found = re.fullmatch(r'"(.*)"|`(.*)`|\[(.*)\]', identifier.strip(), re.DOTALL)
    return next(g for g in found.groups() if g is not None) if found else identifier.strip()


def folded(identifier: str) -> str:
    """As SQL reads it: without delimiters, and in lower case if it has none."""
    plain = undelimited(identifier)
    return plain if plain != identifier.strip() else plain.lower()


class Document:
    """A mapping's triples by subject; properties are found under every vocabulary's namespace."""

    def __init__(self, text: str):
        self.by: dict[Node, list[tuple[str, Node]]] = defaultdict(list)
        self.triples = parse(text)
        for s, p, o in self.triples:
            self.by[s].append((p[1], o))

    def all(self, node: Node, *names: str) -> list[Node]:
        wanted = {ns + name for ns in NAMESPACES for name in names}
        return [o for p, o in self.by.get(node, []) if p in wanted]

    def one(self, node: Node, *names: str) -> Node | None:
        found = self.all(node, *names)
        return found[0] if found else None

    def text(self, node: Node, *names: str) -> str | None:
        found = self.one(node, *names)
        return found[1] if found else None

    def subjects(self, *names: str) -> list[Node]:
        wanted = {ns + name for ns in NAMESPACES for name in names}
        return list(dict.fromkeys(s for s, p, _ in self.triples if p[1] in wanted))

    def objects(self, *names: str) -> list[Node]:
        return [o for s in list(self.by) for o in self.all(s, *names)]

    @property
    def triples_maps(self) -> list[Node]:
        return self.subjects("logicalTable", "logicalSource")

    def is_r2rml(self, triples_map: Node) -> bool:
        return any(p == RR + "logicalTable" for p, _ in self.by[triples_map])


def connection(document: Document) -> dict[str, str] | None:
    """Options of the database that the mapping names, for the JDBC reader."""
    nodes = [s for s, p, o in document.triples if p[1] == RDF_TYPE and o == ("iri", D2RQ + "Database")]
    if not nodes:
        return None
    own = {p: o[1] for p, o in document.by[nodes[0]]}
    url = own.get(D2RQ + "jdbcDSN", "")
    if not re.fullmatch(r"jdbc:(postgresql|mysql)://.+", url):
        raise ValueError(f"Invalid JDBC DSN: {url}")
    return {"url": url, "user": own.get(D2RQ + "username", ""), "password": own.get(D2RQ + "password", "")}


def check(document: Document) -> None:
    """What makes a document invalid, unsupported or hopeless before any rule is made."""
    for subject_map in document.objects("subjectMap"):
        if any(t[1].rpartition("#")[2].rpartition("/")[2] == "Literal" for t in document.all(subject_map, "termType")):
            raise MappingError("A subject map cannot have term type Literal")
    for formulation in document.objects("referenceFormulation"):
        if re.split(r"[#/]", formulation[1])[-1] not in _RELATIONAL:
            raise UnsupportedMappingError(f"Unsupported reference formulation: {formulation[1]}")
    targets = set(document.objects("parentTriplesMap"))
    for node in document.triples_maps:
        if len(document.all(node, "subjectMap")) + len(document.all(node, "subject")) > 1:
            raise MappingError(f"Triples map '{node[1]}' has more than one subject map")
        classes = [c for m in document.all(node, "subjectMap") for c in document.all(m, "class")]
        if not document.all(node, "predicateObjectMap") and not classes and node not in targets:
            raise NonInvertibleError(f"Triples map '{node[1]}' generates no triples and no join references it")


def _source(document: Document, triples_map: Node) -> tuple[str, str]:
    """('table', name) or ('query', text)."""
    at = document.one(triples_map, "logicalTable", "logicalSource")
    if at is None or at not in document.by:
        raise MappingError(f"Triples map '{triples_map[1]}' has no logical table")
    query = document.text(at, "sqlQuery", "query")
    if query is not None:
        return "query", query_text(query)
    name = document.text(at, "tableName")
    if name is None:
        name = document.text(at, "iterator")
        formulations = [re.split(r"[#/]", f[1])[-1] for f in document.all(at, "referenceFormulation")]
        if name is None:
            raise UnsupportedMappingError("A logical source must be a table or a query")
        if "SQL2008Query" in formulations:
            return "query", query_text(name)
    return "table", folded(name)


class Normaliser:
    def __init__(self, document: Document, case_sensitive: bool):
        self.document, self.exact = document, case_sensitive
        self.sources = {node: _source(document, node) for node in document.triples_maps}
        texts = sorted({text for kind, text in self.sources.values() if kind == "query"})
        self.queries = {text: LogicalQuery(f"query_{i}", text) for i, text in enumerate(texts, 1)}

    def name(self, node: Node) -> str:
        kind, text = self.sources[node]
        return self.queries[text].name if kind == "query" else text

    def column(self, node: Node, text: str) -> str:
        """How the mapping language resolves a reference: R2RML folds what has no delimiters."""
        return folded(text) if self.document.is_r2rml(node) and not self.exact else undelimited(text)

    def template(self, node: Node, text: str) -> str:
        parsed = Template.parse(text)
        quote = lambda x: re.sub(r"([\\{}])", r"\\\1", x)
        out = quote(parsed.literals[0])
        for reference, after in zip(parsed.references, parsed.literals[1:], strict=True):
            out += "{" + quote(self.column(node, reference)) + "}" + quote(after)
        return out

    def term_map(self, node: Node, at: Node, position: str) -> TermMap:
        document = self.document
        language, datatype = document.text(at, "language"), document.text(at, "datatype")
        for name, current in (("languageMap", language), ("datatypeMap", datatype)):
            inner = document.one(at, name)
            if inner is not None and current is None:
                value = document.text(inner, "constant")
                if value is None:
                    raise UnsupportedMappingError(f"Only constant {name}s are supported")
                language, datatype = (value, datatype) if name == "languageMap" else (language, value)
        kind = document.text(at, "termType")
        kind = _TERM_TYPES.get(re.split(r"[#/]", kind)[-1]) if kind else None
        constant = document.one(at, "constant")
        if constant is not None:
            return self.constant(constant)
        column = document.text(at, "column", "reference")
        if column is not None:
            default = LITERAL if position == "object" else IRI
            return TermMap(REFERENCE, self.column(node, column), kind or default, datatype, language)
        text = document.text(at, "template")
        if text is not None:
            default = LITERAL if position == "object" and (language or datatype) else IRI
            return TermMap(TEMPLATE, self.template(node, text), kind or default, datatype, language)
        raise UnsupportedMappingError(f"Unsupported {position} map type")

    @staticmethod
    def constant(node: Node) -> TermMap:
        if node[0] == "lit":
            return TermMap(CONSTANT, node[1], LITERAL, None if node[3] else node[2], node[3])
        return TermMap(CONSTANT, node[1], IRI if node[0] == "iri" else BNODE)

    def maps(self, node: Node, at: Node, shortcut: str, position: str | None = None) -> list[TermMap]:
        position = position or shortcut
        return [self.constant(c) for c in self.document.all(at, shortcut)] + [self.term_map(node, m, position) for m in self.document.all(at, f"{shortcut}Map") if not self.document.all(m, "parentTriplesMap")]

    def parents(self, node: Node, at: Node) -> list[TermMap]:
        out = []
        for found in self.document.all(at, "objectMap"):
            target = self.document.one(found, "parentTriplesMap")
            if target is None:
                continue
            if target not in self.sources:
                raise MappingError(f"No triples map '{target[1]}' to join")
            joins = []
            for condition in self.document.all(found, "joinCondition"):
                child, parent = self.document.text(condition, "child"), self.document.text(condition, "parent")
                if child is None or parent is None:
                    raise MappingError("A join condition needs a child and a parent")
                joins.append((self.column(node, child), self.column(target, parent)))
            if joins:
                out.append(TermMap(PARENT, target[1], joins=tuple(joins)))
            else:  # the parent's subjects, read from the child's own row
                subject = self.subject(target)
                out.append(subject)
        return out

    def subject(self, node: Node) -> TermMap:
        found = self.maps(node, node, "subject")
        if not found:
            raise MappingError(f"Triples map '{node[1]}' has no subject map")
        return found[0]

    def rules(self) -> list[Rule]:
        document, out = self.document, []
        for node in document.triples_maps:
            subject, source = self.subject(node), self.name(node)
            own_graphs, classes = [], []
            for at in document.all(node, "subjectMap"):
                own_graphs += self.maps(node, at, "graph")
                classes += [self.constant(c) for c in document.all(at, "class")]
            statements: list[tuple[TermMap, TermMap, list[TermMap]]] = [(TermMap(CONSTANT, RDF_TYPE), c, own_graphs) for c in classes]
            for at in document.all(node, "predicateObjectMap"):
                objects = self.maps(node, at, "object") + self.parents(node, at)
                graphs = own_graphs + self.maps(node, at, "graph")
                statements += [(p, o, graphs) for p in self.maps(node, at, "predicate") for o in objects]
            if not statements:
                out.append(Rule(source, node[1], subject))
            out += [Rule(source, node[1], subject, p, o, g) for p, o, graphs in statements for g in (graphs or [None])]
        return list(dict.fromkeys(out))

    def reads(self) -> dict[str, frozenset[str]]:
        """Columns that the mapping names, by source: a walk that does not cross into parent triples maps."""
        found: dict[str, set[str]] = defaultdict(set)
        for node in self.sources:
            seen, pending = {node}, [node]
            while pending:
                at = pending.pop()
                for p, o in self.document.by[at]:
                    name = re.split(r"[#/]", p)[-1]
                    if name == "parentTriplesMap":
                        continue
                    if o[0] != "lit":
                        if o not in seen and o in self.document.by:
                            seen.add(o)
                            pending.append(o)
                    elif name == "template":
                        found[self.name(node)] |= {self.column(node, r) for r in Template.parse(o[1]).references}
                    elif name in ("column", "reference", "child"):
                        found[self.name(node)].add(self.column(node, o[1]))
        return {k: frozenset(v) for k, v in found.items()}


def parse_mapping(text: str, case_sensitive: bool = False) -> Mapping:
    """The normalised mapping of a Turtle document; ``case_sensitive`` takes identifiers as they are written."""
    document = Document(text)
    check(document)
    made = Normaliser(document, case_sensitive)
    rules = made.rules()
    if not rules:
        return Mapping([])
    kinds = {m.kind for r in rules for m in (r.subject, r.predicate, r.object) if m}
    if not kinds & {REFERENCE, TEMPLATE}:
        raise NonInvertibleError("The mapping has constant terms only")
    return Mapping(rules, {q.name: q for q in made.queries.values()}, connection(document), made.reads())


def read_mapping(path: str, case_sensitive: bool = False) -> Mapping:
    return parse_mapping(Path(path).read_text(encoding="utf-8"), case_sensitive)



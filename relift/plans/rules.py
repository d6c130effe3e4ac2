"""Normalised mapping rules: one for each combination of subject, predicate, object and graph map."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from ..errors import UnsupportedMappingError

CONSTANT, REFERENCE, TEMPLATE, PARENT = "constant", "reference", "template", "parent"
IRI, BNODE, LITERAL = "iri", "bnode", "literal"
POSITIONS = ("subject", "predicate", "object", "graph")
_PARTS = re.compile(r"\\([\\{}])|\{((?:[^{}\\]|\\.)*)\}|([^\\{}]+|.)")


@dataclass(frozen=True)
class Template:
    """A template's literal parts around its references; there is one part more than references."""

    literals: tuple[str, ...]
    references: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> Template:
        literals, references = [""], []
        for escaped, reference, plain in _PARTS.findall(text):
            if reference:
                references.append(re.sub(r"\\(.)", r"\1", reference))
                literals.append("")
            else:
                literals[-1] += escaped or plain
        return cls(tuple(literals), tuple(references))

    @property
    def adjacent(self) -> bool:
        """Whether two references have nothing between them."""
        return any(part == "" for part in self.literals[1:-1])

    @property
    def bare(self) -> bool:
        """Whether the template is one reference and nothing else."""
        return self.literals == ("", "")

    def pattern(self, capture: str = "([^/]*)") -> str:
        """An anchored regular expression, literal parts quoted."""
        quoted = ["\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E" if part else "" for part in self.literals]
        return "(?s)^" + capture.join(quoted) + "$"


@dataclass(frozen=True)
class TermMap:
    kind: str
    value: str
    term: str = IRI
    datatype: str | None = None
    language: str | None = None
    #: Of a parent: (child column, parent column) pairs.
    joins: tuple[tuple[str, str], ...] = ()

    @cached_property
    def template(self) -> Template | None:
        return Template.parse(self.value) if self.kind == TEMPLATE else None

    @property
    def references(self) -> tuple[str, ...]:
        """Columns in order; a parent map reads the child columns of its joins."""
        if self.kind == REFERENCE:
            return (self.value,)
        if self.kind == TEMPLATE:
            return self.template.references
        if self.kind == PARENT:
            return tuple(dict.fromkeys(child for child, _ in self.joins))
        return ()

    @property
    def shape(self) -> tuple[str, ...] | None:
        """What two templates have in common if the terms they build cannot be told apart."""
        return self.template.literals if self.template else None

    @property
    def opaque(self) -> bool:
        """Whether the columns cannot be read back from the terms that the map builds."""
        if self.kind == REFERENCE:
            return self.term == IRI
        if self.kind != TEMPLATE:
            return False
        return self.template.adjacent or (self.term == IRI and self.template.bare)


@dataclass(frozen=True)
class Rule:
    """``source`` is a table's name, or a query's; a rule without predicate and object names only subjects."""

    source: str
    triples_map: str
    subject: TermMap
    predicate: TermMap | None = None
    object: TermMap | None = None
    graph: TermMap | None = None
    parent_source: str | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.subject.kind not in (CONSTANT, REFERENCE, TEMPLATE):
            raise UnsupportedMappingError(f"Unsupported subject map type: {self.subject.kind}")
        for position in ("predicate", "graph"):
            found = self.at(position)
            if found and found.kind not in (CONSTANT, REFERENCE, TEMPLATE):
                raise UnsupportedMappingError(f"Unsupported {position} map type: {found.kind}")
        if self.object and self.object.kind not in (CONSTANT, REFERENCE, TEMPLATE, PARENT):
            raise UnsupportedMappingError(f"Unsupported object map type: {self.object.kind}")

    def at(self, position: str) -> TermMap | None:
        return getattr(self, position)

    def references_at(self, position: str) -> frozenset[str]:
        found = self.at(position)
        return frozenset(found.references) if found else frozenset()

    @property
    def references(self) -> frozenset[str]:
        return frozenset().union(*(self.references_at(p) for p in POSITIONS))

    def exposed_at(self, *positions: str) -> frozenset[str]:
        """Columns of the term maps there that can be read back."""
        maps = [m for p in positions if (m := self.at(p)) and not self._opaque(p, m)]
        return frozenset().union(*(m.references for m in maps))

    def opaque_at(self, *positions: str) -> frozenset[str]:
        maps = [m for p in positions if (m := self.at(p)) and self._opaque(p, m)]
        return frozenset().union(*(m.references for m in maps))

    @staticmethod
    def _opaque(position: str, found: TermMap) -> bool:
        if position == "graph":  # a graph map has no term type: only adjacency hides its columns
            return found.kind == TEMPLATE and found.template.adjacent
        return found.opaque

    @property
    def subject_signature(self) -> tuple[str, str, str]:
        return (self.subject.kind, self.subject.value, self.subject.term)


@dataclass(frozen=True)
class LogicalQuery:
    """A logical table that is a query's result."""

    name: str
    sql: str


def query_text(sql: str) -> str:
    """A query's text without white space and semicolons around it."""
    return sql.strip().strip(";").strip()


@dataclass
class Mapping:
    """All rules of a mapping document, with its queries and its database connection, if it names one."""

    rules: list[Rule]
    queries: dict[str, LogicalQuery] = field(default_factory=dict)
    connection: dict[str, str] | None = None
    #: Columns that the mapping reads, by source, as written.
    reads: dict[str, frozenset[str]] = field(default_factory=dict)
    #: Whether SQL identifiers without delimiters are folded to lower case, by source.
    folded: dict[str, bool] = field(default_factory=dict)

    @property
    def sources(self) -> list[str]:
        return sorted({rule.source for rule in self.rules})

    def rules_of(self, source: str) -> list[Rule]:
        return [rule for rule in self.rules if rule.source == source]

    def subject_of(self, triples_map: str) -> Rule:
        found = next((rule for rule in self.rules if rule.triples_map == triples_map), None)
        if found is None:
            raise UnsupportedMappingError(f"No triples map '{triples_map}' to join")
        return found

"""A Turtle reader for mapping documents, by the W3C grammar; small files, on the driver.

Nodes are tuples: ('iri', value), ('bnode', label) or ('lit', value, datatype, language).
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from ..functions.vocabulary import LANG_STRING, RDF, RDF_TYPE, XSD, XSD_STRING

Node = tuple
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n\r]*)
    |(?P<long>\"\"\"(?:\"{0,2}(?:[^\"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
    |(?P<string>\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<types>\^\^)
    |(?P<bnode>_:[^\W_](?:[\w.-]*[\w-])?|_:[\w](?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(found: re.Match) -> str:
        code = found[1]
        if len(code) > 1:
            return chr(int(code[1:], 16))
        if code not in _CHARS:
            raise SyntaxError(f"unknown escape \\{code}")
        return _CHARS[code]

    return _ESCAPE.sub(one, text)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise SyntaxError(f"malformed Turtle at {text[at : at + 40]!r}")
        if found.lastgroup != "space":
            out.append((found.lastgroup, found[0]))
        at = found.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str, base: str):
        self.tokens, self.at, self.base = _tokens(text), 0, base
        self.prefixes: dict[str, str] = {}
        self.triples: list[tuple[Node, Node, Node]] = []
        self.blanks = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, value: str | None = None) -> str:
        kind, found = self.tokens[self.at]
        if value is not None and found != value or kind == "end":
            raise SyntaxError(f"expected {value or 'more'}, found {found or 'the end'}")
        self.at += 1
        return found

    def blank(self) -> Node:
        self.blanks += 1
        return ("bnode", f"b{self.blanks}x")

    def iri(self, text: str) -> str:
        found = _unescape(text[1:-1])
        return found if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", found) else urljoin(self.base, found) if self.base else found

    def named(self, text: str) -> str:
        prefix, local = text.split(":", 1)
        if prefix not in self.prefixes:
            raise SyntaxError(f"unknown prefix {prefix}:")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def document(self) -> None:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lower()
            if kind == "lang" and word in ("@prefix", "@base") or kind == "word" and word in ("prefix", "base"):
                self.take()
                if word.endswith("prefix"):
                    name = self.take()
                    self.prefixes[name[:-1]] = self.iri(self.take())
                else:
                    self.base = self.iri(self.take())
                if word.startswith("@"):
                    self.take(".")
                continue
            if text == "[":
                subject = self.node()
                if self.peek()[1] != ".":
                    self.statements(subject)
            else:
                subject = self.node()
                if subject[0] == "lit":
                    raise SyntaxError("a literal cannot be a subject")
                self.statements(subject)
            self.take(".")

    def statements(self, subject: Node) -> None:
        while True:
            kind, text = self.peek()
            if kind == "word" and text == "a":
                self.take()
                predicate = ("iri", RDF_TYPE)
            else:
                predicate = self.node()
                if predicate[0] != "iri":
                    raise SyntaxError("a predicate must be an IRI")
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]"):
                return

    def node(self) -> Node:
        kind, text = self.peek()
        self.take()
        if kind == "iri":
            return ("iri", self.iri(text))
        if kind == "name":
            return ("iri", self.named(text))
        if kind == "bnode":
            return ("bnode", text[2:])
        if kind in ("string", "long"):
            width = 3 if kind == "long" else 1
            value = _unescape(text[width:-width])
            after, found = self.peek()
            if after == "lang":
                self.take()
                return ("lit", value, LANG_STRING, found[1:])
            if after == "types":
                self.take()
                datatype = self.node()
                return ("lit", value, datatype[1], None)
            return ("lit", value, XSD_STRING, None)
        if kind == "number":
            datatype = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return ("lit", text, XSD + datatype, None)
        if kind == "word" and text in ("true", "false"):
            return ("lit", text, XSD + "boolean", None)
        if text == "[":
            found = self.blank()
            if self.peek()[1] != "]":
                self.statements(found)
            self.take("]")
            return found
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            rest = ("iri", RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.triples += [(cell, ("iri", RDF + "first"), item), (cell, ("iri", RDF + "rest"), rest)]
                rest = cell
            return rest
        raise SyntaxError(f"unexpected {text or 'end'}")


def parse(text: str, base: str = "") -> list[tuple[Node, Node, Node]]:
    """The document's triples in order; malformed text raises SyntaxError."""
    parser = _Parser(text, base)
    parser.document()
    return parser.triples

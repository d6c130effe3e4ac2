"""String functions with SPARQL's semantics, as Column expressions; nothing leaves the JVM.

NULL gives NULL everywhere, as an error leaves a SPARQL variable unbound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import BNODE


def strafter(text: Column, separator: str) -> Column:
    """What follows the first separator; '' without one; all of it for an empty separator."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substring(text, at + F.lit(len(separator)), F.length(text))).when(text.isNotNull(), F.lit(""))


def strbefore(text: Column, separator: str) -> Column:
    """What precedes the first separator; '' without one or for an empty one."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).when(text.isNotNull(), F.lit(""))


def encode_for_uri(text: Column) -> Column:
    """Percent-encode all but unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_decode(text: Column) -> Column:
    """Undo percent-encoding; '+' and malformed escapes stay."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)


def bnode_label(text: Column) -> Column:
    """A blank node's label, without the prefixes that it may carry."""
    return F.regexp_replace(text, f"^({re.escape(BNODE)})?(_:)?", "")


def same_value(left: Column, right: Column) -> Column:
    """Unbound, equal, or equal once either side is percent-encoded."""
    equal = (left == right) | (encode_for_uri(left) == right) | (left == encode_for_uri(right))
    return left.isNull() | F.coalesce(equal, F.lit(False))


def language_is(tag: Column, wanted: str) -> Column:
    return F.lower(tag) == wanted.lower()


#: Escapes of N-Quads strings that stand for one character.
_ESCAPES = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': '"', "\\'": "'", "\\\\": "\\"}
_UNITS = r"(\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+)"


def unescape(text: Column) -> Column:
    """Replace the escapes of an N-Quads string or IRI; an unknown escape raises an error."""

    def unit(x: Column) -> Column:
        out = F.when(~x.startswith("\\"), x)
        out = out.when(x.startswith("\\U"), F.decode(F.unhex(F.substr(x, F.lit(3))), "UTF-32"))
        out = out.when(x.startswith("\\u"), F.decode(F.unhex(F.substr(x, F.lit(3))), "UTF-16BE"))
        for escape, char in _ESCAPES.items():
            out = out.when(x == escape, F.lit(char))
        return out.otherwise(F.raise_error(F.concat(F.lit("malformed RDF: unknown escape "), x)).cast("string"))

    units = F.regexp_extract_all(text, F.lit(_UNITS), 0)
    return F.when(F.instr(text, "\\") == 0, text).when(text.isNotNull(), F.array_join(F.transform(units, unit), ""))


def escape(text: Column) -> Column:
    """Escape a literal for N-Quads."""
    out = text
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out

"""RDF terms as columns, and their values as SQL types.

A quad is (s, p, o, g): strings, but for ``o``, a struct of kind ('iri' or 'lit'), value, dt and lang.
Blank nodes are IRIs under ``urn:bnode:``; the default graph is ''.  No part is NULL, so equality of
terms is equality of structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import LANG_STRING, XSD, XSD_STRING

TERM = T.StructType([T.StructField(n, T.StringType(), False) for n in ("kind", "value", "dt", "lang")])
QUAD = T.StructType([T.StructField("s", T.StringType(), False), T.StructField("p", T.StringType(), False), T.StructField("o", TERM, False), T.StructField("g", T.StringType(), False)])

#: XSD datatype to SQL type of values without a declared type; every other datatype stays text.
BY_DATATYPE = {XSD + "integer": T.LongType(), XSD + "decimal": T.DecimalType(38, 18), XSD + "float": T.DoubleType(), XSD + "double": T.DoubleType(), XSD + "boolean": T.BooleanType(), XSD + "date": T.DateType()}


def term(kind: str, value: Column, dt: Column | str = "", lang: Column | str = "") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), as_column(dt).alias("dt"), as_column(lang).alias("lang"))


def iri(value: Column) -> Column:
    return term("iri", value)


def literal(value: Column, datatype: str | None = None, language: str | None = None) -> Column:
    return term("lit", value, LANG_STRING if language else datatype or XSD_STRING, language or "")


def natural(value: Column, kind: T.DataType) -> tuple[Column, str]:
    """The lexical form and datatype of a SQL value."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("string"), XSD + "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("string"), XSD + "double"
    if isinstance(kind, T.DecimalType):
        return value.cast("string"), XSD + "decimal"
    if isinstance(kind, T.BooleanType):
        return value.cast("string"), XSD + "boolean"
    if isinstance(kind, T.DateType):
        return value.cast("string"), XSD + "date"
    if isinstance(kind, T.TimestampNTZType):
        return F.replace(value.cast("string"), F.lit(" "), F.lit("T")), XSD + "dateTime"
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), XSD + "dateTime"
    if isinstance(kind, T.BinaryType):
        return F.hex(value), XSD + "hexBinary"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return value.cast("string"), XSD_STRING
    raise TypeError(f"a column of type {kind.simpleString()} cannot be mapped")


def strict_boolean(text: Column, true: tuple[str, ...], false: tuple[str, ...]) -> Column:
    low = F.lower(text)
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(low.isin(*true), F.lit(True)).when(low.isin(*false), F.lit(False)).otherwise(bad)


def cast_to(text: Column, kind: T.DataType) -> Column:
    """Text as a declared SQL type; text that does not fit raises an error, NULL stays NULL."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return text.cast("decimal(38,10)").cast(kind)
    if isinstance(kind, T.BooleanType):
        return strict_boolean(text, ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n"))
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return text
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return text.cast(kind)
    raise TypeError(f"a column of type {kind.simpleString()} cannot be reconstructed")


def type_of(datatypes: set[str], zoned: bool = False) -> T.DataType:
    """The SQL type of a column whose literals have these datatypes; mixed or none: text."""
    if len(datatypes) != 1:
        return T.StringType()
    (only,) = datatypes
    if only == XSD + "dateTime":
        return T.TimestampType() if zoned else T.TimestampNTZType()
    return BY_DATATYPE.get(only, T.StringType())


def by_datatype(text: Column, kind: T.DataType) -> Column:
    """Text as the type that :func:`type_of` chose."""
    if isinstance(kind, T.BooleanType):
        return strict_boolean(text, ("true", "1"), ("false", "0"))
    return text if isinstance(kind, T.StringType) else text.cast(kind)

"""Types and column order of reconstructed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import by_datatype, cast_to, type_of
from ..sources.tables import resolve


def _text(df: DataFrame, name: str):
    column = F.col(f"`{name}`")
    return column["value"] if isinstance(df.schema[name].dataType, T.StructType) else column


def by_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the source schema in its order, cast to its types; others go."""
    stored = {resolve(schema, n, case_sensitive=False) or n: n for n in df.columns}
    return df.select(*(cast_to(_text(df, stored[f.name]), f.dataType).alias(f.name) for f in schema.fields if f.name in stored))


def by_values(df: DataFrame) -> DataFrame:
    """Types from the datatypes of all literals of each column: one aggregation over the result.

    Columns cut out of templates are text; so are columns of several datatypes, or of none.
    """
    terms = [n for n in df.columns if isinstance(df.schema[n].dataType, T.StructType)]
    found = {}
    if terms:
        # the distinct datatypes of a column are few; zones show in dateTime values only
        aggregates = [F.collect_set(F.col(f"`{n}`")["dt"]).alias(f"d{i}") for i, n in enumerate(terms)]
        aggregates += [F.max(F.col(f"`{n}`")["value"].rlike(r"T.*(Z|[+-]\d\d:\d\d)$")).alias(f"z{i}") for i, n in enumerate(terms)]
        row = df.agg(*aggregates).first()
        found = {n: type_of(set(row[f"d{i}"]) - {""}, bool(row[f"z{i}"])) for i, n in enumerate(terms)}
    return df.select(*(by_datatype(_text(df, n), found.get(n, T.StringType())).alias(n) for n in df.columns))

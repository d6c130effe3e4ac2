"""Relational sources: tables and queries by name, their schemas, and base tables of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping as Tables
from urllib.parse import unquote_plus, urlsplit

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MappingError
from ..plans.rules import LogicalQuery, Mapping


class Catalog(Tables):
    """Tables by name, for mappings to read: DataFrames, Parquet files of a folder, or a database's tables."""

    def __init__(self, spark: SparkSession, tables: Tables[str, DataFrame] | None = None, jdbc: dict[str, str] | None = None):
        self.spark, self.jdbc = spark, jdbc
        self._tables: dict[str, DataFrame] = dict(tables or {})

    @classmethod
    def folder(cls, spark: SparkSession, path: str, *names: str) -> Catalog:
        return cls(spark, {name: spark.read.parquet(f"{path}/{name}.parquet") for name in names})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if self.jdbc:
                self._tables[name] = self.spark.read.format("jdbc").options(**self.jdbc, dbtable=name).load()
            elif self.spark.catalog.tableExists(name):
                self._tables[name] = self.spark.table(name)
            else:
                raise KeyError(name)
        return self._tables[name]

    def __contains__(self, name: object) -> bool:
        try:
            self[str(name)]
        except KeyError:
            return False
        return True

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def query(self, sql: str) -> DataFrame:
        """A query's result; its tables are this catalog's, identifiers in double quotes are names."""
        if self.jdbc:
            return self.spark.read.format("jdbc").options(**self.jdbc, query=sql).load()
        for name in base_tables(self.spark, sql):
            if name in self:
                self[name].createOrReplaceTempView(name)
        return self.spark.sql(delimited(sql))

    def with_queries(self, queries: Tables[str, LogicalQuery]) -> Catalog:
        found = Catalog(self.spark, self._tables, self.jdbc)
        found._tables |= {name: self.query(q.sql) for name, q in queries.items()}
        return found

    def schema(self, name: str) -> T.StructType:
        return self[name].schema


def delimited(sql: str) -> str:
    """Identifiers in double quotes, outside strings, as Spark delimits them."""
    return re.sub(r"'(?:[^']|'')*'|\"((?:[^\"]|\"\")*)\"", lambda m: m[0] if m[1] is None else "`" + m[1].replace('""', '"') + "`", sql)


def base_tables(spark: SparkSession, sql: str) -> list[str]:
    """Names of the tables that a query reads, without the ones that it defines itself."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(delimited(sql)).toString()
    names = [n.split(",")[0].strip().strip("[]").split("].[")[-1] for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)]
    defined = {n.lower() for n in re.findall(r"(?i)(?:\bWITH\b|,)\s*[`\"]?(\w+)[`\"]?\s+AS\s*\(", sql)}
    return [n for n in dict.fromkeys(x.split(".")[-1].strip().strip("`") for x in names) if n.lower() not in defined]


def jdbc_options(url: str) -> dict[str, str]:
    """Options of the JDBC reader from a URL like postgresql://user:password@host/db; JDBC URLs stay."""
    if url.startswith("jdbc:"):
        return {"url": url}
    parts = urlsplit(url)
    kind = parts.scheme.split("+")[0]
    if kind not in ("postgresql", "mysql"):
        raise ValueError(f"Unknown database: {url}")
    port = f":{parts.port}" if parts.port else ""
    out = {"url": f"jdbc:{kind}://{parts.hostname}{port}{parts.path}"}
    if parts.username:
        out |= {"user": unquote_plus(parts.username), "password": unquote_plus(parts.password or "")}
    return out


def opened(spark: SparkSession, options: dict[str, str]) -> dict[str, str]:
    """JDBC options, if a driver for them is on the class path."""
    try:
        spark._jvm.java.sql.DriverManager.getDriver(options["url"])
    except Py4JError as error:
        raise MappingError(f"The mapping's database {options['url']} has no driver here; name a source, or False for none") from error
    return options


def resolve(schema: T.StructType, name: str, case_sensitive: bool = True) -> str | None:
    """The stored name of a column: exact, else the only one that differs in case."""
    if name in schema.names:
        return name
    alike = [n for n in schema.names if n.lower() == name.lower()]
    return alike[0] if len(alike) == 1 and not case_sensitive else None


def check_references(mapping: Mapping, catalog: Catalog, case_sensitive: bool = False) -> None:
    """Every column that the mapping reads exists in its table or query."""
    for source, columns in sorted(mapping.reads.items()):
        if source not in catalog:
            raise MappingError(f"The source has no table named {source}")
        schema = catalog.schema(source)
        missing = sorted(c for c in columns if resolve(schema, c, case_sensitive) is None)
        if missing:
            what = f"The query {mapping.queries[source].sql!r} has" if source in mapping.queries else f"Table '{source}' of the source database has"
            raise MappingError(f"{what} no column named {', '.join(missing)}")


def content(df: DataFrame) -> DataFrame:
    """A table as its lexical values: CHAR(n) padded to n, binary in upper-case hexadecimal."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        # scanned CHAR columns are strings whose metadata tell their length
        told = re.fullmatch(r"char\((\d+)\)", str(f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")))
        length = f.dataType.length if isinstance(f.dataType, T.CharType) else int(told[1]) if told else None
        if length:
            c = F.rpad(c, length, " ")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def run_script(spark: SparkSession, script: str) -> None:
    """Run the statements of a SQL script, split at semicolons outside strings."""
    for statement in re.findall(r"(?:'(?:[^']|'')*'|[^;'])+", script):
        if statement.strip():
            spark.sql(delimited(statement))


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")

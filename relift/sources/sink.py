"""Where reconstructed tables go: catalog tables, Parquet folders and databases; rows are appended."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MappingError
from .store import file_system


def evolved(old: DataFrame, schema: T.StructType, allow_drop: bool) -> DataFrame:
    """Old rows under a new schema: missing columns are added, changed ones cast, extra ones dropped if allowed."""
    extra = [n for n in old.columns if n not in schema.names]
    if extra and not allow_drop:
        raise MappingError(f"the destination has columns that the new rows lack: {', '.join(extra)}")
    return old.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


#: Puts prepared rows in their place.
Publish = Callable[[], None]


def _new_rows(old: DataFrame, df: DataFrame, allow_drop: bool) -> tuple[DataFrame, bool]:
    """(rows to stage, whether they replace the old ones): a changed schema takes the old rows along."""
    if old.schema.simpleString() == df.schema.simpleString() or df.isEmpty():
        return df, False
    return evolved(old, df.schema, allow_drop).unionByName(df), True


@dataclass
class TableSink:
    """Catalog tables in ``format``; a changed schema replaces the table.

    Rows are staged in a table of their own.  A replaced table is renamed first and dropped last, so that
    one of both is whole at any time; a name that a crash left free is given back.
    """

    spark: SparkSession
    database: str | None = None
    format: str = "parquet"
    allow_drop: bool = False

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`" if self.database else f"`{table}`"

    def _exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._name(table).replace("`", ""))

    def _rename(self, a: str, b: str) -> None:
        self.spark.sql(f"ALTER TABLE {self._name(a)} RENAME TO {self._name(b)}")

    def prepare(self, df: DataFrame, table: str) -> Publish:
        staged, before = f"{table}__staged", f"{table}__before"
        drop = lambda name: self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")
        if self._exists(before):
            if self._exists(table):
                drop(before)
            else:
                self._rename(before, table)
        drop(staged)
        there = self._exists(table)
        rows, replaces = _new_rows(self.spark.table(self._name(table)), df, self.allow_drop) if there else (df, False)
        if there and not replaces and df.schema.simpleString() != self.spark.table(self._name(table)).schema.simpleString():
            return lambda: None  # no rows: the table stays as it is
        rows.write.format(self.format).saveAsTable(self._name(staged))

        def publish() -> None:
            if there and not replaces:
                self.spark.table(self._name(staged)).write.format(self.format).mode("append").saveAsTable(self._name(table))
                drop(staged)
                return
            if there:
                self._rename(table, before)
            self._rename(staged, table)
            drop(before)

        return publish

    def write(self, df: DataFrame, table: str) -> None:
        self.prepare(df, table)()


@dataclass
class ParquetSink:
    """One Parquet folder a table; rows are staged in a folder beside it, as :class:`TableSink` has it."""

    path: str
    allow_drop: bool = False

    def prepare(self, df: DataFrame, table: str) -> Publish:
        spark, at = df.sparkSession, f"{self.path.rstrip('/')}/{table}"
        files, folder = file_system(spark, at)
        staged, before = (file_system(spark, at + ending)[1] for ending in (".staged", ".before"))
        if files.exists(before):
            if files.exists(folder):
                files.delete(before, True)
            else:
                files.rename(before, folder)
        there = files.exists(folder)
        old = spark.read.parquet(at) if there else None
        rows, replaces = _new_rows(old, df, self.allow_drop) if there else (df, False)
        if there and not replaces and df.schema.simpleString() != old.schema.simpleString():
            return lambda: None
        rows.write.mode("overwrite").parquet(at + ".staged")

        def publish() -> None:
            if there and not replaces:
                for found in files.listStatus(staged):
                    if found.getPath().getName().startswith("part-"):  # names are unique
                        files.rename(found.getPath(), folder)
                files.delete(staged, True)
                return
            if there:
                files.rename(folder, before)
            files.rename(staged, folder)
            files.delete(before, True)

        return publish

    def write(self, df: DataFrame, table: str) -> None:
        self.prepare(df, table)()


@dataclass
class JdbcSink:
    """A database by the JDBC options of :func:`relift.sources.tables.jdbc_options`; its driver has to be on the class path."""

    options: dict[str, str]
    batch: int = 10_000

    def prepare(self, df: DataFrame, table: str) -> Publish:
        return lambda: self.write(df, table)

    def write(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").options(**self.options, dbtable=table, batchsize=str(self.batch)).mode("append").save()


def sink_for(spark: SparkSession, destination) -> TableSink | ParquetSink | JdbcSink:
    """A sink as it is, 'catalog', 'catalog:<database>', a database's URL, or a folder's path."""
    if not isinstance(destination, str):
        return destination
    if destination == "catalog" or destination.startswith("catalog:"):
        return TableSink(spark, destination.partition(":")[2] or None)
    if destination.split(":")[0].split("+")[0] in ("jdbc", "postgresql", "mysql"):
        from .tables import jdbc_options

        return JdbcSink(jdbc_options(destination))
    return ParquetSink(destination)

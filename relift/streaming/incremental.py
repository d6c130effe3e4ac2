"""Reconstruction over graphs that grow: new statement files are read as a stream.

A statement can complete rows of its subject only (and of subjects that join it), so each micro-batch
re-derives the rows of the subjects that it touches from the whole graph, and hands them to a sink with
the batch's number.  Files are N-Triples or N-Quads text, or Parquet quads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import reconstruct_tables
from ..functions.terms import QUAD
from ..plans.rules import Mapping
from ..sources.rdf import Graph, parse_lines
from ..sources.tables import Catalog


def quad_stream(spark: SparkSession, folder: str, kind: str = "text") -> DataFrame:
    """New files of a folder as streaming quads."""
    if kind == "parquet":
        return spark.readStream.schema(QUAD).parquet(folder)
    return parse_lines(spark.readStream.text(folder))


def touched(quads: DataFrame, batch: DataFrame) -> DataFrame:
    """All quads of the subjects that a batch adds to, of what they point at, and of what points at them."""
    own = batch.select(F.col("s").alias("x"))
    ends = batch.where("o.kind = 'iri'").select(F.col("o.value").alias("x"))
    near = quads.where("o.kind = 'iri'").join(own.distinct(), F.col("o.value") == F.col("x"), "left_semi").select(F.col("s").alias("x"))
    return quads.join(own.union(ends).union(near).distinct(), F.col("s") == F.col("x"), "left_semi")


def reconstruct_stream(spark: SparkSession, mapping: Mapping, folder: str, store: str, sink: Callable[[dict[str, DataFrame], int], None], checkpoint: str, source: Catalog | None = None, kind: str = "text", **options) -> StreamingQuery:
    """Append each batch to the Parquet quads at ``store`` and give ``sink`` the rows that it touches.

    A batch that is run again after a failure finds its own statements in the store already; as a graph is
    a set, that changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.write.mode("append").parquet(store)
        whole = spark.read.schema(QUAD).parquet(store)
        sink(reconstruct_tables(spark, mapping, Graph(touched(whole, batch)), source, observe=False, **options), number)

    return quad_stream(spark, folder, kind).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

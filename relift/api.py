"""The public functions: analyse a mapping, reconstruct its tables, compare the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import NoDataError, NonInvertibleError
from .operators.compare import compare_databases
from .operators.forward import graph_of, statements_of
from .operators.inversion import Inversion
from .operators.typing import by_schema, by_values
from .plans.analysis import TableAnalysis, analyse, require_recoverable
from .plans.mapping import parse_mapping, read_mapping
from .plans.rules import Mapping
from .sources.rdf import Graph
from .sources.sink import sink_for
from .sources.tables import Catalog, check_references, jdbc_options, opened

__all__ = ["Graph", "analyze_mapping", "compare_databases", "graph_of", "invert", "reconstruct", "reconstruct_tables", "statements_of"]


def _mapping(mapping: Mapping | str) -> Mapping:
    """A mapping as it is, or from a path, or from Turtle text."""
    if isinstance(mapping, Mapping):
        return mapping
    return parse_mapping(mapping) if "\n" in mapping else read_mapping(mapping)


def _graph(spark: SparkSession, graph: Graph | DataFrame | str) -> Graph:
    if isinstance(graph, Graph):
        return graph
    return Graph.open(spark, graph) if isinstance(graph, str) else Graph(graph)


def _catalog(spark: SparkSession, mapping: Mapping, source: Catalog | str | bool | None) -> Catalog | None:
    """The source, explicit or the database that the mapping names, which has to open; False: none."""
    if source is None and mapping.connection:
        source = Catalog(spark, jdbc=opened(spark, mapping.connection))
    found = Catalog(spark, jdbc=jdbc_options(source)) if isinstance(source, str) else source
    return found.with_queries(mapping.queries) if isinstance(found, Catalog) else None


def _analysis(mapping: Mapping, graph: Graph) -> dict[str, TableAnalysis]:
    found = analyse(mapping, graph.observed)
    require_recoverable(found)
    return found


def analyze_mapping(spark: SparkSession, mapping: Mapping | str, graph: Graph | DataFrame | str, source: Catalog | str | bool | None = None) -> dict[str, TableAnalysis]:
    """What the graph preserves of each logical table; a source checks the columns that the mapping reads."""
    mapping = _mapping(mapping)
    catalog = _catalog(spark, mapping, source)
    if catalog is not None:
        check_references(mapping, catalog)
    return _analysis(mapping, _graph(spark, graph))


def invert(mapping: Mapping, source: str, graph: Graph, analysis: dict[str, TableAnalysis] | None = None, **options) -> DataFrame:
    """One logical table as a lazy DataFrame, columns still as RDF terms or text."""
    table = (analysis or analyse(mapping))[source]
    found = Inversion(mapping, source, graph, table.unrecoverable, **options).solve()
    if found is None:
        raise NonInvertibleError(f"No column of table '{source}' can be recovered from the graph")
    return found


def reconstruct_tables(spark: SparkSession, mapping: Mapping | str, graph: Graph | DataFrame | str, source: Catalog | str | bool | None = None, observe: bool = True, **options) -> dict[str, DataFrame]:
    """Every logical table, typed and ordered by the source's schema, or by the graph's datatypes without a source.

    ``observe`` looks for template terms that split in several ways, which reads the graph.
    """
    mapping = _mapping(mapping)
    if not mapping.rules:
        raise NoDataError("The mapping has no logical table")
    catalog, graph = _catalog(spark, mapping, source), _graph(spark, graph)
    if catalog is not None:
        check_references(mapping, catalog)
    analysis = analyse(mapping, graph.observed if observe else None)
    require_recoverable(analysis)
    out = {}
    for name in mapping.sources:
        found = invert(mapping, name, graph, analysis, **options)
        out[name] = by_schema(found, catalog.schema(name)) if catalog is not None else by_values(found)
    return out


def reconstruct(spark: SparkSession, mapping: Mapping | str, graph: Graph | DataFrame | str, destination, source: Catalog | str | bool | None = None, **options) -> None:
    """Reconstruct every logical table and append its rows to the destination.

    All tables are prepared beside the destination first, and only then take their places, in name order.
    """
    sink = sink_for(spark, destination)
    for publish in [sink.prepare(table, name) for name, table in reconstruct_tables(spark, mapping, graph, source, **options).items()]:
        publish()


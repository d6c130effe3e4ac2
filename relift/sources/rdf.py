"""RDF graphs as quad DataFrames: N-Triples and N-Quads text, Parquet, and what tests hold in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import QUAD
from ..functions.text import escape, unescape
from ..functions.vocabulary import BNODE, LANG_STRING, XSD_STRING
from ..plans.rules import Template
from .store import new_path, remove, written

_IRI = r'<([^\x00-\x20<>"{}|^`]*)>'
_LABEL = r"(_:[^\s<>\"]*[^\s<>\".])"
_LITERAL = r'"((?:[^"\\\n\r]|\\.)*)"(?:\^\^' + _IRI + r"|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
#: One statement; subject, predicate, object and graph may follow each other without white space.
STATEMENT = rf"(?s)^\s*(?:{_IRI}|{_LABEL})\s*{_IRI}\s*(?:{_IRI}|{_LABEL}|{_LITERAL})\s*(?:{_IRI}|{_LABEL})?\s*\.\s*(?:#.*)?$"
_MARK = "\x01"
#: Parts of a statement by group; the literal's text comes last, as only it may hold the mark.
_GROUPS = {"si": 1, "sb": 2, "p": 3, "oi": 4, "ob": 5, "dt": 7, "lang": 8, "gi": 9, "gb": 10, "value": 6}
FORMATS = {".nt": "text", ".nq": "text", ".ntriples": "text", ".nquads": "text", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """'text' or 'parquet', by extension; compressed text counts by the extension before."""
    name = path.rstrip("/").lower()
    for ending in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(ending)
    dot = name.rfind(".", name.rfind("/") + 1)
    if dot < 0 or name[dot:] not in FORMATS:
        raise ValueError(f"Unknown RDF format: {path}")
    return FORMATS[name[dot:]]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Quads of a DataFrame whose ``value`` column has one line a row; malformed lines raise an error.

    One regular expression a line: it replaces the line by its parts.
    """
    text = F.col("value")
    parts = F.regexp_replace(text, STATEMENT, _MARK + _MARK.join(f"${i}" for i in _GROUPS.values()))
    found = F.when(parts.startswith(_MARK), F.split(parts, _MARK, len(_GROUPS) + 1))
    checked = F.coalesce(found, F.raise_error(F.concat(F.lit("malformed RDF: "), text)).cast("array<string>"))
    rows = lines.where(~text.rlike(r"^\s*(#.*)?$")).select(checked.alias("x"))
    at = {name: F.col("x")[i + 1] for i, name in enumerate(_GROUPS)}

    def node(iri: str, label: str):
        return F.when(at[label] != "", F.concat(F.lit(BNODE), F.substr(at[label], F.lit(3)))).otherwise(unescape(at[iri]))

    is_iri = (at["oi"] != "") | (at["ob"] != "")
    datatype = F.when(is_iri, "").when(at["lang"] != "", LANG_STRING).when(at["dt"] != "", unescape(at["dt"])).otherwise(XSD_STRING)
    o = F.struct(F.when(is_iri, "iri").otherwise("lit").alias("kind"), F.when(is_iri, node("oi", "ob")).otherwise(unescape(at["value"])).alias("value"), datatype.alias("dt"), at["lang"].alias("lang"))
    return rows.select(node("si", "sb").alias("s"), unescape(at["p"]).alias("p"), o.alias("o"), node("gi", "gb").alias("g"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of a file or folder; the format follows from the extension."""
    if format_of(path) == "parquet":
        return spark.read.schema(QUAD).parquet(path).select(*QUAD.names)
    return parse_lines(spark.read.text(path))


def lines_of(quads: DataFrame) -> DataFrame:
    """One N-Quads statement a row; blank nodes get their labels back."""

    def node(column):
        return F.when(column.startswith(BNODE), F.concat(F.lit("_:"), F.substr(column, F.lit(len(BNODE) + 1)))).otherwise(F.concat(F.lit("<"), column, F.lit(">")))

    o = F.col("o")
    suffix = F.when(o["lang"] != "", F.concat(F.lit("@"), o["lang"])).when(o["dt"] != XSD_STRING, F.concat(F.lit("^^<"), o["dt"], F.lit(">"))).otherwise("")
    text = F.when(o["kind"] == "iri", node(o["value"])).otherwise(F.concat(F.lit('"'), escape(o["value"]), F.lit('"'), suffix))
    graph = F.when(F.col("g") == "", "").otherwise(F.concat(F.lit(" "), node(F.col("g"))))
    return quads.select(F.concat_ws(" ", node(F.col("s")), node(F.col("p")), text).alias("a"), graph.alias("b")).select(F.concat("a", "b", F.lit(" .")).alias("value"))


def write_quads(quads: DataFrame, path: str, partition_by_predicate: bool = False) -> None:
    """To Parquet (optionally a folder a predicate, which prunes constant predicates at the scan) or N-Quads text."""
    if format_of(path) == "parquet":
        writer = quads.write
        (writer.partitionBy("p") if partition_by_predicate else writer).parquet(path)
    else:
        lines_of(quads).write.text(path)


class Graph:
    """A graph to query: ``default`` is the union of all graphs as a set, ``named`` the quads in named graphs.

    ``default`` is shuffled by subject once; de-duplication and the joins on the subject keep that.
    With ``keep`` the quads stay cached until the graph is closed.
    """

    _path: str | None = None

    def __init__(self, quads: DataFrame, keep: bool = False):
        self._kept = quads.persist() if keep else None
        self.quads = self._kept if keep else quads
        self.default = self.quads.select("s", "p", "o").repartition("s").dropDuplicates(["s", "p", "o"])
        self.named = self.quads.where("g <> ''").select("s", "p", "o", "g").repartition("s").dropDuplicates(["s", "p", "o", "g"])

    @classmethod
    def open(cls, spark: SparkSession, path: str, keep: bool = False) -> Graph:
        """The graph of a file or folder.

        Text is parsed once: its quads are written to the shared folder, by predicate within each file, so that
        patterns skip row groups without theirs.  They stay until the graph is closed.  Without a shared
        folder, or kept in memory anyway, text is parsed where it is read.
        """
        quads = read_quads(spark, path)
        at = None if keep or format_of(path) == "parquet" else new_path(spark, "quads")
        if at is None:
            return cls(quads, keep)
        graph = cls(written(quads.sortWithinPartitions("p"), at))
        graph._path = at
        return graph

    def in_graph(self, iri: str) -> DataFrame:
        return self.named.where(F.col("g") == iri).drop("g")

    def union(self) -> DataFrame:
        """All quads, and each named one in the default graph too, as a set."""
        return self.default.select("s", "p", "o", F.lit("").alias("g")).unionByName(self.named)

    def observed(self, asked: list[tuple[str, Template]]) -> list[bool]:
        """For each (position, template), whether a term there can be split by it in more than one way.

        All captures as long as possible and all as short as possible are the same split exactly when
        there is only one.  One pass over the quads answers all.
        """
        if not asked:
            return []
        terms = {"subject": F.col("s"), "predicate": F.col("p"), "object": F.col("o.value"), "graph": F.when(F.col("g") != "", F.col("g"))}

        def twice(position: str, template: Template) -> Column:
            term, differ = terms[position], F.lit(False)
            for i in range(1, len(template.references) + 1):
                differ |= F.regexp_extract(term, template.pattern(), i) != F.regexp_extract(term, template.pattern("([^/]*?)"), i)
            return F.coalesce(F.max(term.rlike(template.pattern()) & differ), F.lit(False))

        return list(self.quads.agg(*(twice(*x).alias(f"x{i}") for i, x in enumerate(asked))).first())

    def observed_twice(self, position: str, template: Template) -> bool:
        return self.observed([(position, template)])[0]

    def close(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
        if self._path is not None:
            remove(self.quads.sparkSession, self._path)

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, *_) -> None:
        self.close()

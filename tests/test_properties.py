"""Random small tables and mappings: what comes back is what the analysis promises."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from relift.api import invert
from relift.operators.compare import compare_databases
from relift.operators.forward import graph_of
from relift.operators.typing import by_schema
from relift.plans.analysis import analyse
from relift.plans.rules import BNODE, LITERAL
from relift.sources.rdf import Graph
from relift.sources.tables import Catalog

from .helpers import EX, mapping, ref, rule, term_map

CELL = st.text(alphabet="ab %+/é-'\"\\", min_size=1, max_size=3)
OBJECTS = st.sampled_from([ref("b"), ref("c"), term_map(EX + "o/{b}"), term_map(EX + "o/{b}/{c}"), term_map("x {c}", LITERAL), term_map(EX + "T")])
SUBJECTS = st.sampled_from([term_map(EX + "s/{a}"), term_map(EX + "s/{a}/{b}"), term_map("n{a}", BNODE)])
GRAPHS = st.sampled_from([None, EX + "g", EX + "g/{c}"])


@settings(max_examples=12, deadline=None, derandomize=True, phases=(Phase.explicit, Phase.generate), suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.tuples(CELL, CELL, CELL), min_size=1, max_size=5, unique_by=lambda r: r[0]), subject=SUBJECTS, objects=st.lists(st.tuples(OBJECTS, GRAPHS), min_size=1, max_size=3))
def test_round_trip(spark, data, subject, objects):
    table = spark.createDataFrame(data, "a string, b string, c string").coalesce(1)
    whole = mapping(*(rule(subject, o, EX + f"p{i}", source="t", graph=g) for i, (o, g) in enumerate(objects)))
    graph = Graph(graph_of(whole, Catalog(spark, {"t": table})))
    analysis = analyse(whole, graph.observed)
    if not analysis["t"].recoverable:
        return
    back = by_schema(invert(whole, "t", graph, analysis), table.schema)
    same, message, losses = compare_databases({"t": table}, {"t": back}, analysis)
    assert same or losses, (message, whole, data, back.collect())


@settings(max_examples=15, deadline=None, derandomize=True, phases=(Phase.explicit, Phase.generate), suppress_health_check=list(HealthCheck))
@given(terms=st.lists(st.text(alphabet="ab-.", max_size=6), min_size=1, max_size=8), literals=st.sampled_from([("", "-", ""), ("a", ".", "b"), ("", "-", "-", ""), ("", "", "")]))
def test_greedy_and_lazy_splits_differ_for_ambiguous_terms(spark, terms, literals):
    from relift.plans.rules import Template

    from .helpers import lit, quads

    def ways(text, parts):
        if not text.startswith(parts[0]):
            return 0
        text = text[len(parts[0]) :]
        if len(parts) == 1:
            return int(text == "")
        return sum(ways(text[i:], parts[1:]) for i in range(len(text) + 1) if "/" not in text[:i])

    template = Template(literals, tuple("xyz"[: len(literals) - 1]))
    graph = Graph(quads(spark, [("s", "p", lit(t)) for t in terms]))
    assert graph.observed_twice("object", template) is any(ways(t, literals) > 1 for t in terms)

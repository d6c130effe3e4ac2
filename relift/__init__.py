"""relift: reconstructs relational tables from RDF graphs and the mappings that made them, on Spark."""

from importlib import import_module

_WHERE = {
    **dict.fromkeys(("analyze_mapping", "compare_databases", "reconstruct", "reconstruct_tables"), ".api"),
    **dict.fromkeys(("MappingError", "NoDataError", "NonInvertibleError", "ReliftError", "UnsupportedMappingError"), ".errors"),
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Public names on first use: Python workers import this package without the whole of it."""
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(_WHERE[name], __name__), name)

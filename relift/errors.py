"""What can go wrong, as callers see it."""


class ReliftError(Exception):
    """Base of this package's errors."""


class MappingError(ReliftError):
    """The mapping is invalid, or does not fit the source."""


class UnsupportedMappingError(ReliftError):
    """The mapping uses something that is not supported."""


class NonInvertibleError(ReliftError):
    """No column of a table can be recovered from the graph."""


class NoDataError(ReliftError):
    """The mapping has no table to reconstruct."""

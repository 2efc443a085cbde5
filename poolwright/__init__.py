"""Keyed, versioned row pools with a two-valued predicate algebra, on Spark."""

__version__ = "0.1.0"


def version() -> str:
    return __version__

"""The registered queries: each runs one operator over the given tables and, where SQL can say it, carries that SQL."""

from suite.registry import CATALOGUE
from suite import cleaning, evaluation, features, flagship, joins, quality, reports, reshaping, series, sources  # noqa: F401

__all__ = ["CATALOGUE"]

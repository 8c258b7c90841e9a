"""The registered queries."""

from . import laws, queries  # noqa: F401  laws registers with queries

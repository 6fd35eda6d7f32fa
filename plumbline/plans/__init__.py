"""The queries of the library, by name, with their SQL."""

from . import closed_forms, queries, readers  # noqa: F401

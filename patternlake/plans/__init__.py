"""Operators bound to the fixture tables."""

from . import answers, extraction, queries  # noqa: F401  (they register their queries)

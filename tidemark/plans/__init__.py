"""Registered queries over the given tables, with their SQL twins."""

from tidemark.plans import registry  # noqa: F401  (first, as it loads the plans in an order that works)

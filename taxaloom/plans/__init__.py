"""Queries over the driver tables, one module for each group of operators."""

from taxaloom.plans import checklists, names, niches, places, statistics, summaries, tables  # noqa: F401

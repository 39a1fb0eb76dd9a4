"""All queries of the library by name, and the SQL of those that SQL can express.

The plan modules register into one table as they are imported.
"""

from __future__ import annotations

from barloom.plans import analysis, blocks, extras, feeds, lifecycle, series, trading, tuning  # noqa: F401

QUERIES = series.QUERIES
ORACLES = series.ORACLES

"""The operators on the test tables: ``QUERIES`` and the checking ``SQL`` under the same names."""

from contentflow.workload import (  # noqa: F401
    analytics, catalog, cleaning, extraction, flows, pages, selection, streams,
)
from contentflow.workload.registry import QUERIES, SQL  # noqa: F401

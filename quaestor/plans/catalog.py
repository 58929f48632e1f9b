"""All queries of the analytics with their SQL; importing a module registers its queries."""

from quaestor.plans import merging, printed, reads, relations, scans, statistics, stored, streams, texts  # noqa: F401
from quaestor.plans.registry import QUERIES, SQL, flagship  # noqa: F401

"""All queries of the core library by name, and their SQL twins."""

from lucerna.plans import graphs, library, parsing, ranking, records, resolution, streams, topicality  # noqa: F401
from lucerna.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

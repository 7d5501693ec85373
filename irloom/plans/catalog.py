"""All registered queries of the library."""

from irloom.plans import graph_queries, queries, table_queries, training_queries  # noqa: F401  each module adds its own
from irloom.plans.registry import QUERIES  # noqa: F401

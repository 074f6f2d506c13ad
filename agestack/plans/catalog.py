"""All registered queries."""

from . import q_shape, q_simple, q_stages, q_stats, q_tables  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

"""All queries and their SQL."""

from . import flow_queries, pixel_queries, record_queries, report_queries  # noqa: F401
from .views import QUERIES, SQL  # noqa: F401

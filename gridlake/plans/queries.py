"""All registered queries over the driver's tables, with their SQL oracles."""

from gridlake.plans import record_queries, rendering_queries, table_queries, tile_queries, zonal_queries  # noqa: F401
from gridlake.plans.registry import ORACLE, QUERIES  # noqa: F401

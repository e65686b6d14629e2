"""Where queries register: a callable by name, with the SQL that DuckDB answers alike, or none."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """sql after the views that it names, and those that these name."""
    needed, text = set(), sql
    while new := {k for k in VIEWS if k not in needed and re.search(rf"\b{k}\b", text)}:
        needed |= new
        text = " ".join(VIEWS[k] for k in new)
    views = ",\n".join(v for k, v in VIEWS.items() if k in needed)
    body = sql.strip()
    if not views:
        return body
    return f"WITH {views},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {views}\n{body}"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _with_views(sql)
        return f

    return register


#: The rasters of gridlake.raster as DuckDB sees them.
VIEWS = {
    "r_ord": "r_ord AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS \"row\", CAST(o_orderkey % 100 AS INTEGER) AS col, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS FLOAT) END AS value FROM orders)",
    "r_cat": "r_cat AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS \"row\", CAST(o_orderkey % 100 AS INTEGER) AS col, CAST(ascii(o_orderpriority) - 48 AS FLOAT) AS value FROM orders)",
    "r_li": "r_li AS (SELECT CAST(l_orderkey // 100 AS INTEGER) AS \"row\", CAST(l_orderkey % 100 AS INTEGER) AS col, CAST(l_linenumber - 1 AS INTEGER) AS band, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "z_nat": "z_nat AS (SELECT n_nationkey AS zone_id, (n_nationkey % 5) * 20 + 0.25::DOUBLE AS x0, (n_nationkey % 5) * 20 + 17.75::DOUBLE AS x1, (n_nationkey // 5) * 30 + 0.5::DOUBLE AS y0, (n_nationkey // 5) * 30 + 26.25::DOUBLE AS y1 FROM nation)",
    "p_evt": "p_evt AS (SELECT event_id AS point_id, 10 + (event_id % 100) * 0.01::DOUBLE + 0.003::DOUBLE AS lon, 2 - (event_id // 100) * 0.01::DOUBLE - 0.004::DOUBLE AS lat, ts FROM events)",
    "cover": "cover AS (SELECT zone_id, r AS \"row\", c AS col, (least(r + 1.0::DOUBLE, y1) - greatest(r::DOUBLE, y0)) * (least(c + 1.0::DOUBLE, x1) - greatest(c::DOUBLE, x0)) AS w FROM (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS c FROM (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS r FROM z_nat)))",
    "joined": "joined AS (SELECT c.zone_id, c.\"row\", c.col, c.w, r.value::DOUBLE AS v FROM cover c JOIN r_ord r ON r.\"row\" = c.\"row\" AND r.col = c.col)",
}

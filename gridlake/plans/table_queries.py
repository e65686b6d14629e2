"""Blocks, geometry, names and access, load-run analytics and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.functions import geometry, text
from gridlake.operators import blocks, coverage, geostore, perf
from gridlake.plans.registry import query
from gridlake.raster import nation_zones, orders_raster, read
from gridlake.streaming import windows


@query("""
SELECT CAST(("row" // 16) * 7 + col // 16 AS INTEGER) AS block_idx, CAST(col // 16 AS INTEGER) AS bx, CAST("row" // 16 AS INTEGER) AS "by", count(*) AS cells, count(value) AS data FROM r_ord GROUP BY 1, 2, 3""")
def block_index(spark, sf):
    place = blocks.block_of(F.col("row"), F.col("col"), 16, 7)
    return orders_raster(spark, sf).cells.groupBy(*(c.alias(k) for k, c in place.items())).agg(F.count("*").alias("cells"), F.count("value").alias("data"))


@query("""
SELECT CAST(("row" // 16) * 7 + col // 16 AS INTEGER) AS block_idx, count(*) AS cells FROM r_ord WHERE col // 16 BETWEEN 1 AND 3 AND "row" // 16 BETWEEN 2 AND 4 GROUP BY 1""")
def block_prune(spark, sf):
    place = blocks.block_of(F.col("row"), F.col("col"), 16, 7)
    cells = orders_raster(spark, sf).cells.select(*(c.alias(k) for k, c in place.items()))
    return blocks.prune(cells, 20, 60, 40, 70, 16, 16).groupBy("block_idx").agg(F.count("*").alias("cells"))


@query("""
WITH r AS (SELECT l_suppkey AS s, l_orderkey * 1000 + l_linenumber AS o, CAST(l_quantity * 20 AS BIGINT) AS n FROM lineitem),
g AS (SELECT *, max(o + n) OVER (PARTITION BY s ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR o > reach + 32768 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT s AS l_suppkey, min(o) AS "first", max(o + n) AS "end", count(*) AS pieces FROM i GROUP BY s, island""")
def coalesce_ranges(spark, sf):
    ranges = read(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("byte_offset"), (F.col("l_quantity") * 20).cast("long").alias("byte_count"))
    return blocks.coalesce_ranges(ranges, ["l_suppkey"])


@query("""
SELECT CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col, CAST(floor(o_totalprice) AS BIGINT) % 65536 AS value FROM orders""")
def predictor2_roundtrip(spark, sf):
    values = read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 100).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), F.pmod(F.floor("o_totalprice"), F.lit(65536)).alias("value"))
    deltas = blocks.predictor2(values, ["row"], "col").select("row", "col", "delta")
    return blocks.undo_predictor2(deltas, ["row"], "col").select("row", "col", "value")


def _zone_polygons(spark, sf):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    return nation_zones(spark, sf).select("zone_id", F.array(F.array(ring)).alias("polygons"))


@query("SELECT zone_id, x0 AS west, y0 AS south, x1 AS east, y1 AS north, (x1 - x0) * (y1 - y0) AS area, 1 AS polygons, 5 AS vertices FROM z_nat")
def geom_bbox_area(spark, sf):
    g = F.col("polygons")
    return _zone_polygons(spark, sf).select("zone_id", *(c.alias(k) for k, c in geometry.bounds(g).items()), geometry.area(g).alias("area"), *(c.alias(k) for k, c in geometry.sizes(g).items()))


@query("SELECT zone_id, (x1 - x0) * (y1 - y0) / 2 AS signed_area FROM z_nat")
def geom_shoelace(spark, sf):
    """A triangle of each box."""
    ring = F.slice(F.get(F.get("polygons", 0), 0), 1, 3)
    return _zone_polygons(spark, sf).select("zone_id", geometry.signed_area(ring).alias("signed_area"))


@query("""SELECT zone_id, 'MULTIPOLYGON(((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || ')))' AS wkt FROM z_nat""")
def wkt_emit(spark, sf):
    """Written, read and written again."""
    return _zone_polygons(spark, sf).select("zone_id", geometry.to_wkt(geometry.from_wkt(geometry.to_wkt(F.col("polygons")))).alias("wkt"))


@query('SELECT zone_id, round(sum(w), 6) AS total, count(*) AS cells FROM cover GROUP BY zone_id')
def zonal_polygon_coverage(spark, sf):
    """The polygon rasteriser on boxes, against the closed form."""
    cells = coverage.cells_of(coverage.coverage_runs(_zone_polygons(spark, sf), 100, 200))
    return cells.groupBy("zone_id").agg(F.round(F.sum("w"), 6).alias("total"), F.count("*").alias("cells"))


@query("SELECT zone_id, round((x1 - x0) * (y1 - y0) / 2, 6) AS total FROM z_nat")
def zonal_triangle_total(spark, sf):
    """Coverage shares of a triangle add up to its area."""
    triangles = _zone_polygons(spark, sf).select("zone_id", F.transform("polygons", lambda p: F.transform(p, lambda r: F.slice(r, 1, 3))).alias("polygons"))
    return coverage.coverage_runs(triangles, 100, 200).groupBy("zone_id").agg(F.round(F.sum(F.col("w") * F.col("length")), 6).alias("total"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(CAST(o_orderkey AS VARCHAR)))), ',') AS ids FROM orders GROUP BY o_custkey""")
def ids_normalise(spark, sf):
    """Each customer's order ids, out of order, repeated and padded, then parsed."""
    lists = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("l"))
    raw = F.array_join(F.concat(F.reverse("l"), F.array(F.lit(" "), F.get("l", 0))), " , ")
    return lists.select("o_custkey", F.array_join(geostore.parse_ids(raw), ",").alias("ids"))


@query("SELECT DISTINCT c_custkey AS id FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def ids_missing(spark, sf):
    asked = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return geostore.missing_ids(asked, read(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id"]).distinct()


@query("""
WITH a AS (SELECT o_custkey AS c, list(DISTINCT o_orderpriority) AS asked FROM orders GROUP BY 1), g AS (SELECT o_custkey AS c, list(DISTINCT o_orderpriority) AS granted FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT a.c AS o_custkey, coalesce(len(list_filter(asked, lambda x: NOT list_contains(coalesce(granted, []), x))) = 0, false) AS allowed FROM a LEFT JOIN g ON g.c = a.c""")
def access_subset(spark, sf):
    orders = read(spark, sf, "orders")
    asked = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("asked"))
    granted = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("granted"))
    granted_or_none = F.coalesce(F.col("granted"), F.array().cast("array<string>"))
    return asked.join(granted, "o_custkey", "left").select("o_custkey", geostore.allowed(F.col("asked"), granted_or_none).alias("allowed"))


_Q = ", ".join(f"quantile_disc(value, {q}) AS {k}" for k, q in perf.PERCENTILES.items())


@query(f"SELECT event_type, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max, {_Q} FROM events GROUP BY event_type")
def perf_percentiles(spark, sf):
    return perf.percentiles(read(spark, sf, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, count(*) AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def perf_status_hist(spark, sf):
    return perf.tally(read(spark, sf, "events").withColumn("b", F.floor("value")), "event_type", "b")


@query("SELECT event_type, unnest([" + ", ".join(f"{(k + 1) / 50!r}::DOUBLE" for k in range(50)) + "]) AS q, unnest([" + ", ".join(f"quantile_disc(value, {(k + 1) / 50!r})" for k in range(50)) + "]) AS v FROM events GROUP BY event_type")
def perf_cdf50(spark, sf):
    return perf.cdf(read(spark, sf, "events"), ["event_type"], "value")


@query("WITH m AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, count(*) AS n FROM events GROUP BY 1) SELECT event_type, p50, n, round(p50 / sum(p50) OVER (), 8) AS share FROM m")
def perf_phase_share(spark, sf):
    return perf.phase_shares(read(spark, sf, "events"), "event_type", "value").withColumn("share", F.round("share", 8))


def _log_and_windows(spark, sf):
    log = read(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("prefix"))
    days = log.where("event_id % 997 = 0").select(F.col("event_id").alias("name"), "prefix", F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("t1"))
    return log, days


_LOG = "WITH w AS (SELECT event_id AS name, event_type AS prefix, ts AS t0, ts + INTERVAL 5 HOURS AS t1 FROM events WHERE event_id % 997 = 0)"


@query(_LOG + " SELECT name, count(*) AS lines FROM events JOIN w ON event_type = prefix AND ts BETWEEN t0 AND t1 GROUP BY name")
def log_window_attribution(spark, sf):
    return perf.attribute(*_log_and_windows(spark, sf)).groupBy("name").agg(F.count("*").alias("lines"))


@query(_LOG + " SELECT event_type AS prefix, count(*) AS lines FROM events WHERE NOT EXISTS (SELECT 1 FROM w WHERE event_type = prefix AND ts BETWEEN t0 AND t1) GROUP BY 1")
def log_unattributed(spark, sf):
    return perf.unattributed(*_log_and_windows(spark, sf), "event_id").groupBy("prefix").agg(F.count("*").alias("lines"))


_ENTRIES = "WITH e AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) + 128 AS size FROM events)"


@query(_ENTRIES + ", r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM e) SELECT user_id, event_id, running FROM r WHERE running <= 4000")
def lru_keep_set(spark, sf):
    """What caches of 4000 bytes, one a user, still hold."""
    entries = read(spark, sf, "events").select("user_id", "event_id", "ts", (F.floor("value") + 128).alias("size"))
    return perf.keep_within(entries, ["user_id"], [F.desc("ts"), F.col("event_id")], "size", 4000).select("user_id", "event_id", "running")


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', ts)) < 86400 * 3")
def ttl_keep_set(spark, sf):
    return geostore.live(read(spark, sf, "events"), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 86400 * 3).select("event_id")


_STORE = "WITH s AS (SELECT user_id, event_type, max(event_id) AS revision, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2), c AS (SELECT user_id, event_type, max(event_id) AS revision, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0 GROUP BY 1, 2)"


def _store(spark, sf):
    events = read(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("revision"), "value")
    store = geostore.last_changes(events.where("revision % 3 <> 0"), ["user_id", "event_type"], "revision")
    return store, events.where("revision % 6 = 0")


@query(_STORE + " SELECT * FROM c UNION ALL SELECT s.* FROM s ANTI JOIN c USING (user_id, event_type)")
def geostore_upsert(spark, sf):
    store, changes = _store(spark, sf)
    return geostore.upsert(store, changes, ["user_id", "event_type"], "revision")


@query(_STORE + " SELECT s.* FROM s ANTI JOIN c USING (user_id, event_type)")
def geostore_delete(spark, sf):
    store, changes = _store(spark, sf)
    return geostore.delete(store, changes, ["user_id", "event_type"])


def _runs(spark, sf):
    by = lambda rows: rows.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    events = read(spark, sf, "events")
    return by(events.where("event_id % 2 = 0")), by(events.where("event_id % 2 = 1"))


_RUNS = "WITH a AS (SELECT user_id, round(avg(value), 6) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, round(avg(value), 6) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1)"


@query(_RUNS + " SELECT user_id, a AS base, b AS head, round(b / a - 1, 6) AS change, CASE WHEN b / a - 1 > 0.05 THEN 'slower' WHEN b / a - 1 < -0.05 THEN 'faster' ELSE 'same' END AS flag FROM a JOIN b USING (user_id)")
def run_compare(spark, sf):
    return perf.compare_runs(*_runs(spark, sf), "user_id", "mean").withColumn("change", F.round("change", 6))


@query(_RUNS + " SELECT user_id, CASE WHEN coalesce(abs(a - b) <= 0.1 * greatest(1, abs(a), abs(b)), a IS NULL AND b IS NULL) THEN 'pass' WHEN coalesce(abs(a - b) <= 0.3 * greatest(1, abs(a), abs(b)), false) THEN 'known' ELSE 'fail' END AS verdict FROM a FULL JOIN b USING (user_id)")
def ab_verdicts(spark, sf):
    return perf.verdicts(*_runs(spark, sf), "user_id", "mean", 0.1, 0.3).select("user_id", "verdict")


@query("SELECT branch, event_id, value FROM (SELECT event_type AS branch, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value > 100) WHERE n = 1")
def newest_clean_run(spark, sf):
    runs = read(spark, sf, "events").select(F.col("event_type").alias("branch"), "event_id", "value", F.struct("ts", "event_id").alias("started"))
    return perf.newest_clean(runs, "branch", "started", F.col("value") > 100).select("branch", "event_id", "value")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return windows.tumbling(read(spark, sf, "events"), "ts", ["event_type"], "1 hour", "value").withColumn("total", F.round("total", 4))


@query("""
WITH s AS (SELECT event_type, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, value FROM events, (SELECT unnest([0, 1, 2]) AS k))
SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def events_sliding(spark, sf):
    return windows.tumbling(read(spark, sf, "events"), "ts", ["event_type"], "3 hours", "value", slide="1 hour").withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM i GROUP BY user_id, k""")
def events_session(spark, sf):
    return windows.sessions(read(spark, sf, "events"), "ts", ["user_id"], "6 hours")


@query("""
SELECT source, media, count(*) AS n, max(size) AS size FROM (SELECT source, lower(trim(' Text/' || lang || ' ')) AS media, (1 + n_chars % 3) * CASE WHEN n_chars % 2 = 0 THEN 1024 ELSE 1048576 END AS size FROM documents) GROUP BY 1, 2""")
def text_functions(spark, sf):
    docs = read(spark, sf, "documents")
    media = text.media_type(F.concat(F.lit(" Text/"), "lang", F.lit(" ; charset=utf-8")))
    size = text.parse_size(F.concat((1 + F.col("n_chars") % 3).cast("string"), F.when(F.col("n_chars") % 2 == 0, "k").otherwise("M")))
    return docs.select("source", media.alias("media"), size.alias("size")).groupBy("source", "media").agg(F.count("*").alias("n"), F.max("size").alias("size"))


@query("SELECT o_clerk, count(*) AS n FROM (SELECT substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 32) AS o_clerk FROM orders) GROUP BY 1")
def credential_fingerprint(spark, sf):
    return read(spark, sf, "orders").groupBy(text.fingerprint(F.col("o_custkey").cast("string")).alias("o_clerk")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, round(max(total), 4) AS last FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) GROUP BY 1")
def running_totals(spark, sf):
    """Running sums, as coverage rows and coordinate deltas use them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf, "events").select("user_id", F.sum("value").over(order).alias("total")).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("total"), 4).alias("last"))

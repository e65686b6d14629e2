"""Zonal statistics: zones become coverage (zone_id, row, col, w) and join cells on (row, col), never by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import tilemath
from gridlake.raster import Raster


def box_coverage(zones: DataFrame) -> DataFrame:
    """Share of each cell that a box (x0, x1, y0, y1 in cell units) covers."""
    span = lambda a, b: F.sequence(F.floor(a).cast("int"), (F.ceil(b) - 1).cast("int"))
    overlap = lambda cell, a, b: F.least(cell + 1.0, F.col(b)) - F.greatest(cell.cast("double"), F.col(a))
    some = zones.where("x1 > x0 and y1 > y0")
    rows = some.withColumn("row", F.explode(span(F.col("y0"), F.col("y1"))))
    cells = rows.withColumn("col", F.explode(span(F.col("x0"), F.col("x1"))))
    weight = overlap(F.col("row"), "y0", "y1") * overlap(F.col("col"), "x0", "x1")
    return cells.select("zone_id", "row", "col", weight.alias("w")).where("w > 0")


def center_coverage(zones: DataFrame) -> DataFrame:
    """Cells whose centre lies in a box, left and top edges included; weight 1."""
    first = lambda a: F.ceil(F.col(a) - 0.5).cast("int")
    span = lambda a, b: F.when(first(b) > first(a), F.sequence(first(a), first(b) - 1))
    rows = zones.withColumn("row", F.explode(span("y0", "y1")))
    return rows.withColumn("col", F.explode(span("x0", "x1"))).select("zone_id", "row", "col", F.lit(1.0).alias("w"))


def union_coverage(coverage: DataFrame, groups: DataFrame) -> DataFrame:
    """Coverage of groups of zones (group_id, zone_id): shares add up and are clamped to 1 afterwards."""
    summed = coverage.join(groups, "zone_id").groupBy("group_id", "row", "col").agg(F.sum("w").alias("w"))
    return summed.select(F.col("group_id").alias("zone_id"), "row", "col", F.least("w", F.lit(1.0)).alias("w"))


def cell_area(raster: Raster) -> Column:
    if tilemath.is_geographic(raster.epsg):
        return tilemath.cell_area_spherical(raster.gt, F.col("row"))
    return F.lit(tilemath.cell_area_planar(raster.gt))


def covered(coverage: DataFrame, cells: DataFrame) -> DataFrame:
    """The coverage with the cells' values; NaN has become null at the scan."""
    return coverage.join(cells.select("row", "col", "value"), ["row", "col"])


def stats(joined: DataFrame, area: Column | None = None, deviation: bool = False) -> DataFrame:
    """count, sum, avg, min, max and nodata_count of each zone; areas if a cell's area is given; stdev in a second pass.

    Only algebraic aggregates over zone_id, so a huge zone is summed where its cells lie. The deviation is taken about the
    zone's mean, which joins back first: sums of squares would cancel."""
    v, w = F.col("value").cast("double"), F.col("w")
    data = v.isNotNull()
    aggregates = [
        F.coalesce(F.sum(F.when(data, w)), F.lit(0.0)).alias("count"),
        F.coalesce(F.sum(w * v), F.lit(0.0)).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.sum(F.when(~data, w)), F.lit(0.0)).alias("nodata_count"),
    ]
    if area is not None:
        aggregates += [F.sum(w * area).alias("area_total"), F.coalesce(F.sum(F.when(data, w * area)), F.lit(0.0)).alias("area_data"), F.coalesce(F.sum(F.when(~data, w * area)), F.lit(0.0)).alias("area_nodata")]
    out = joined.groupBy("zone_id").agg(*aggregates).withColumn("avg", F.when(F.col("count") > 0, F.col("sum") / F.col("count")))
    if deviation:
        about = joined.join(out.select("zone_id", "avg"), "zone_id")
        spread = about.groupBy("zone_id").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(w * F.pow(v - F.col("avg"), 2)) / F.sum(F.when(data, w)))).alias("stdev"))
        out = out.join(spread, "zone_id")
    return out


def classes(joined: DataFrame, area: Column | None = None, most: int | None = 1000) -> DataFrame:
    """count, share and area of each value of each zone; status says where a zone has more than `most` values."""
    w = F.col("w")
    kept = joined.where("value is not null")
    by = kept.groupBy("zone_id", F.col("value").cast("double").alias("value")).agg(F.sum(w).alias("count"), F.sum(w * (area if area is not None else F.lit(None).cast("double"))).alias("area"))
    zone = Window.partitionBy("zone_id")
    out = by.withColumn("frac", F.col("count") / F.sum("count").over(zone))
    if most is not None:
        out = out.withColumn("status", F.when(F.count("*").over(zone) > most, "too many classes").otherwise("ok"))
    return out


def status(zones: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each zone, with what a request for it would have been told: outside the raster, empty (no cell covered), nodata, or ok.

    zones may say whether a zone's bounds meet the raster (_meets) and whether it was refused as too large (_refused)."""
    known = set(zones.columns)
    out = zones.select("zone_id", *sorted(known & {"_meets", "_refused"})).join(found, "zone_id", "left")
    none = F.when(F.col("_meets"), "empty").otherwise("outside") if "_meets" in known else F.lit("outside")
    state = F.when(F.col("count").isNull(), none).when(F.col("count") <= 0, "nodata").otherwise("ok")
    if "_refused" in known:
        state = F.when(F.col("_refused"), "too large").otherwise(state)
    return out.withColumn("status", state).drop("_meets", "_refused")


def answer_json(classes: bool = False, method: str = "spherical") -> Column:
    """A zone's statistics as the tagged JSON of an answer; classes (value, count, frac, area) only where they were asked for."""
    area = F.struct(F.col("area_total").alias("total"), F.col("area_data").alias("data"), F.col("area_nodata").alias("nodata"), F.lit(method).alias("method"))
    fields = [F.lit("polygon").alias("kind"), *(F.col(c) for c in ("min", "max", "avg", "stdev", "count", "sum", "nodata_count")), area.alias("area")]
    return F.to_json(F.struct(*fields, *([F.col("classes")] if classes else [])), {"ignoreNullFields": "false"})


def point_json(value: Column) -> Column:
    return F.to_json(F.struct(F.lit("point").alias("kind"), value.alias("value")), {"ignoreNullFields": "false"})

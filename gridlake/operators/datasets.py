"""Data sets around the engine: a synthetic elevation model, block sets, manifests, result stores, image differences and rate searches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridlake.functions import crs, geometry
from gridlake.functions.geometry import POLYGONS_TYPE


def synthetic_dem(spark: SparkSession, side: int, octaves: int = 6, seed: int = 7, highest: float = 3000.0, lake: tuple[float, float, float] = (0.3, 0.6, 0.08)) -> DataFrame:
    """(row, col, band, value) of a side x side terrain: octaves of waves rescaled to 0..highest, with a round lake of missing cells."""
    cells = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    x, y = F.col("col") / side, F.col("row") / side
    height = F.lit(0.0)
    for k in range(octaves):
        wave = 2.0**k
        height = height + F.sin(2 * 3.141592653589793 * wave * x + seed * (k + 1)) * F.cos(2 * 3.141592653589793 * wave * y + seed * (2 * k + 1)) / wave
    top = 2.0 - 2.0 ** (1 - octaves)
    wet = F.sqrt(F.pow(x - lake[0], 2) + F.pow(y - lake[1], 2)) < lake[2]
    value = F.when(~wet, (height + top) / (2 * top) * highest).cast("float")
    return cells.select("row", "col", F.lit(0).alias("band"), value.alias("value"))


def block_set(zones: DataFrame) -> DataFrame:
    """zones (polygons in degrees) numbered by their centres, west to east and then south to north, with their areas."""
    b = geometry.bounds(F.col("polygons"))
    centred = zones.withColumn("cx", (b["west"] + b["east"]) / 2).withColumn("cy", (b["south"] + b["north"]) / 2)
    place = F.row_number().over(Window.partitionBy().orderBy("cx", "cy")) - 1  # a set of one farm's blocks
    return centred.withColumn("block", place).withColumn("area_m2", geometry.ground_area(F.col("polygons")))


def describe_blocks(blocks: DataFrame) -> DataFrame:
    """One row: counts, box, centre, UTM code, areas, vertices and holes of a block set."""
    b, s = geometry.bounds(F.col("polygons")), geometry.sizes(F.col("polygons"))
    holes = F.aggregate(F.transform("polygons", lambda p: F.size(p) - 1), F.lit(0), lambda t, n: t + n)
    wide = blocks.select("area_m2", *(c.alias(k) for k, c in (b | s).items()), holes.alias("holes"))
    out = wide.agg(
        F.count("*").alias("blocks"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
        F.min("area_m2").alias("area_min"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY area_m2)").alias("area_p50"), F.max("area_m2").alias("area_max"), F.sum("area_m2").alias("area_total"),
        F.sum("vertices").alias("vertices"), F.sum("holes").alias("holes"),
    )
    lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    return out.withColumn("utm_epsg", crs.utm_epsg(lon, lat)).withColumn("lon", lon).withColumn("lat", lat)


def with_reason(sets: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """sets beside the manifest by name; what has no match says so."""
    known = manifest.withColumn("_known", F.lit(True))
    return sets.join(known, key, "left").withColumn("reason", F.when(F.col("_known").isNull(), "no scene of this name")).drop("_known")


def unpublished(files: DataFrame, published: DataFrame) -> DataFrame:
    """Files (key, content) that are not published with the same hash and size, with both."""
    marked = files.select("key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    return marked.join(published.select("key", "sha256", "bytes"), ["key", "sha256", "bytes"], "left_anti")


def result_index(results: DataFrame, started: str = "started") -> DataFrame:
    """Results newest first; those without a start come last."""
    return results.orderBy(F.col(started).desc_nulls_last())


def provenance_problem(commit: Column, clean: Column) -> Column:
    return F.when(commit.isNull() | (commit == ""), "the commit is not known").when(clean.isNull(), "cleanliness is not known").when(~clean, "the tree was not clean")


def least_cloudy(scenes: DataFrame, taken: str, clouds: str, recent: int = 20) -> DataFrame:
    """The least cloudy of the most recent scenes; the later one of equals."""
    return scenes.orderBy(F.desc(taken)).limit(recent).orderBy(F.col(clouds).asc_nulls_last(), F.desc(taken)).limit(1)


def steady_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The same k rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def tracking(offered: Column, achieved: Column, saturated: Column) -> Column:
    return ~saturated & (achieved >= 0.95 * offered)


def knee(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Highest rate that tracked and lowest that did not, of recorded probes (offered, achieved, saturated)."""
    good = tracking(F.col("offered"), F.col("achieved"), F.col("saturated"))
    return probes.groupBy(*keys).agg(F.max(F.when(good, F.col("offered"))).alias("sustained"), F.min(F.when(~good, F.col("offered"))).alias("first_failing"))


def image_difference(a: DataFrame, b: DataFrame, coarse: int = 32) -> DataFrame:
    """One row for two pixel tables (px, py, r, g, b, a): share of differing alpha, mean and largest colour difference, share beyond `coarse`."""
    side = lambda df, s: df.select("px", "py", *(F.col(c).alias(c + s) for c in "rgba"))
    joined = side(a, "1").join(side(b, "2"), ["px", "py"], "full")
    both = (F.col("a1") > 0) & (F.col("a2") > 0)
    gap = F.when(both, F.greatest(*(F.abs(F.col(c + "1") - F.col(c + "2")) for c in "rgb")))
    mean = F.when(both, sum(F.abs(F.col(c + "1") - F.col(c + "2")) for c in "rgb") / 3)
    differ = F.coalesce(F.col("a1"), F.lit(0)) != F.coalesce(F.col("a2"), F.lit(0))
    share = lambda c: 100.0 * F.sum(F.coalesce(c, F.lit(False)).cast("int")) / F.count("*")
    return joined.agg(share(differ).alias("alpha_percent"), F.avg(mean).alias("mean"), F.max(gap).alias("largest"), share(gap > coarse).alias("coarse_percent"))


def _simplify(ring: list[dict], tolerance: float) -> list[dict]:
    """Douglas-Peucker with a stack: the farthest point of a span stays if it lies beyond the tolerance."""
    points = [(p["x"], p["y"]) for p in ring]
    if len(points) < 4:
        return ring
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    if points[0] == points[-1]:  # a closed ring has no chord: split it at the point farthest from its start
        far = max(range(len(points)), key=lambda k: (points[k][0] - points[0][0]) ** 2 + (points[k][1] - points[0][1]) ** 2)
        keep.add(far)
        spans = [(0, far), (far, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        dx, dy = x1 - x0, y1 - y0
        length = dx * dx + dy * dy
        best, at = tolerance * tolerance, None
        for k in range(a + 1, b):
            px, py = points[k][0] - x0, points[k][1] - y0
            t = 0.0 if not length else max(0.0, min(1.0, (px * dx + py * dy) / length))
            gap = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if gap > best:
                best, at = gap, k
        if at is not None:
            keep.add(at)
            spans += [(a, at), (at, b)]
    return [{"x": round(points[k][0], 5), "y": round(points[k][1], 5)} for k in sorted(keep)]


def simplify(polygons: Column, tolerance: float) -> Column:
    """Polygons with fewer points, five decimals, closed as before."""
    @arrow_udf(POLYGONS_TYPE)
    def run(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        return pa.array([None if g is None else [[_simplify(r, tolerance) for r in p] for p in g] for g in batch.to_pylist()], kind)

    return run(polygons)


def ground_sample_distance(gt: tuple[float, ...], geographic: bool = False) -> str:
    side = (gt[1] ** 2 + gt[2] ** 2) ** 0.5
    return f"{side:.6g} deg" if geographic else f"{side:.3g} m"


def slug(count: int, hectares: float) -> str:
    """The name of a block set: how many blocks of what mean size."""
    return f"{count}x{hectares:.1f}ha".replace(".0ha", "ha")


def resources(samples: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """start, upper median, peak and end of a series."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))))
    series = samples.groupBy(*key).agg(ordered.alias("s"))
    values = F.array_sort(F.transform("s", lambda s: s["v"]))
    return series.select(*key, F.get("s", F.lit(0))["v"].alias("start"), F.get(values, F.floor(F.size("s") / 2).cast("int")).alias("p50"), F.array_max(values).alias("peak"), F.get("s", F.size("s") - 1)["v"].alias("end"))

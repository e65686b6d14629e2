"""Polygons as arrays of polygons of rings of points: readers, writers and measures, as Column expressions where SQL reaches.

The type is array<array<array<struct<x:double,y:double>>>>: polygons, then rings (first exterior, then holes), then points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

POINT = "struct<x:double,y:double>"
POLYGONS = f"array<array<array<{POINT}>>>"
POLYGONS_TYPE = ArrayType(ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))))


def ring_points(text: Column) -> Column:
    """Points of "x y, x y" text; further ordinates are ignored."""
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.struct(F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(1)).cast("double").alias("x"), F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).cast("double").alias("y")))


def from_wkt(text: Column) -> Column:
    """Polygons of (MULTI)POLYGON text, any case, an SRID prefix stripped; EMPTY gives none; null where it isn't well formed."""
    body = F.upper(F.trim(F.regexp_replace(text, r"(?i)^\s*SRID=\d+;", "")))
    multi = body.rlike(r"^MULTIPOLYGON")
    inner = F.regexp_replace(F.regexp_replace(body, r"^(MULTI)?POLYGON\s*(Z|M|ZM)?\s*", ""), r"\s*([(),])\s*", "$1")
    empty = inner == "EMPTY"
    balanced = F.length(F.regexp_replace(inner, r"[^(]", "")) == F.length(F.regexp_replace(inner, r"[^)]", ""))
    shaped = F.when(multi, inner.rlike(r"^\(\(\(.*\)\)\)$")).otherwise(inner.rlike(r"^\(\(.*\)\)$"))
    content = F.when(multi, F.regexp_extract(inner, r"^\(\(\((.*)\)\)\)$", 1)).otherwise(F.regexp_extract(inner, r"^\(\((.*)\)\)$", 1))
    polygons = F.when(multi, F.split(content, r"\)\),\(\(")).otherwise(F.array(content))
    parsed = F.transform(polygons, lambda p: F.transform(F.split(p, r"\),\("), ring_points))
    sound = F.forall(parsed, lambda p: F.forall(p, lambda r: (F.size(r) >= 3) & F.forall(r, lambda q: q["x"].isNotNull() & q["y"].isNotNull())))
    good = body.rlike(r"^(MULTI)?POLYGON") & balanced & shaped
    return F.when(empty & body.rlike(r"^(MULTI)?POLYGON"), F.array().cast(POLYGONS)).when(good, F.when(sound, parsed))


def to_wkt(polygons: Column) -> Column:
    """MULTIPOLYGON text with the order of rings kept."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ","), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ","), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(polygons, polygon), ","), F.lit(")"))


_RING = "array<array<double>>"


def from_geojson(text: Column) -> Column:
    """All polygons of a Polygon, MultiPolygon, Feature, FeatureCollection or GeometryCollection, nested once or twice.

    Null geometries are skipped; rings need four finite positions; null where nothing of these types is found."""

    def points(rings: Column) -> Column:
        return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))

    def own(geometry: Column) -> Column:
        kind = F.get_json_object(geometry, "$.type")
        coordinates = F.get_json_object(geometry, "$.coordinates")
        one = F.array(points(F.from_json(coordinates, f"array<{_RING}>")))
        many = F.transform(F.from_json(coordinates, f"array<array<{_RING}>>"), points)
        return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)

    def members(collection: Column, path: str) -> Column:
        return F.from_json(F.get_json_object(collection, path), "array<string>")

    def flat(geometry: Column) -> Column:
        inside = F.flatten(F.filter(F.transform(members(geometry, "$.geometries"), own), lambda p: p.isNotNull()))
        return F.coalesce(own(geometry), inside)

    kind = F.get_json_object(text, "$.type")
    features = F.transform(members(text, "$.features"), lambda f: flat(F.get_json_object(f, "$.geometry")))
    found = F.when(kind == "FeatureCollection", F.flatten(F.filter(features, lambda p: p.isNotNull())))
    found = found.when(kind == "Feature", flat(F.get_json_object(text, "$.geometry"))).otherwise(flat(text))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = F.forall(found, lambda p: F.forall(p, lambda r: (F.size(r) >= 4) & F.forall(r, lambda q: finite(q["x"]) & finite(q["y"]))))
    return F.when(sound, found)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive when counter-clockwise; the ring is closed whether or not its first point repeats."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def area(polygons: Column) -> Column:
    """Exterior areas less holes."""
    return F.aggregate(polygons, F.lit(0.0), lambda total, p: total + F.aggregate(F.transform(p, lambda r, i: F.abs(signed_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, b: a + b))


def bounds(polygons: Column) -> dict[str, Column]:
    points = F.flatten(F.flatten(polygons))
    of = lambda axis: F.transform(points, lambda p: p[axis])
    return {"west": F.array_min(of("x")), "south": F.array_min(of("y")), "east": F.array_max(of("x")), "north": F.array_max(of("y"))}


def sizes(polygons: Column) -> dict[str, Column]:
    return {"polygons": F.size(polygons), "vertices": F.size(F.flatten(F.flatten(polygons)))}


def contains(polygons: Column, x: Column, y: Column) -> Column:
    """Even-odd test with half-open edges, for each polygon; a point in any polygon is inside."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def crosses(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            straddles = (p["y"] > y) != (q["y"] > y)
            return F.when(straddles & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

        return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b)

    return F.exists(polygons, lambda p: F.aggregate(F.transform(p, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1)


def ground_area(polygons: Column) -> Column:
    """Square metres of degree rings on a plane scaled by the cosine of the mean latitude."""
    b = bounds(polygons)
    metres = 6378137.0 * 3.141592653589793 / 180
    return area(polygons) * metres * metres * F.cos(F.radians((b["south"] + b["north"]) / 2))

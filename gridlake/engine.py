"""The engine's calls, each on a DataFrame of many requests: render, sample, zonal, info and tile_info, and named geometries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import crs, geometry, tilemath
from gridlake.operators import coverage, geostore, mosaic, sample, style, zonal
from gridlake.raster import Raster
from gridlake.sources import tiff

MOST_NAMED = 4096  # blocks that are named to the reader one by one; beyond that it gets their bounds, and Spark filters the rest
QUERY_BYTES = 16 << 20  # the budget of one zone's window, where a caller asks for one


class Geometries:
    """A keyed table (provider, id, polygons, revision); changes give a new table and a higher revision."""

    def __init__(self, table: DataFrame):
        self.table = table

    def revision(self) -> int:
        return self.table.agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]

    def since(self, revision: int) -> DataFrame:
        """What has changed after a revision: what a subscriber that has seen it needs."""
        return self.table.where(F.col("revision") > revision)

    def set(self, changes: DataFrame) -> Geometries:
        """Add or replace (provider, id, polygons); what is there already, as it is, makes no new revision."""
        known = self.table.select("provider", "id", F.col("polygons").alias("_known"))
        changes = changes.join(known, ["provider", "id"], "left").where(~F.col("polygons").eqNullSafe(F.col("_known"))).select(*changes.columns)
        if changes.isEmpty():
            return self
        fresh = changes.withColumn("revision", F.lit(self.revision() + 1))
        return Geometries(geostore.upsert(self.table, fresh, ["provider", "id"], "revision"))

    def replace(self, provider: str, changes: DataFrame) -> Geometries:
        """Everything of a provider gives way to the changes."""
        kept = Geometries(self.table.where(F.col("provider") != provider))
        fresh = changes.withColumn("provider", F.lit(provider)).withColumn("revision", F.lit(self.revision() + 1))
        return Geometries(kept.table.unionByName(fresh.select(*self.table.columns)))

    def delete(self, keys: DataFrame) -> Geometries:
        return Geometries(geostore.delete(self.table, keys, ["provider", "id"]))

    def resolve(self, requests: DataFrame) -> DataFrame:
        """(zone_id, polygons) of requests (zone_id, provider, id): unions; a request with an unknown id is refused whole."""
        found = geostore.resolve(requests, self.table, ["provider", "id"], "zone_id")
        return geostore.union_geometry(found, "zone_id")


@dataclass(frozen=True)
class Scene:
    """One file's pyramid. Whatever reads it names the level and blocks that it needs, so others are neither read nor decoded."""

    spark: SparkSession
    path: str
    levels: tuple

    def __post_init__(self):
        if not self.levels:
            raise ValueError(f"{self.path} holds no image")

    width = property(lambda s: s.levels[0].width)
    height = property(lambda s: s.levels[0].height)
    bands = property(lambda s: s.levels[0].bands)
    epsg = property(lambda s: s.levels[0].epsg)

    @property
    def gt(self) -> tuple[float, ...]:
        return self.gt_of(0)

    def gt_of(self, level: int) -> tuple[float, ...]:
        return tuple(self.levels[level].gt) if self.levels[level].gt else (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)

    def grid(self, level: int) -> mosaic.Grid:
        return mosaic.Grid(self.gt_of(level), self.epsg, self.bands)

    def blocks(self, level: int = 0, needed: DataFrame | None = None, bands: list[int] | None = None) -> DataFrame:
        """Blocks of a level; with needed (bx, by), those only."""
        options, bounds = {}, None
        if needed is not None:
            needed = needed.select("bx", "by").distinct()
            named = needed.limit(MOST_NAMED + 1).collect()
            if len(named) <= MOST_NAMED:
                options["blocks"] = ",".join(f"{r.bx}:{r.by}" for r in named)
            else:
                bounds = needed.agg(*(f(c).alias(f"{k}_{c}") for c in ("bx", "by") for k, f in (("low", F.min), ("high", F.max)))).first()
        found = tiff.read_blocks(self.spark, self.path, **options).where(F.col("level") == level)
        if bands is not None:
            found = found.where(F.col("band").isin(sorted({min(b, self.bands - 1) for b in bands})))
        if bounds is not None:
            for c in ("bx", "by"):
                found = found.where((F.col(c) >= bounds[f"low_{c}"]) & (F.col(c) <= bounds[f"high_{c}"]))
            found = found.join(needed, ["bx", "by"], "left_semi")
        return found

    def raster(self, level: int = 0, needed: DataFrame | None = None, band: int | None = None) -> Raster:
        cells = tiff.cells(self.blocks(level, needed, None if band is None else [band]))
        return Raster(cells, self.gt_of(level), self.epsg, self.bands if band is None else 1)

    def block_of(self, row: Column, col: Column, level: int = 0) -> list[Column]:
        v = self.levels[level]
        return [F.floor(col / v.block_w).cast("int").alias("bx"), F.floor(row / v.block_h).cast("int").alias("by")]


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def info(self, path: str) -> DataFrame:
        """A row for each level of each file, full resolution included, with its extent and centre in degrees (null where the CRS isn't known)."""
        levels = tiff.read_info(self.spark, path)
        codes = [r.epsg for r in levels.select("epsg").distinct().collect()]  # a row for each CRS in use
        gt = [F.get("gt", i) for i in range(6)]
        corners = [tilemath.affine_forward(gt, c, r) for c in (F.lit(0), F.col("width")) for r in (F.lit(0), F.col("height"))]
        ends = F.lit(None).cast("struct<west:double,south:double,east:double,north:double>")
        for code in codes:
            if code in (None, 4326, 4269, 3857, 900913) or crs.zone_of(code):
                placed = [crs.unproject(x, y, code) for x, y in corners]
                lon, lat = [p[0] for p in placed], [p[1] for p in placed]
                box = F.struct(F.least(*lon).alias("west"), F.least(*lat).alias("south"), F.greatest(*lon).alias("east"), F.greatest(*lat).alias("north"))
                ends = F.when(F.col("epsg").eqNullSafe(F.lit(code)) & F.col("gt").isNotNull(), box).otherwise(ends)
        out = levels.withColumn("extent", ends)
        centre = F.struct(((out["extent.west"] + out["extent.east"]) / 2).alias("lon"), ((out["extent.south"] + out["extent.north"]) / 2).alias("lat"))
        return out.withColumn("center", F.when(out["extent"].isNotNull(), centre))

    def scene(self, path: str) -> Scene:
        return Scene(self.spark, path, tuple(tiff.read_info(self.spark, path).orderBy("level").collect()))  # a row for each pyramid level of one file

    def raster(self, path: str, level: int = 0, band: int | None = None) -> Raster:
        """One file as a raster of long-form cells; level and band reach the reader."""
        scene = self.scene(path)
        return scene.raster(min(level, len(scene.levels) - 1), band=band)

    def sample(self, points: DataFrame, raster: Raster | Scene, band: int = 0, nodata: float | None = None) -> DataFrame:
        """points (lon, lat) with value and status; of a scene only the points' blocks are read."""
        if isinstance(raster, Scene):
            scene, flat = raster, Raster(points, raster.gt, raster.epsg)
            needed = sample.located(points, flat).where(F.col("row").between(0, scene.height - 1) & F.col("col").between(0, scene.width - 1))
            raster = scene.raster(0, needed.select(*scene.block_of(F.col("row"), F.col("col"))), band)
            band = 0
        return sample.sample(points, raster, band, nodata)

    def to_cells(self, zones: DataFrame, raster: Raster | Scene) -> DataFrame:
        """zones (zone_id, polygons in degrees) in the raster's cell units."""

        def place(p):
            col, row = tilemath.affine_inverse(raster.gt, *crs.project(p["x"], p["y"], raster.epsg))
            return F.struct(col.alias("x"), row.alias("y"))

        return zones.withColumn("polygons", F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, place))))

    def zonal(self, zones: DataFrame, raster: Raster | Scene, width: int | None = None, height: int | None = None, band: int = 0, classes: bool = False, deviation: bool = True, budget: int | None = None) -> DataFrame:
        """Statistics of each zone (zone_id, polygons in degrees), or its classes. Of a scene only the zones' blocks are read.

        With a budget in bytes, a zone whose window takes more of four-byte values in all bands is refused, which its status says."""
        if isinstance(raster, Scene):
            width, height = raster.width, raster.height
        placed = self.to_cells(zones.select("zone_id", "polygons"), raster)
        b = geometry.bounds(F.col("polygons"))
        window = tilemath.corner_window((0.0, 1.0, 0.0, 0.0, 0.0, 1.0), [(b["west"], b["south"]), (b["east"], b["north"])], width, height)
        placed = placed.withColumns({f"_{k}": c for k, c in window.items()})
        size = (F.col("_c1") - F.col("_c0")).cast("long") * (F.col("_r1") - F.col("_r0")) * (4 * raster.bands)
        refused = F.lit(False) if budget is None else F.coalesce(size > budget, F.lit(False))
        state = placed.select("zone_id", refused.alias("_refused"), F.col("_c0").isNotNull().alias("_meets"))
        runs = coverage.coverage_runs(placed.where(~refused & F.col("_c0").isNotNull()).select("zone_id", "polygons"), width, height)
        if isinstance(raster, Scene):
            scene, v = raster, raster.levels[0]
            across = F.sequence(F.floor(F.col("col0") / v.block_w).cast("int"), F.floor((F.col("col0") + F.col("length") - 1) / v.block_w).cast("int"))
            needed = runs.select(F.explode(across).alias("bx"), F.floor(F.col("row") / v.block_h).cast("int").alias("by"))
            flat = scene.raster(0, needed, band)
            covered = zonal.covered(coverage.cells_of(runs), flat.cells)
        else:
            flat = raster
            covered = zonal.covered(coverage.cells_of(runs), raster.band(band))
        area = zonal.cell_area(flat)
        if classes:
            return zonal.classes(covered, area)
        return zonal.status(state, zonal.stats(covered, area, deviation))

    def render(self, tile_table: DataFrame, raster: Raster | Scene, wanted: style.Style | dict, size: int = 256, interpolation: str = "nearest", zones: DataFrame | None = None, as_png: bool = True) -> DataFrame:
        """(z, x, y, image) of the valid tiles among (z, x, y), clipped to zones (polygons in degrees) if there are any.

        Of a scene each tile takes the coarsest level that is fine enough, and the blocks under its window; a tile beside the raster is transparent."""
        wanted = style.Style.from_params(wanted) if isinstance(wanted, dict) else wanted
        size = max(64, min(512, size))
        good = tile_table.where(tilemath.valid_tile(F.col("z"), F.col("x"), F.col("y"))).select("z", "x", "y").distinct()
        bands = [0, 1, 2] if wanted.mode == "rgb" else [0]
        bilinear = interpolation == "bilinear"
        if isinstance(raster, Scene):
            scene = raster
            grids = {k: scene.grid(k) for k in range(len(scene.levels))}
            shapes = {k: (v.width, v.height) for k, v in enumerate(scene.levels)}
            placed = mosaic.windows(self._levels(good, scene.gt, scene.epsg, len(scene.levels), size), grids, shapes, size, bilinear)
            parts = None
            for k in [r.level for r in placed.select("level").distinct().collect()]:  # a row for each level in use
                v, mine = scene.levels[k], placed.where(F.col("level") == k)
                needed = mosaic.tile_blocks(mine, v.block_w, v.block_h)
                part = mosaic.parts_of(mine, scene.blocks(k, needed, bands), v.block_w, v.block_h)
                parts = part if parts is None else parts.unionAll(part)
        else:
            grids = {0: mosaic.Grid(raster.gt, raster.epsg, raster.bands)}
            cells = raster.cells.where(F.col("band").isin(sorted({min(b, raster.bands - 1) for b in bands})))
            ends = cells.agg(F.max("col").alias("c"), F.max("row").alias("r")).first()
            placed = mosaic.windows(good.withColumn("level", F.lit(0)), grids, {0: ((ends.c or 0) + 1, (ends.r or 0) + 1)}, size, bilinear)
            parts = mosaic.parts_of(placed, mosaic.blocks_of_cells(cells), mosaic.BLOCK, mosaic.BLOCK)
        if parts is None:
            parts = self.spark.createDataFrame([], mosaic.PARTS)
        masks = None if zones is None else mosaic.tile_masks(good, zones, size)
        return mosaic.render(placed, parts, grids, wanted, size, interpolation, masks, as_png)

    def _levels(self, tile_table: DataFrame, gt, epsg: int | None, levels: int, size: int) -> DataFrame:
        """tiles (z, x, y) with the level that serves them, by the size of their box's four corners."""
        west, south, east, north = self._box(tile_table, epsg)
        target = tilemath.overview_target(gt, F.abs(east - west), F.abs(north - south), size)
        return tile_table.select("z", "x", "y", F.coalesce(tilemath.overview_level(target, levels), F.lit(0)).alias("level"))

    @staticmethod
    def _corners(epsg: int | None) -> list[tuple[Column, Column]]:
        box = tilemath.tile_bbox(F.col("z"), F.col("x"), F.col("y"))
        return [crs.project(box[a], box[b], epsg) for a in ("west", "east") for b in ("south", "north")]

    def _box(self, tile_table: DataFrame, epsg: int | None) -> list[Column]:
        """West, south, east and north of the four corners in the CRS."""
        corners = self._corners(epsg)
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]

    def tile_info(self, tile_table: DataFrame, raster: Raster | Scene, width: int | None = None, height: int | None = None, levels: int | None = None, size: int = 256) -> DataFrame:
        """Level, window and has_data of tiles (z, x, y), from the four corners of their boxes; problem says what is wrong with an address."""
        if isinstance(raster, Scene):
            width, height, levels = raster.width, raster.height, len(raster.levels)
        out = self._levels(tile_table, raster.gt, raster.epsg, levels, size)
        window = tilemath.corner_window(raster.gt, self._corners(raster.epsg), width, height)
        out = out.select("z", "x", "y", "level", *(c.alias(k) for k, c in window.items()))
        return out.withColumn("has_data", F.col("c0").isNotNull()).withColumn("problem", tilemath.address_problem(F.col("z"), F.col("x"), F.col("y")))

"""Table-backed rasters: cells in long form with a geotransform, and the views of the driver's tables that serve as such."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 100


@dataclass(frozen=True)
class Raster:
    """cells(row int, col int, band int, value); a null value is missing."""

    cells: DataFrame
    gt: tuple[float, float, float, float, float, float] = (10.0, 0.01, 0.0, 2.0, 0.0, -0.01)
    epsg: int | None = 4326
    bands: int = 1

    def band(self, band: int = 0) -> DataFrame:
        """One band's cells; a band beyond the last is the last."""
        return self.cells.where(F.col("band") == min(band, self.bands - 1)) if self.bands > 1 else self.cells


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(key: str) -> list:
    k = F.col(key)
    return [F.floor(k / SIDE).cast("int").alias("row"), F.pmod(k, F.lit(SIDE)).cast("int").alias("col")]


def orders_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """One cell per order, its price; missing where the order is pending."""
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).cast("float")
    return Raster(read(spark, sf_dir, "orders").select(*grid("o_orderkey"), F.lit(0).alias("band"), value.alias("value")))


def category_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """One cell per order, the leading digit of its priority."""
    value = F.ascii("o_orderpriority").cast("float") - F.lit(48).cast("float")
    return Raster(read(spark, sf_dir, "orders").select(*grid("o_orderkey"), F.lit(0).alias("band"), value.cast("float").alias("value")))


def lineitem_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """Seven bands by line number, the mean price of an order's lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("value"))
    return Raster(lines.select(*grid("l_orderkey"), (F.col("l_linenumber") - 1).cast("int").alias("band"), "value"), bands=7)


def embedding_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """A 25-wide grid of vectors, a band for each component."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "value"))
    place = [F.floor(F.col("vec_id") / 25).cast("int").alias("row"), F.pmod("vec_id", F.lit(25)).cast("int").alias("col")]
    return Raster(rows.select(*place, F.col("band").cast("int").alias("band"), F.col("value").cast("float").alias("value")), bands=64)


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each nation, in cell units with fractional edges."""
    n = F.col("n_nationkey")
    x, y = (n % 5) * 20 + 0.25, F.floor(n / 5) * 30 + 0.5
    return read(spark, sf_dir, "nation").select(n.alias("zone_id"), x.cast("double").alias("x0"), (x + 17.5).cast("double").alias("x1"), y.cast("double").alias("y0"), (y + 25.75).cast("double").alias("y1"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    lon, lat = 10 + F.pmod(e, F.lit(100)) * 0.01 + 0.003, 2 - F.floor(e / 100) * 0.01 - 0.004
    return read(spark, sf_dir, "events").select(e.alias("point_id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), "ts")

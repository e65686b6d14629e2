"""gridlake: a PySpark-native raster analytics engine (blocks, cells, zones and tiles as DataFrames)."""

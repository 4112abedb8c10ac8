"""zonarium: zonal statistics of raster pixels inside polygons, expressed as Spark DataFrame plans."""

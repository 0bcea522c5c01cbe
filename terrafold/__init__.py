"""terrafold: aligned raster layers, radar polarimetry and their statistics as Spark DataFrame jobs."""

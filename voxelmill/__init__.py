"""Point-cloud and raster analytics on Spark DataFrames."""

"""tileweave: tiled raster data and its metadata as Spark DataFrames."""

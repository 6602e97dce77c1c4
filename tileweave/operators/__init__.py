"""Operators on datasets, assets, blocks and pixels: DataFrame in, DataFrame out."""

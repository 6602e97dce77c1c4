"""Files as DataFrames of assets, blocks and byte ranges, and back."""

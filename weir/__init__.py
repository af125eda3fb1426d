"""weir: content-defence analytics over DataFrames."""

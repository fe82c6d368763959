"""Spark-native analytics for spectral rasters: masks, scores, grids, blocked statistics.

Rows are pixels (``scene keys, row_i, col_i, refl ARRAY<DOUBLE>``) or score cells; every operator is a
function from DataFrames to a DataFrame.  Missing is always NULL, never NaN.
"""

"""Facetflow: multivariate analysis and table preparation on PySpark DataFrames."""

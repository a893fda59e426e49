"""Spark jobs for tables of sampled curves and the regression models built on them."""

__version__ = "0.1.0"

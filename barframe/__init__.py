"""barframe: normalized integer time-series records as Spark DataFrames."""

__version__ = "0.1.0"

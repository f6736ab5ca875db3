"""Analytics engine for shared-mobility station and vehicle feeds, built on PySpark DataFrames."""

__version__ = "0.1.0"

"""Space-time analytics on Spark: long DataFrames of point, epoch, component and value."""

__version__ = "0.1.0"

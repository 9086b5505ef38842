"""gridloom: a PySpark-native engine for gridded (raster) data."""

__version__ = "0.1.0"

"""A PySpark-native analytics engine: register tables, query them with SQL, process them at scale."""

__version__ = "0.1.0"

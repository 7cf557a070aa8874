"""Column-level building blocks; every function returns a ``pyspark.sql.Column``."""

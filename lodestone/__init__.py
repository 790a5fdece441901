"""lodestone: a Spark-native analytics engine (DataFrame and SQL surface over PySpark)."""

__version__ = "0.1.0"

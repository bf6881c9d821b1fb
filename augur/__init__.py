"""augur: forecast-benchmark analytics as PySpark DataFrame transformations."""

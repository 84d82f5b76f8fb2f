"""pulse: point-in-time activity features, labels, rule scores and models on Spark.

Every operator takes and returns DataFrames; nothing in the data path leaves the JVM
except the per-fold model fits that pyspark.ml itself distributes.
"""

__all__ = ["session", "config"]

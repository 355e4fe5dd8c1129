"""skylane: Spark-native on-time-performance analytics.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
small driver-side value where the result is by nature one number), so the
whole library composes into single Catalyst plans.
"""

__version__ = "0.1.0"

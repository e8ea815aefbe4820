"""trafficlens: PySpark-native analytics for telling automated accounts from people.

Every operator is a DataFrame function ``f(df, ...) -> DataFrame``, a column
expression, or a ``pyspark.ml`` stage, so Catalyst plans the whole job.
"""

__version__ = "0.1.0"
